"""Named entities by dictionary: an automaton over the alias index finds all names of a text in one pass.

The index is dealt into shards of a bounded number of aliases; each shard is one
automaton, made on the driver, and adds its finds to the row of the document, so
that no text is shuffled. Texts are read word by word, many places at once, as
arrays. Of finds that overlap the longest stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from textloom.functions.scratch import materialize
from textloom.operators.extract import PUNCTUATION, normal_alias, valid_span
from textloom.session import bound_batches

#: Aliases of one automaton: what every worker is sent is bounded by this, whatever the index holds.
SHARD = 200_000
#: Characters of the texts that are arrays at once, but for a longer text.
PIECE = 1 << 20
#: What one place reads of a row of words before the next place's begins.
LANE = 32
FOUND = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("label", StringType())]))
_FOUND = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string())])
#: Stands before, between and after texts.
_END = "\0"


class Automaton:
    """Aho and Corasick: a trie of the names, and for each state the longest suffix that is a state too.

    A name is a sequence of symbols: the letters of a string, or words. States
    are numbered by depth, so that the steps (state and symbol) are in order and
    the i-th of them leads to state i + 1; symbols count from 1, 0 is in no name.
    """

    def __init__(self, names: dict[Sequence[str], str]):
        of: dict[str, int] = {}
        flat = np.array([of.setdefault(s, len(of) + 1) for name in names for s in name], np.int64)
        self.symbols, self.width, self.labels = pa.array(list(of), pa.string()), len(of) + 1, list(names.values())
        size = np.array([len(name) for name in names], np.int64)
        at, begin = np.zeros(len(size), np.int64), np.cumsum(size) - size
        self.depth = int(size.max(initial=0))
        steps, self.fail = np.empty(len(flat), np.int64), np.zeros(len(flat) + 1, np.int64)
        levels = [1]
        for depth in range(self.depth):  # a suffix is shorter than what it ends
            longer, n = np.flatnonzero(size > depth), levels[-1]
            new, of_name = np.unique(at[longer] * self.width + flat[begin[longer] + depth], return_inverse=True)
            at[longer] = n + of_name
            child, symbol, state = np.arange(n, n + len(new)), new % self.width, self.fail[new // self.width]
            while depth and len(child):
                i = np.minimum(np.searchsorted(steps[: n - 1], state * self.width + symbol), n - 2)
                found = steps[i] == state * self.width + symbol
                self.fail[child[found]] = i[found] + 1
                left = ~found & (state > 0)
                child, symbol, state = child[left], symbol[left], self.fail[state[left]]
            steps[n - 1 : n - 1 + len(new)] = new
            levels.append(n + len(new))
        self.steps, self.fail = steps[: levels[-1] - 1], self.fail[: levels[-1]]
        self.root = np.zeros(self.width, np.int64)
        first = self.steps[: levels[min(1, self.depth)] - 1]
        self.root[first] = np.arange(1, len(first) + 1)
        self.names = np.full(levels[-1], -1)
        self.names[at[size > 0]] = np.flatnonzero(size > 0)
        self.size = np.append(size, 0)  # that of the state without a name comes last
        self.shorter = np.zeros(levels[-1], np.int64)
        for a, b in zip(levels, levels[1:], strict=False):
            suffix = self.fail[a:b]
            self.shorter[a:b] = np.where(self.names[suffix] >= 0, suffix, self.shorter[suffix])

    @cached_property
    def _steps(self) -> pd.Index:
        return pd.Index(self.steps)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_steps"}

    def walk(self, symbols: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and number of every occurrence of every name in a row of symbols.

        The row is read from many places at once. What is read before a place
        is as long as the longest name, so that its state is that of one pass.
        """
        none = np.zeros(0, np.int64)
        if not self.depth or not len(symbols):
            return none, none, none
        before = self.depth - 1
        lane = max(lane, 4 * before)
        places = np.arange(-(-len(symbols) // lane))
        row = np.zeros(before + len(places) * lane, np.int64)
        row[before : before + len(symbols)] = symbols
        state, found = np.zeros(len(places), np.int64), [(none, none)]
        for i, symbol in enumerate(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(row, before + lane)[::lane].T)):
            after = self.root[symbol]
            at = np.flatnonzero((state > 0) & (symbol > 0))
            suffix, read = state[at], symbol[at]
            while len(at):
                step = self._steps.get_indexer(suffix * self.width + read)
                after[at[step >= 0]] = step[step >= 0] + 1
                suffix = self.fail[suffix]
                left = (step < 0) & (suffix > 0)
                at, suffix, read = at[left], suffix[left], read[left]
            state = after
            if i >= before:
                end = np.where(self.names[state] >= 0, state, self.shorter[state])
                at = np.flatnonzero(end)
                while len(at):
                    found.append((at * lane + i - before + 1, end[at]))
                    end = self.shorter[end]
                    at = np.flatnonzero(end)
        stop, end = (np.concatenate(x) for x in zip(*found, strict=True))
        name = self.names[end]
        return stop - self.size[name], stop, name

    def finds(self, text: Sequence[str], lane: int = LANE) -> Iterator[tuple[int, int, str]]:
        """(start, stop, label) of every occurrence of every name."""
        of = {s: i + 1 for i, s in enumerate(self.symbols.to_pylist())}
        start, stop, name = self.walk(np.array([of.get(s, 0) for s in text], np.int64), lane)
        for a, b, i in zip(start.tolist(), stop.tolist(), name.tolist(), strict=True):
            yield a, b, self.labels[i]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether plain forms have it, its lower case where that is one letter, whether it is part of a word."""
    every = [chr(i) for i in range(0x110000)]
    kept = np.ones(len(every), bool)
    kept[[ord(c) for c in PUNCTUATION]] = False
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else i for i, c in enumerate(every)], np.uint32)
    return kept, lower, np.array([c.isalnum() for c in every])


class Words:
    """Texts as aliases are written, lower-cased and without punctuation, cut into words and the letters between them."""

    def __init__(self, texts: Sequence[str]):
        kept, lower, alnum = _letters()
        self.text = _END + "".join(t + _END for t in texts)
        code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        #: Where each text begins, and where the letters of the plain form stood.
        self.begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.at = np.flatnonzero(kept[code])
        form = lower[code[self.at]]
        self.inner = alnum[form]
        self.cut = np.flatnonzero(np.append(True, ~(self.inner[1:] & self.inner[:-1])))
        size = (form > 0x7F).astype(np.int32) + 1
        size += form > 0x7FF
        size += form > 0xFFFF
        bounds = np.append(np.int32(0), np.cumsum(size, dtype=np.int32))
        bounds = np.append(bounds[self.cut], bounds[-1])
        self.words = pa.StringArray.from_buffers(len(self.cut), pa.py_buffer(bounds), pa.py_buffer(form.tobytes().decode("utf-32-le").encode()))
        self.ends = np.searchsorted(self.cut, np.searchsorted(self.at, self.begin - 1))

    def each(self) -> list[tuple[str, ...]]:
        """The words of each text."""
        words = self.words.to_pylist()
        return [tuple(words[a + 1 : b]) for a, b in zip(self.ends, self.ends[1:], strict=False)]

    def finds(self, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, stop in it and number of the names that begin and end at word boundaries."""
        symbols = pc.index_in(self.words, value_set=automaton.symbols).fill_null(-1).to_numpy(zero_copy_only=False) + 1
        symbols[self.ends] = 0
        a, b, name = automaton.walk(symbols)
        a, b = self.cut[a], self.cut[b]
        whole = ~(self.inner[a - 1] | self.inner[b])
        start, stop = self.at[a[whole]], self.at[b[whole] - 1] + 1
        text = np.searchsorted(self.begin, start, "right") - 1
        return text, start - self.begin[text], stop - self.begin[text], name[whole]


def longest_first(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Numbers of the finds that stay where none may overlap: the longest before all, the earlier of equals."""
    order = np.argsort(start, kind="stable")
    if not len(order):
        return order
    apart = start[order][1:] >= np.maximum.accumulate(stop[order])[:-1]
    alone = np.append(True, apart) & np.append(apart, True)
    rest, taken, stays = order[~alone], bytearray(int(stop.max())), []
    rest = rest[np.lexsort((start[rest], start[rest] - stop[rest]))]
    for i, a, b in zip(rest.tolist(), start[rest].tolist(), stop[rest].tolist(), strict=True):
        if not taken[a] and not taken[b - 1]:  # what was taken before is as long at least, so that it has one end of this or none of it
            taken[a:b] = b"\1" * (b - a)
            stays.append(i)
    return np.append(order[alone], np.array(stays, np.int64))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about PIECE characters."""
    read = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(read)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def _shard(automaton: Automaton, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of article_id, text and what the shards before have found, if any; with what this one finds, or after the last a row for each span that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(automaton.labels, pa.string())
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            words = Words([t or "" for t in batch.column(1).to_pylist()])
            text, start, stop, name = words.finds(automaton)
            label = labels.take(pa.array(name))
            if batch.num_columns > 2:
                old, counts = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                text = np.append(text, np.repeat(np.arange(len(counts)), counts))
                start, stop = np.append(start, old.field("start")), np.append(stop, old.field("stop"))
                label = pa.concat_arrays([label, old.field("label")])
            if last:
                start, stop = start + words.begin[text], stop + words.begin[text]
                stays = longest_first(start, stop)
                text, start, stop, label = text[stays], start[stays], stop[stays], label.take(pa.array(stays))
                spans = pa.array([words.text[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.string())
                start, stop = start - words.begin[text], stop - words.begin[text]
                out = {"article_id": batch.column(0).take(pa.array(text)), "entity_text": spans, "entity_label": label, "start_char": pa.array(start, pa.int32()), "end_char": pa.array(stop, pa.int32())}
            else:
                order = np.argsort(text, kind="stable")
                found = pa.StructArray.from_arrays([pa.array(start[order], pa.int32()), pa.array(stop[order], pa.int32()), label.take(pa.array(order))], fields=list(_FOUND))
                bounds = np.append(0, np.cumsum(np.bincount(text, minlength=batch.num_rows)))
                out = {"article_id": batch.column(0), "text": batch.column(1), "found": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def names_of(aliases: DataFrame) -> DataFrame:
    """(alias, label): one label for each alias in its plain form, of most sitelinks, then the smallest. aliases: alias, label, sitelinks."""
    one = aliases.select(normal_alias(F.col("alias")).alias("alias"), "label", "sitelinks").where("alias <> '' AND label IS NOT NULL")
    best = F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("sitelinks"), "label"))
    return one.withColumn("r", best).where("r = 1").select("alias", "label")


def gazetteer_spans(docs: DataFrame, aliases: DataFrame, shard: int = SHARD) -> DataFrame:
    """(article_id, entity_text, entity_label, start_char, end_char) of the names in docs(article_id, text).

    aliases: alias, label, sitelinks. Texts and aliases are compared in lower
    case without punctuation, between word boundaries; start_char and end_char
    are places in the text as it is. Of overlapping names the longest counts,
    the earlier of equals; spans that are no valid span (80 letters, six words)
    are left out after that. Null texts and an empty index give no rows;
    repeated rows give their spans again.
    """
    bound_batches(docs.sparkSession)
    names = materialize(names_of(aliases), "names")
    shards = max(1, -(-names.count() // shard))
    names = names.withColumn("shard", F.pmod(F.xxhash64("alias"), F.lit(shards)))
    rows = docs.select("article_id", "text")
    key, text, label = docs.schema["article_id"], docs.schema["text"], StringType()
    found = StructType([key, text, StructField("found", FOUND)])
    spans = StructType([key, StructField("entity_text", label), StructField("entity_label", label), StructField("start_char", IntegerType()), StructField("end_char", IntegerType())])
    for k in range(shards):
        part = names.where(F.col("shard") == k).select("alias", "label").orderBy("alias").collect()
        automaton = Automaton(dict(zip(Words([r["alias"] for r in part]).each(), (r["label"] for r in part), strict=True)))
        rows = rows.mapInArrow(_shard(automaton, k == shards - 1), spans if k == shards - 1 else found)
    return rows.where(valid_span(F.col("entity_text")))
