"""Duplicate word runs by relative Lempel-Ziv parsing.

Segments that share an anchor (see :mod:`textloom.llm.anchors`) form a
reference block. The block's suffix array, with for every suffix the nearest
suffixes of smaller documents on either side of it, gives the longest factor
that an earlier document holds at any place. A document's segment is parsed
greedily into such factors; factors of the least length become duplicate
spans, and as a greedy cut may part a longer match, the places before each
factor's end are parsed again from there. An anchor with too many different
segments for a block is split: its segments are cut into ranges of windows,
which have a longer anchor in common.

Words are compared by 64-bit values, and segments taken for equal if 128 bits of
hashes, of anchor and content, are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.anchors import finer, keyed, null_safe, ranges, segment_rows, spans, strings
from textloom.llm.common import bound_batches, materialize, trim
from textloom.llm.neardup import located_words, word_values
from textloom.llm.repeats import SPAN, gathered, merged, span_batch

#: Spans of a segment: in words of the text, or where c is set, from the begin of segment (h, c) on.
PARSED = f"h long, c long, {SPAN}"

#: Words of a duplicate run, and of the k-grams that anchor it.
LEAST, GRAM = 13, 4
#: Different segments of one anchor that a block takes; beyond it the anchor is split.
CROWD = 20_000
#: Words of a block.
BLOCK = 300_000


def _ranks(values: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by the first ``depth`` words at least (a power of two), and the ranks by 1, 2, 4 ... words."""
    _, rank = np.unique(values, return_inverse=True)
    ranks, done, n = [rank.astype(np.int64)], 1, len(values)
    while done < depth:
        r = ranks[-1]
        second = np.zeros(n, np.int64)
        second[: n - done] = r[done:] + 1 if n > done else 0
        key = r.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        _, new = np.unique(key, return_inverse=True)
        ranks.append(new.astype(np.int64))
        done *= 2
    return np.argsort(ranks[-1], kind="stable"), ranks


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to twice the greatest depth less one."""
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[level][x[ok]] == ranks[level][y[ok]]
        length[same] += 1 << level
    return length


def _nearest_smaller(doc: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a strictly smaller value, or -1, by pointer jumping."""
    n = len(doc)
    at = np.arange(n) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        bad = doc[at[todo]] >= doc[todo]
        todo = todo[bad]
        # a place that is not smaller passes on where it looks itself; what that skips is no smaller either
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def longest_factors(values: np.ndarray, doc: np.ndarray, depth: int = 32) -> np.ndarray:
    """Length, up to ``depth``, of the longest match of each place with a place of a smaller document."""
    order, ranks = _ranks(values, depth)
    d = doc[order]
    best = np.zeros(len(values), np.int64)
    for flip in (False, True):
        near = _nearest_smaller(d[::-1] if flip else d)
        near = np.where(near >= 0, len(d) - 1 - near, -1)[::-1] if flip else near
        has = np.flatnonzero(near >= 0)
        length = np.minimum(_common(ranks, order[has], order[near[has]]), depth)
        best[order[has]] = np.maximum(best[order[has]], length)
    return best


def parse(factor: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Duplicate spans of one segment from its longest factors, by a greedy parse checked at factor ends."""
    found, at, n = [], 0, len(factor)
    while at < n:
        length = int(factor[at])
        if length >= least:
            found.append((at, at + length))
        end = at + max(1, length)
        # matches that begin inside the factor and pass its end
        for p in range(max(at + 1, end - least + 1), min(end, n)):
            if factor[p] >= least and p + factor[p] > end:
                found.append((p, p + int(factor[p])))
        at = end
    return merged(sorted(found))


def _blocks(least: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[3]) for r in rows], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        values = np.zeros(int(sizes.sum()) + len(rows), np.uint64)
        owner = np.repeat(np.arange(len(rows)), sizes + 1)
        inside = np.ones(len(values), bool)
        inside[begin + sizes] = False
        values[inside] = np.concatenate([r[3] for r in rows])
        values[begin + sizes] = np.arange(len(rows), dtype=np.uint64)  # separators are all different
        doc = np.array([r[1] for r in rows], np.int64)[owner]
        factors = longest_factors(values, doc)
        out = []
        for r, b, n in zip(rows, begin.tolist(), sizes.tolist(), strict=True):
            own = np.minimum(factors[b : b + n], np.arange(n, 0, -1))
            if (own >= least).any():
                out.append((r[5], r[6], r[1], r[2], [(r[4] + x, r[4] + y) for x, y in parse(own, least)]))
        keys = [pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)]
        found = span_batch([r[2:] for r in out])
        return pa.RecordBatch.from_arrays([*keys, *found.columns], names=["h", "c", *found.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            data = batch.column("seg")
            raw, offs = strings(data)
            words = np.frombuffer(raw.tobytes(), np.uint64)
            for k, (h, doc, tag, base, own_h, own_c) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("h", "doc_id", "tag", "base", "own_h", "own_c")), strict=True)):
                if size > BLOCK and h != last:
                    yield solve(held)
                    held, size = [], 0
                last = h
                held.append((h, doc, tag, words[offs[k] // 8 : offs[k + 1] // 8], base, own_h, own_c))
                size += int(offs[k + 1] - offs[k]) // 8
        if held:
            yield solve(held)
        held = []
        trim()

    return run


def _cut_out(width: int):
    """Words, as 64-bit values, of the requested segments of each text; base: where spans count from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column("text"))
            values, word_offs = word_values(data, offs)
            out: list[list] = [[] for _ in range(7)]
            for k, (i, t, asked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                base = int(word_offs[k])
                for a in asked or ():
                    for o, v in zip(out, (a["h"], a["c"], i, t, a["s1"] if a["c"] is None else 0, values[base + a["s1"] : base + a["s2"] + width].tobytes(), a["crowded"]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["h", "own_c", "doc_id", "tag", "base", "seg", "crowded"])

    return run


PART = "h long, c long, own_h long, own_c long, doc_id long, tag string, base int, at int, seg binary"


def _finer(least: int, gram: int, size: int):
    """Pieces of crowded segments, see :func:`textloom.llm.anchors.finer`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = strings(batch.column("seg"))
            words = np.frombuffer(raw.tobytes(), np.uint64)
            if not len(words):
                continue
            offs = offs // 8
            row, h, c, first, last, place = finer(words, offs, batch.column("h").to_numpy().view(np.uint64), np.asarray(batch.column("at"), np.int64), least, gram, size)
            take = pa.array(row)
            seg = [words[a : b + least].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            base = np.asarray(batch.column("base"))[row] + first - offs[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), *(batch.column(x).take(take) for x in ("own_h", "own_c", "doc_id", "tag")), pa.array(base.astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(seg, pa.binary())], names=["h", "c", "own_h", "own_c", "doc_id", "tag", "base", "at", "seg"])

    return run


def duplicate_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, tag, spans) in words of stretches to remove from a keyed table; they may overlap or repeat."""
    docs = docs.where(F.col("doc_id").isNotNull())
    rows = segment_rows(docs, word_values, least, gram)
    dup = rows.groupBy("h").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("d1 < d2").select("h", "d1", (F.col("c1") == F.col("c2")).alias("same"))
    dup = materialize(dup, "repeated")  # so that both sides of the join are plain shuffles, which can be split by skew
    cand = materialize(rows.join(dup, "h"), "anchors")
    span = ("doc_id", "tag", spans(least))
    # a segment that an earlier document holds whole is a factor without a parse
    mixed = cand.where(~F.col("same"))
    # one place in the smallest document is parsed; single, last: whether that document has other places of the segment
    one = F.min(F.struct("doc_id", F.col("again").isNull().alias("single"), "tag", "s1", "s2"))
    last = F.max(F.struct(F.bitwise_not("doc_id").alias("d"), "tag", "s1"))
    kinds = materialize(mixed.groupBy("h", "c").agg(one.alias("one"), last.alias("last"), F.max("doc_id").alias("d2")), "kinds")
    again = kinds.where(F.col("one.doc_id") < F.col("d2")).select("h", "c", F.col("one.doc_id").alias("d"))
    sure = cand.where(F.col("same") & (F.col("doc_id") > F.col("d1"))).select(*span).unionByName(mixed.join(again, ["h", "c"]).where("doc_id > d").select(*span))
    crowds = materialize(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("h"), "crowds")
    more = F.when(~F.col("one.single") | (F.col("last.tag") != F.col("one.tag")) | (F.col("last.s1") != F.col("one.s1")), F.col("c")).alias("c")
    asked = kinds.join(crowds.withColumn("crowded", F.lit(True)), "h", "left").select("one.doc_id", "one.tag", F.struct("h", more, "one.s1", "one.s2", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("ask"))
    asked = asked.groupBy("doc_id", "tag").agg(F.collect_list("ask").alias("asked"))
    got = materialize(null_safe(docs, asked).mapInArrow(_cut_out(least), "h long, own_c long, doc_id long, tag string, base int, seg binary, crowded boolean"), "segments")
    got = got.withColumns({"own_h": F.col("h"), "at": F.lit(-1)})
    block = ("h", "own_h", "own_c", "doc_id", "tag", "base", "seg")
    solved = lambda rows: rows.repartition("h").sortWithinPartitions("h").select(*block).mapInArrow(_blocks(least), PARSED)
    parsed, left = solved(got.where(~F.col("crowded"))), got.where("crowded")
    for size in ranges(least, gram):
        if left.isEmpty():
            break
        parts = materialize(left.select(*block, "at").mapInArrow(_finer(least, gram, size), PART), "parts")
        kinds = materialize(parts.groupBy("h", "c").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")), "part-kinds")
        whole = F.array(F.struct(F.col("base").alias("start"), (F.col("base") + (F.length("seg") / 8).cast("int")).alias("stop"))).alias("spans")
        held = parts.select("h", "c", "own_h", "own_c", "doc_id", "tag", whole).join(kinds.where("d1 < d2").select("h", "c", "d1"), ["h", "c"]).where("doc_id > d1")
        groups = materialize(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "part-groups")
        rows = materialize(parts.join(kinds.select("h", "c", F.col("d1").alias("doc_id")), ["h", "c", "doc_id"]).join(groups, "h").drop("c"), "part-rows")
        left = rows.where(F.col("m") > crowd)
        parsed = parsed.unionByName(held.select(F.col("own_h").alias("h"), F.col("own_c").alias("c"), "doc_id", "tag", "spans")).unionByName(solved(rows.where(F.col("m") <= crowd)))
    parsed = materialize(parsed, "parsed")
    # what was found at one place holds at all places of the segment in that document
    found = parsed.where("c IS NOT NULL").groupBy("h", "c", "doc_id").agg(F.flatten(F.collect_set("spans")).alias("inner"))
    starts = F.concat(F.array("s1"), F.coalesce("again", F.array().cast("array<int>")))
    spread = F.flatten(F.transform(starts, lambda s: F.transform("inner", lambda x: F.struct((s + x["start"]).alias("start"), (s + x["stop"]).alias("stop")))))
    other = mixed.join(found, ["h", "c", "doc_id"]).select("doc_id", "tag", spread.alias("spans"))
    return sure.unionByName(parsed.where("c IS NULL").select("doc_id", "tag", "spans")).unionByName(other)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = strings(batch.column("text"))
        raw = data.tobytes()
        _, first, end, word_offs = located_words(data, offs)
        kept, counts = [], []
        for k, own in enumerate(batch.column("spans").to_pylist()):
            a, b = int(word_offs[k]), int(word_offs[k + 1])
            cut = merged(sorted({(x["start"], x["stop"]) for x in own or ()}))
            if cut:
                stay = np.ones(b - a, bool)
                for x, y in cut:
                    stay[x:y] = False
                at = (np.flatnonzero(stay) + a).tolist()
                words = [raw[first[w] : end[w]] for w in at]
            else:
                words = raw[offs[k] : offs[k + 1]].split()
            kept.append(b" ".join(words))
            counts.append((b - a, b - a - len(words)))
        cols = np.array(counts, np.int64).reshape(-1, 2)
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols.T), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def without_duplicate_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (texts) kept, the words that remain with blanks between, of each row.

    A word goes if a window of ``least`` words around it also starts in a row
    with a smaller id. Null texts have no words; short texts lose none. Rows of
    equal ids are no earlier than each other; rows without an id neither give
    nor take. An empty table gives an empty table; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    found = gathered(duplicate_spans(own, least))
    out = null_safe(own, found, "left").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")
