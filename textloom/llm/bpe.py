"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch lie one after another in a flat array of symbol ids.
In each round every sequence applies its own lowest-rank pair, all sequences at
once; ranks are looked up again only beside the merged places. A sequence that
has no mergeable pair left leaves the arrays with its count.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bound_batches

SPACE = "▁"
#: Longer sequences are merged one at a time with a heap: rounds cost their length squared.
LONG = 192
#: Words whose counts a worker remembers; beyond it the memory is emptied.
REMEMBERED = 200_000
NONE = np.int32(1 << 30)


class PieceCounter:
    """Counts the pieces that a byte-fallback BPE model of sentencepiece makes of texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds & {4, 5}:
            raise ValueError("the model normalises text or has user-defined or unused pieces")
        self.prefix = norm.add_dummy_prefix
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans words")
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.n_pieces = len(pieces)
        for char in sorted({c for p in pieces for c in p} - self.ids.keys()):
            self.ids[char] = len(self.ids)
        rank = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, ranks, made = [], [], []
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank[score])
                    made.append(self.ids[p])
        # open addressing with linear probing, filled round by round
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        self.slot_made = np.zeros(1 << self.bits, np.int32)
        left = (np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32))
        self.probes = 0
        while len(left[0]):
            at = (self._slot(left[0]) + self.probes) & ((1 << self.bits) - 1)
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.slot_key[at] < 0)
            for table, x in zip((self.slot_key, self.slot_rank, self.slot_made), left, strict=True):
                table[at[put]] = x[put]
            left = tuple(x[~put] for x in left)
            self.probes += 1
        self.alone = {p for p in map(chr, range(0x250)) if p not in {c for q in pieces if len(q) > 1 for c in q}}
        self.cut = re.compile("([" + re.escape("".join(sorted(self.alone))) + "])") if self.alone else None
        self.char_id = np.full(0x110000, -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.char_id[ord(c)] = i
        self.known: dict[str, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; rank NONE where it does not merge."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a.astype(np.int64) << 20 | b)
        rank, made = np.full(len(a), NONE, np.int32), np.zeros(len(a), np.int32)
        at, open_ = self._slot(keys), np.arange(len(a))
        for _ in range(self.probes):
            there = self.slot_key[at]
            hit = there == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.slot_rank[at[hit]], self.slot_made[at[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def _chars(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each character (-1: no piece has it), its UTF-8 length, lengths of the words."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        return self.char_id[code], size, np.fromiter(map(len, words), np.int64, len(words))

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the non-empty pre-tokens."""
        sym, size, lens = self._chars(words)
        out = np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(words)), lens)
        # a symbol that is no piece falls back to its bytes
        weight = np.where((sym >= 0) & (sym < self.n_pieces), 1, size)
        inner = np.ones(len(sym), bool)
        inner[np.cumsum(lens) - 1] = False
        rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        at = np.flatnonzero(inner)
        rank[at], made[at] = self._find(sym[at], sym[at + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, start)
            over = best == NONE
            if over.any():
                lens_now = np.diff(np.r_[start, len(sym)])
                out[owner[start[over]]] = np.add.reduceat(weight, start)[over]
                stay = np.repeat(~over, lens_now)
                sym, weight, owner, rank, made = (x[stay] for x in (sym, weight, owner, rank, made))
                if not len(sym):
                    break
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                best = best[~over]
            low = np.flatnonzero(rank == np.repeat(best, np.diff(np.r_[start, len(sym)])))
            low = low[np.r_[True, owner[low][1:] != owner[low][:-1]]]  # the leftmost of each sequence
            sym[low], weight[low] = made[low], 1
            rank[low] = rank[low + 1]  # NONE at the end of a sequence stays
            stay = np.ones(len(sym), bool)
            stay[low + 1] = False
            new = low - np.arange(len(low))
            last = np.r_[owner[1:] != owner[:-1], True]
            last[low] = last[low + 1]
            sym, weight, owner, rank, made, last = (x[stay] for x in (sym, weight, owner, rank, made, last))
            prev = new[(new > 0)] - 1
            again = np.concatenate([new, prev])
            again = again[~last[again]]
            rank[new[last[new]]] = NONE
            rank[again], made[again] = self._find(sym[again], sym[again + 1])
        return out

    def merge_long(self, word: str) -> int:
        """The same for one long pre-token, with a heap over a linked list."""
        sym, size, _ = self._chars([word])
        sym, n = sym.tolist(), len(word)
        weight = [1 if 0 <= s < self.n_pieces else int(z) for s, z in zip(sym, size, strict=True)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        ranks, mades = (x.tolist() for x in self._find(np.array(sym[:-1]), np.array(sym[1:])))
        heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(ranks, mades, strict=True)) if r < NONE]
        heapq.heapify(heap)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n:
                key = (sym[i], sym[j])
                if key not in pairs:
                    r, m = self._find(np.array([key[0]]), np.array([key[1]]))
                    pairs[key] = (int(r[0]), int(m[0]))
                if pairs[key][0] < NONE:
                    heapq.heappush(heap, (pairs[key][0], i, *key, pairs[key][1]))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], weight[i], alive[j], after[i] = m, 1, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return sum(w for w, live in zip(weight, alive, strict=True) if live)

    def pretokens(self, text: str) -> list[str]:
        """Pieces never cross from another character to a space mark, so texts are cut there.

        What begins with exactly one space mark comes without it, anything else
        after a blank, which no pre-token holds.
        """
        if not text:
            return []
        if self.prefix and "  " not in text and SPACE not in text and text[0] != " ":
            return text.split(" ")
        return [w[1:] if w[:1] == SPACE and SPACE not in w[1:] else " " + w for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", (SPACE if self.prefix else "") + text.replace(" ", SPACE))]

    def _learn(self, words: list[str]) -> None:
        parts: list[str] = []
        spans = []
        for w in words:
            full = w[1:] if w[:1] == " " else SPACE + w
            cut = [p for p in self.cut.split(full) if p] if self.cut else [full]
            spans.append(len(cut))
            parts += cut
        counts = np.zeros(len(parts), np.int64)
        short = [i for i, p in enumerate(parts) if len(p) <= LONG]
        for k in range(0, len(short), 20_000):
            some = short[k : k + 20_000]
            counts[some] = self.merge([parts[i] for i in some])
        for i, p in enumerate(parts):
            if len(p) > LONG:
                counts[i] = self.merge_long(p)
        ends = np.cumsum(spans)
        total = np.r_[0, np.cumsum(counts)]
        self.known.update(zip(words, (total[ends] - total[ends - np.array(spans)]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = [self.pretokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in set().union(*cut) if w not in self.known]
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in cut]


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_count(text: Column, model_path: str) -> Column:
    """Column of token counts; null and empty texts have none. model_path: a place on every executor."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model_path)
        for batch in batches:
            texts = [t or "" for t in batch]
            out: list[int] = []
            some, size = [], 0
            for t in texts:  # bounded work arrays, whatever the batch holds
                some.append(t)
                size += len(t)
                if size > 1 << 20:
                    out += counter.count(some)
                    some, size = [], 0
            out += counter.count(some) if some else []
            yield pd.Series(out, dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit of each row.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and null ids stay as
    they are, one result a row. Other columns are neither read nor returned.
    An empty table gives an empty table. No shuffle: one narrow pass.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.select(docs[id_col], F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, model_path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
