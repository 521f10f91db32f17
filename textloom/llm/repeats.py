"""Exact removal of repeated byte strings by threshold-bounded interval expansion.

Segments that share an anchor (see :mod:`textloom.llm.anchors`) are the only
places where a string of the least length can repeat. Equal segments are
counted, one row each; the different segments of an anchor meet in a block.
A block is indexed by the Burrows-Wheeler transform of its segments, and a
breadth-first backward extension, from the empty string by one byte a level,
derives the common prefixes of neighbouring suffixes in increasing order. It
ends at the least length: boundaries not reached by then lie inside repeats.
An anchor with too many different segments for a block is split: its segments
are cut into ranges of windows, which have a longer anchor in common.

Segments are taken for equal if 128 bits of hashes, of anchor and content, are:
among 10^12 segments two that differ agree with a chance under 10^-14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.anchors import finer, keyed, mix, null_safe, occurrences, ranges, segment_rows, spans, strings
from textloom.llm.common import bound_batches, materialize, trim

#: Length of a repeated string, and of the k-grams that anchor it.
LEAST, GRAM = 200, 32
#: Different segments of one anchor that a block takes; beyond it the anchor is split.
CROWD = 3_000
#: Bytes of a block.
BLOCK = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[data], offs


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by doubling. text: values below 2^9."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    padded = np.r_[text.astype(np.uint64), np.zeros(8, np.uint64)]
    for j in range(7):
        key = key << np.uint64(9) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 7
    while done < depth:
        alone = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        some = order[slots]
        after = some + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[some].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[slots] = some[by]
        key = key[by]
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[slots] |= fresh
        rank[some[by]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        done *= 2
    return order


def interval_bounds(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, where below ``least``; else -1.

    order needs to hold for the first ``least`` symbols only: a level compares no more.
    """
    n = len(text)
    bwt = text[order - 1]  # the text is taken as a cycle: its first symbol follows the last
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    same = bwt[by][1:] == bwt[by][:-1]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[by[:-1][same]], before[by[1:][same]] = by[1:][same], by[:-1][same]
    bound = np.full(n + 1, -1, np.int16)
    bound[0] = bound[n] = 0
    low, high = np.array([0]), np.array([n - 1])
    for level in range(least):
        if not len(low):
            break
        size = high - low + 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
        first = np.sort(lf[at[before[at] < np.repeat(low, size)]])
        last = np.sort(lf[at[after[at] > np.repeat(high, size)]])
        unset = bound[last + 1] < 0
        low, high = first[unset], last[unset]
        bound[high + 1] = level
    return bound


def repeated_starts(parts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """Of each part, the starts of strings of the least length that also start elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.zeros(int(sizes.sum()) + len(parts), np.int16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    order = suffix_order(text, least + 1)
    bound = interval_bounds(text, order, least)
    again = (bound[:-1] < 0) | (bound[1:] < 0)
    start = order[again]
    start = np.sort(start[start + least <= (begin + sizes)[owner[start]]])
    cut = np.searchsorted(start, begin)
    return [s - b for s, b in zip(np.split(start, cut[1:]), begin, strict=True)]


def runs(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches that the windows at sorted starts cover."""
    if not len(starts):
        return []
    new = np.r_[True, starts[1:] > starts[:-1] + least]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return list(zip(starts[first].tolist(), (starts[last] + least).tolist(), strict=True))


SPAN = "doc_id long, tag string, spans array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def span_batch(found: list[tuple[int | None, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    """(doc_id, tag, spans) rows."""
    flat = [x for _, _, own in found for x in own]
    at = np.array(flat, np.int32).reshape(-1, 2)
    both = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["start", "stop"])
    ends = np.cumsum([0, *(len(own) for _, _, own in found)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), both).cast(_SPANS)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.string()), lists], names=["doc_id", "tag", "spans"])


def _blocks(least: int):
    """Blocks of whole anchor groups, from rows that are sorted by anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[4] for r in rows], least)
        out = [(r[1], r[2], [(r[3] + a, r[3] + b) for a, b in runs(starts, least)]) for r, starts in zip(rows, found, strict=True) if not r[5] and len(starts)]
        return span_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "tag", "s1", "seg", "known")), strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)
        held = []
        trim()

    return run


def _cut_out(width: int):
    """Segment bytes of the requests of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column("text"))
            raw = data.tobytes()
            out: list[list] = [[] for _ in range(7)]
            for k, (i, t, asked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                base = int(offs[k])
                for a in asked or ():
                    for o, v in zip(out, (a["h"], i, t, a["s1"], raw[base + a["s1"] : base + a["s2"] + width], a["known"], a["crowded"]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()), strict=True)], names=["h", "doc_id", "tag", "s1", "seg", "known", "crowded"])

    return run


PART = "h long, c long, doc_id long, tag string, s1 int, at int, seg binary, known boolean"


def _finer(least: int, gram: int, size: int):
    """Pieces of crowded segments, see :func:`textloom.llm.anchors.finer`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column("seg"))
            if not len(data):
                continue
            row, h, c, first, last, place = finer(_BYTE[data], offs, batch.column("h").to_numpy().view(np.uint64), np.asarray(batch.column("at"), np.int64), least, gram, size)
            raw, take = data.tobytes(), pa.array(row)
            seg = [raw[a : b + least] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            s1 = np.asarray(batch.column("s1"))[row] + first - offs[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), *(batch.column(x).take(take) for x in ("doc_id", "tag")), pa.array(s1.astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(seg, pa.binary()), batch.column("known").take(take)], names=["h", "c", "doc_id", "tag", "s1", "at", "seg", "known"])

    return run


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted, maybe touching spans."""
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeat_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, tag, spans) of stretches to remove from a keyed table; they may overlap or repeat."""
    rows = segment_rows(docs, byte_units, least, gram)
    dup = rows.groupBy("h").agg(F.sum(occurrences()).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1").select("h", (F.col("c1") == F.col("c2")).alias("same"))
    dup = materialize(dup, "repeated")  # so that both sides of the join are plain shuffles, which can be split by skew
    cand = materialize(rows.join(dup, "h"), "anchors")
    mixed = cand.where(~F.col("same"))
    kinds = mixed.groupBy("h", "c").agg(F.sum(occurrences()).alias("n"), F.min(F.struct("doc_id", "tag", "s1", "s2")).alias("one"))
    kinds = materialize(kinds, "kinds")
    known = kinds.where("n > 1").select("h", "c")
    span = ("doc_id", "tag", spans(least))
    sure = cand.where("same").select(*span).unionByName(mixed.join(known, ["h", "c"]).select(*span))
    crowds = materialize(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd).select("h", F.lit(True).alias("crowded")), "crowds")
    asked = kinds.join(crowds, "h", "left").select("one.doc_id", "one.tag", F.struct("h", "one.s1", "one.s2", (F.col("n") > 1).alias("known"), F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("ask"))
    asked = asked.groupBy("doc_id", "tag").agg(F.collect_list("ask").alias("asked"))
    got = null_safe(docs, asked).mapInArrow(_cut_out(least), "h long, doc_id long, tag string, s1 int, seg binary, known boolean, crowded boolean")
    got = materialize(got, "segments").withColumn("at", F.lit(-1))
    block = ("h", "doc_id", "tag", "s1", "seg", "known")
    solved = lambda rows: rows.repartition("h").sortWithinPartitions("h").select(*block).mapInArrow(_blocks(least), SPAN)
    out, left = sure.unionByName(solved(got.where(~F.col("crowded")))), got.where("crowded")
    for size in ranges(least, gram):
        if left.isEmpty():
            break
        parts = materialize(left.select(*block, "at").mapInArrow(_finer(least, gram, size), PART), "parts")
        kinds = parts.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"), F.min(F.struct("doc_id", "tag", "s1", "at", "seg")).alias("one"))
        kinds = materialize(kinds, "part-kinds")
        whole = F.array(F.struct(F.col("s1").alias("start"), (F.col("s1") + F.length("seg")).alias("stop"))).alias("spans")
        again = parts.where(~F.col("known")).select("h", "c", "doc_id", "tag", whole).join(kinds.where("n > 1").select("h", "c"), ["h", "c"])
        groups = materialize(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "part-groups")
        rows = kinds.join(groups, "h").select("h", "one.*", (F.col("known") | (F.col("n") > 1)).alias("known"), "m")
        left = materialize(rows.where(F.col("m") > crowd), "crowded")
        out = out.unionByName(again.select("doc_id", "tag", "spans")).unionByName(solved(rows.where(F.col("m") <= crowd)))
    return out


def gathered(found: DataFrame) -> DataFrame:
    """All spans of each text."""
    return found.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = strings(batch.column("text"))
        raw = data.tobytes()
        kept, counts = [], []
        for k, own in enumerate(batch.column("spans").to_pylist()):
            text = raw[offs[k] : offs[k + 1]]
            cut = merged(sorted({(x["start"], x["stop"]) for x in own or ()}))
            out, at = [], 0
            for a, b in cut:
                out.append(text[at:a])
                at = b
            out.append(text[at:])
            kept.append(b"".join(out))
            counts.append((len(text), sum(b - a for a, b in cut), len(cut)))
        cols = np.array(counts, np.int64).reshape(-1, 3)
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *map(pa.array, cols.T), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for done in _removed(iter([batch])):
            text = pa.array([x.decode("utf-8", "ignore") for x in done.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), done.column("n_removed"), text], names=["row", "n_removed", "text"])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with repeated strings cut from their texts, and with them what is left of a cut character.

    Rows of which nothing but blanks remains go; others keep all columns.
    """
    bound_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col, carry=True)
    found = gathered(repeat_spans(own.drop("row"), least))
    row = own.schema["row"].dataType.simpleString()
    out = null_safe(own, found, "left").select("doc_id", "tag", "text", "spans", "row").mapInArrow(_rewritten, f"row {row}, n_removed long, text string")
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (texts) kept, the bytes that remain, of each row.

    A byte goes if a string of ``least`` bytes around it also starts anywhere
    else in the table. Null texts count as empty, empty and short texts have
    nothing removed. Rows that repeat whole are documents of their own, so
    their texts go; ids may be null or repeat. Ids are integers. An empty
    table gives an empty table; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    found = gathered(repeat_spans(own, least))
    out = null_safe(own, found, "left").mapInArrow(_removed, "doc_id long, tag string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").drop("tag")
    return out if texts else out.drop("kept")
