"""Routing of equal windows of a text to the same place, by minimizers.

Of each window of ``width`` consecutive units the k-gram with the smallest hash
is its anchor; equal windows have equal anchors, so windows need to be compared
only with windows of the same anchor hash. Windows that follow one another
mostly share an anchor: such a run is one segment, and one row stands for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import trim

#: Window starts that are handled at once; positions take 20 bits of the keys that are compared.
CHUNK = 1 << 19
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if not _TABLES or next(iter(_TABLES)) < size:
        _TABLES.clear()
        _TABLES[size] = (_powers(_R, size), _powers(pow(_R, -1, 1 << 64), size))
    up, down = next(iter(_TABLES.values()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.r_[x, np.full(pad, _MASK, np.uint64)].reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(values: np.ndarray, ends: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of a batch: anchor hash, content hash, first and last window start, all in batch positions.

    values: the units of all texts of the batch, one text after another, as
    64-bit values; ends: where each text ends. A window never crosses an end.
    """
    n = len(values)
    for at in range(0, max(0, n - width + 1), CHUNK):
        part = values[at : at + CHUNK + width - 1]
        if len(part) < width:
            break
        prefix = Prefix(part)
        grams = mix(prefix.grams(k))
        keys = grams & ~np.uint64((1 << 20) - 1) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(keys, width - k + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.arange(len(anchor))
        first_end = ends[np.searchsorted(ends, at + starts, "right").clip(max=len(ends) - 1)]
        ok = at + starts + width <= first_end
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | ~ok[:-1]] & ok
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.r_[True, (anchor[1:] != anchor[:-1]) | ~ok[1:]]
        last = np.flatnonzero(np.r_[stop[1:], True] & ok)
        content = mix(prefix.hash(first, last + width) + np.uint64(1) + (last - first).astype(np.uint64) * np.uint64(_R))
        yield grams[anchor[first]], content, at + first, at + last


def ranges(width: int, k: int) -> list[int]:
    """Sizes of the ranges of window starts into which :func:`finer` cuts segments, step by step, down to single windows."""
    return [1 << e for e in range((width - k).bit_length() - 1, -1, -1)]


def finer(values: np.ndarray, offs: np.ndarray, h: np.ndarray, at: np.ndarray, width: int, k: int, size: int) -> tuple[np.ndarray, ...]:
    """Segments cut where their windows begin another range of ``size`` places before the anchor.

    Of each piece: row, anchor hash, content hash, first and last window start, place
    of the k-gram that was the anchor, all in batch positions. All windows of a
    range have more units in common than the k-gram, and these are the piece's
    anchor: equal windows have equal ones, and pieces of one window are equal.
    at: place of the k-gram in each segment, or -1 to look for it.
    """
    prefix, length = Prefix(values), np.diff(offs)
    row = np.repeat(np.arange(len(h)), length)
    grams = mix(prefix.grams(k))
    hit = np.flatnonzero(grams == h[row[: len(grams)]])
    first = np.unique(row[hit], return_index=True)
    at = at.copy()
    unknown = at[first[0]] < 0
    at[first[0][unknown]] = (hit[first[1]] - offs[first[0]])[unknown]
    least, most = (at - (length - width)) // size, at // size
    pieces = most - least + 1
    own = np.repeat(np.arange(len(h)), pieces)
    lo = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + least[own]) * size
    hi = np.minimum(lo + size - 1, width - k)
    place = offs[own] + at[own]
    start, last = np.maximum(offs[own], place - hi), np.minimum(offs[own] + length[own] - width, place - lo)
    anchor = mix(prefix.hash(place - lo, place - hi + width) + lo.astype(np.uint64) * np.uint64(_R) + np.uint64(size))
    content = mix(prefix.hash(start, last + width) + np.uint64(1) + (last - start).astype(np.uint64) * np.uint64(_R))
    return own, anchor, content, start, last, place


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary column, one text after another, and the offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc_id, tag, text) with null texts as empty ones; carry: and row, a struct of all columns but the text.

    Rows are told apart by id, and by a 128-bit hash of their text only where
    ids repeat or are null; rows that agree in both are alike, and so are their
    results. Ids are integers.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")] if carry else []))
    twice = plain.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count()
    tag = F.md5(F.col("text").cast("binary")) if twice else F.lit("")
    return plain.select("doc_id", tag.alias("tag"), "text", *(["row"] if carry else []))


SEGMENT = "h long, c long, doc_id long, tag string, s1 int, s2 int, again array<int>"


def alike(row: np.ndarray, h: np.ndarray, c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Places of the first of equal segments of each text, and where the others begin (null: there are none)."""
    order = np.lexsort((first, c, h, row))
    r, a, b = row[order], h[order], c[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    head = np.flatnonzero(new)
    others = np.diff(np.r_[head, len(order)]) - 1
    again = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(others)].astype(np.int32)), pa.array(first[order][~new].astype(np.int32)), mask=pa.array(others == 0))
    return order[head], again


def occurrences() -> Column:
    """How many segments a row stands for."""
    return F.lit(1) + F.coalesce(F.size("again"), F.lit(0))


def spans(width: int) -> Column:
    """Stretches that the segments of a row cover."""
    length = F.col("s2") - F.col("s1") + width
    starts = F.concat(F.array("s1"), F.coalesce("again", F.array().cast("array<int>")))
    return F.transform(starts, lambda x: F.struct(x.alias("start"), (x + length).alias("stop"))).alias("spans")


def segment_rows(docs: DataFrame, units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, k: int) -> DataFrame:
    """One row for each different segment of every text of a keyed table; starts count units within the text.

    again: where else in the text the same segment begins, so that a text that
    repeats one word a thousand times sends a few rows, not thousands.

    units: of bytes and offsets, the unit values and the offsets of the texts in units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column("text"))
            values, offs = units(data, offs)
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for h, c, first, last in segments(values, offs[1:], width, k):
                row = np.searchsorted(offs, first, "right") - 1
                one, again = alike(row, h, c, first - offs[row])
                row, h, c, first, last = (x[one] for x in (row, h, c, first, last))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), ids.take(at), tags.take(at), pa.array((first - offs[row]).astype(np.int32)), pa.array((last - offs[row]).astype(np.int32)), again],
                    names=["h", "c", "doc_id", "tag", "s1", "s2", "again"],
                )
        trim()

    return docs.select("doc_id", "tag", "text").mapInArrow(run, SEGMENT)


def null_safe(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, tag), nulls equal; right's key columns go."""
    right = right.withColumnsRenamed({"doc_id": "doc_id_r", "tag": "tag_r"})
    # the coalesced key is an equi-join even without null-safe hashing support
    return left.join(right, left["doc_id"].eqNullSafe(right["doc_id_r"]) & (left["tag"] == right["tag_r"]), how).drop("doc_id_r", "tag_r")
