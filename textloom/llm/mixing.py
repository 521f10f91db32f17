"""Mixing sources to target weights by proportionate-fair scheduling.

Documents of a source are shuffled by hash and cut into blocks. In the ideal mix
source s has given ``min(n, w * v)`` of its n blocks at virtual time v, and slot
t is the v at which all sources together have given t; a source that has run
out leaves its share to the others. Block i is released in the slot in which the
ideal mix begins it and due in the one in which it ends it. Giving out, in every
slot, the released block with the earliest deadline meets all of these, so that
no source is ever a whole block off its share. Weights are whole numbers of any
size, so that releases and deadlines are exact; there is no period.

The slots are cut into stretches that are scheduled apart. For that one needs to
know how many blocks each source has given at a cut: its ideal count, rounded
down or up. Tasks work out which slots of a stretch stay free beside the blocks
that begin and end in it, few for each source; from these the driver follows the
blocks that lie across cuts, the earliest deadline first, one bit for each source
and cut. With both ends known, tasks schedule the stretches.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import bounded, materialize
from textloom.session import ship

#: Documents of a block, slots of a stretch (64 for each source at least), and sources that one mix can have.
BLOCK, STRETCH, MOST_SOURCES = 32, 1 << 16, 10_000
#: Tasks that share the stretches.
TASKS = 10_000


class Ideal:
    """The ideal mix of sources of so many blocks and so much weight, all above 0, in the order in which they run out."""

    def __init__(self, sizes: list[int], weights: list[int]):
        order = sorted(range(len(sizes)), key=lambda k: Fraction(sizes[k], weights[k]))
        self.order = order
        self.n, self.w = [sizes[k] for k in order], [weights[k] for k in order]
        self.done = list(accumulate(self.n, initial=0))
        self.rest = list(accumulate(reversed(self.w), initial=0))[::-1]
        # the last slot before which no more than the sources ahead of it have run out
        self.ends = [self.done[k] + self.n[k] * self.rest[k] // self.w[k] for k in range(len(order))]
        self.slots = self.done[-1]

    def _phase(self, s: int, i: int) -> int:
        """Sources that have run out when s begins its block i."""
        n, w, own = self.n, self.w, self.w[s]
        return bisect_left(range(s), True, key=lambda k: n[k] * own >= i * w[k])

    def release(self, s: int, i: int) -> int:
        k = self._phase(s, i)
        return self.done[k] + i * self.rest[k] // self.w[s]

    def deadline(self, s: int, i: int) -> int:
        k = self._phase(s, i + 1)
        return self.done[k] - -(i + 1) * self.rest[k] // self.w[s]

    def begun(self, t: int) -> tuple[int, list[int], list[bool]]:
        """Sources that have run out before slot t; whole blocks that each of the others has given, and whether it is within a block."""
        k = bisect_left(self.ends, t)
        v, whole = t - self.done[k] if k < len(self.n) else 0, self.rest[k]
        both = [divmod(w * v, whole) for w in self.w[k:]]
        return k, [q for q, _ in both], [r > 0 for _, r in both]

    def free(self, start: int, stop: int) -> list[int]:
        """Slots of a stretch that stay free when the blocks released and due within it are given out: two for each source at most."""
        first, whole, within = self.begun(start)
        last, due, _ = self.begun(stop)
        due = self.n[first:last] + due
        times = [self.release(first + j, i) for j, q in enumerate(whole) for i in range(q + within[j], due[j])]
        # each takes the first slot that is not taken, so that the releases alone tell which slots are
        turn = np.arange(len(times))
        taken = turn + np.maximum.accumulate(np.sort(np.array(times, np.int64)) - turn) if times else turn
        return np.setdiff1d(np.arange(start, stop), taken, assume_unique=True).tolist()

    def given(self, start: int, stop: int, before: list[int], free: list[int]) -> list[int]:
        """Blocks that each source has given at the end of a stretch, earliest deadline first, from those at its begin."""
        first, whole, within = self.begun(start)
        # blocks begun before the stretch and due within it take the first free slots
        late = sum(x and before[first + j] == whole[j] and self.deadline(first + j, whole[j]) <= stop for j, x in enumerate(within))
        free = free[late:]
        first, whole, within = self.begun(stop)
        out = self.n[:first] + whole
        some = sorted((self.deadline(first + j, whole[j]), first + j) for j, x in enumerate(within) if x and before[first + j] <= whole[j])
        for j, x in enumerate(within):
            out[first + j] += x and before[first + j] > whole[j]
        for _, s in some:
            at = bisect_left(free, self.release(s, out[s]))
            if at < len(free):
                del free[at]
                out[s] += 1
        return out

    def stretches(self, length: int, slots: int | None = None) -> list[tuple[int, int]]:
        slots, length = self.slots if slots is None else slots, max(length, 1)
        return [(a, min(a + length, slots)) for a in range(0, slots, length)]

    def cuts(self, free: list[tuple[int, int, list[int]]]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """First slot and end of each stretch, and which sources are rounded up there, a bit each; free: the stretches in order."""
        before = [0] * len(self.n)
        bits = self._bits(0, before)
        for start, stop, slots in free:
            before = self.given(start, stop, before, slots)
            after = self._bits(stop, before)
            yield start, stop, bits, after
            bits = after

    def _bits(self, t: int, given: list[int]) -> bytes:
        first, whole, _ = self.begun(t)
        return np.packbits(np.array([g > q for g, q in zip(given, self.n[:first] + whole, strict=True)], bool)).tobytes()

    def _counts(self, t: int, bits: bytes) -> list[int]:
        first, whole, _ = self.begun(t)
        up = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(self.n)).tolist()
        return [q + x for q, x in zip(self.n[:first] + whole, up, strict=True)]

    def schedule(self, start: int, stop: int, bits: bytes, after: bytes) -> Iterator[tuple[int, int]]:
        """Source (as numbered when made) and block of each slot of a stretch: of the released blocks that with the earliest deadline."""
        given, last = self._counts(start, bits), self._counts(stop, after)
        waiting = [(max(start, self.release(s, g)), s) for s, g in enumerate(given) if g < last[s]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int]] = []
        for slot in range(start, stop):
            while waiting and waiting[0][0] <= slot:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (min(stop, self.deadline(s, given[s])), s))
            s = heapq.heappop(ready)[1]
            yield self.order[s], given[s]
            given[s] += 1
            if given[s] < last[s]:
                heapq.heappush(waiting, (self.release(s, given[s]), s))


def whole_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Weights in proportion, as whole numbers, exactly; none is negative or endless."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights are 0 at least")
    scale = lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * scale) for s, w in exact.items()}
    least = gcd(*out.values()) or 1
    return {s: w // least for s, w in out.items()}


def ideals(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> list[tuple[int, list[str | None], Ideal]]:
    """First slot, sources and ideal mix of those with a weight, then of the others, evenly."""
    exact = whole_weights({s: weights.get(s, 0) for s, n in blocks.items() if n > 0})
    base, out = 0, []
    for names in ([s for s in exact if exact[s]], [s for s in exact if not exact[s]]):
        if names:
            names.sort(key=lambda s: (s is not None, s or ""))
            out.append((base, names, Ideal([blocks[s] for s in names], [exact[s] or 1 for s in names])))
            base += out[-1][2].slots
    return out


def tempered(counts: Mapping[str | None, int], power: float) -> dict[str | None, float]:
    """Weights in proportion to a power of the sizes, to a millionth: 1 keeps the mix, 0 evens it."""
    return {s: max(1, round(1e6 * float(n) ** power)) for s, n in counts.items() if n > 0}


def _freed(plan: list[tuple[int, list[str | None], Ideal]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, start, stop in batch[["part", "start", "stop"]].itertuples(index=False):
                yield pd.DataFrame({"part": [part], "start": [start], "stop": [stop], "free": [plan[part][2].free(start, stop)]})

    return run


def _scheduled(plan: list[tuple[int, list[str | None], Ideal]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, start, stop, bits, after in batch[["part", "start", "stop", "bits", "after"]].itertuples(index=False):
                base, names, ideal = plan[part]
                rows = list(ideal.schedule(start, stop, bits, after))
                yield pd.DataFrame({"of": [names[s] for s, _ in rows], "b": [b for _, b in rows], "mix_slot": np.arange(base + start, base + stop)})

    return run


def slots_of(spark: SparkSession, plan: list[tuple[int, list[str | None], Ideal]], stretch: int) -> DataFrame:
    """(of, b, mix_slot): the slot of every block of every source."""
    pieces = [(part, *cut) for part, (_, _, ideal) in enumerate(plan) for cut in ideal.stretches(max(stretch, 64 * len(ideal.n)))]
    tasks = max(1, min(len(pieces), TASKS))
    todo = spark.createDataFrame(pieces, "part int, start long, stop long").repartition(tasks, "part", "start")
    found = sorted((r["part"], r["start"], r["stop"], r["free"]) for r in todo.mapInPandas(_freed(plan), "part int, start long, stop long, free array<long>").collect())
    cuts = [(part, *cut) for part, (_, _, ideal) in enumerate(plan) for cut in ideal.cuts([x[1:] for x in found if x[0] == part])]
    todo = spark.createDataFrame(cuts, "part int, start long, stop long, bits binary, after binary").repartition(tasks, "part", "start")
    return todo.mapInPandas(_scheduled(plan), "of string, b long, mix_slot long")


def interleave(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block: int = BLOCK, stretch: int = STRETCH, id_col: str = "doc_id", source_col: str = "source", seed: int = 0) -> DataFrame:
    """docs with mix_block (within its source), mix_slot and mix_offset (within the block); ordered by the last two they are mixed.

    weights: target of each source, default the tempered sizes; sources without
    one come, evenly, when all others have run out. At every slot each source
    has given its share of the ideal mix to less than one block. A null source
    is a source. Repeated rows and null ids are rows like any other; an empty
    table stays empty; columns with the three names are replaced. More than
    MOST_SOURCES sources raise ValueError. No source is ranked in one task: rows
    are dealt by range of (source, hash), and ranks are places in a range plus
    what came before; and none is scheduled in one task, but every ``stretch``.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_offset")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.xxhash64(*kept).alias("h2"))
    rows = rows.repartitionByRange("source", "h", "h2").sortWithinPartitions("source", "h", "h2").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.select("row", "source", "at", F.shiftright("at", 33).alias("part")), "ranges")
    pieces = rows.groupBy("part", "source").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = materialize(pieces.withColumn("before", F.coalesce(before, F.lit(0))), "pieces")
    sizes = pieces.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r["source"]: r["n"] for r in sizes}
    plan = ideals({s: -(-n // block) for s, n in counts.items()}, tempered(counts, power) if weights is None else weights)
    blocks = slots_of(spark, plan, stretch)
    # at most one row for each range and source, and ranges hold sources in order: as many as ranges and sources
    pieces = pieces.select(F.col("part").alias("p"), F.col("source").alias("s"), "least", "before")
    ranked = rows.join(bounded(pieces, pieces.count()), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rank = F.col("at") - F.col("least") + F.col("before")
    ranked = ranked.select("row", "source", F.floor(rank / block).cast("long").alias("mix_block"), (rank % block).cast("int").alias("mix_offset"))
    out = ranked.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("mix_block") == F.col("b")))
    return out.select("row.*", "mix_block", "mix_slot", "mix_offset")
