"""Near-duplicate documents: MinHash signatures joined by Hamming distance in several indexes.

A signature has SLOTS values of 16 bits. Cut into CHUNKS pieces, two signatures
that differ in fewer slots than there are pieces agree, by the pigeonhole
principle, in a whole piece; each piece is an index. Where more slots may differ
and whole pieces would not do, keys leave out one or two slots of a piece in
every way, which allows for as many errors in each. Every pair within the
distance that is so guaranteed meets in a bucket; of pairs that meet, those are
followed whose distance a pair of the least similarity exceeds with a chance of
MISS at most.

What so stays apart is looked for again, surely: sets are cut by a hash of the
shingle into more parts than may differ, so that two similar sets have whole
parts in common (the same index, on the sets themselves). Sets of different
components that share a part are compared by parities, which bound the shingles
that differ from below, and then on full shingle sets.

Equal sets are one node. Of the pairs in reach of a bucket a spanning forest is
kept, so that rows grow with the nodes and not with the pairs. The forests join
nodes to groups, outside of which no pair is in reach. Within a group, pairs in
reach are confirmed on full shingle sets, the nearest first; a pair is skipped
only where it is in one component already.

A bucket or group that is too large for a task is dealt into blocks, twice and
each time anew, and what the blocks link is joined. Only nodes that are then in
different components still have to meet: blocks of one component do not meet one
another, all others do. A cluster of copies is therefore done without its blocks
having to meet, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.anchors import Prefix, keyed, mix, null_safe, strings
from textloom.llm.common import bound_batches, bounded, materialize, settled, swept, trim

SLOTS, CHUNKS = 66, 22
#: Slots that may differ so that whole pieces are sure to agree somewhere.
REACH = CHUNKS - 1
#: Chance that a pair at the least similarity agrees in no piece, or differs in more slots than are followed.
MISS = 2e-7
#: Words of a shingle.
WORDS = 5
#: Nodes and shingles of a block of a group.
SHARE, SHARE_SHINGLES = 800, 1_000_000
#: Nodes of a block of a bucket.
CROWD = 512
#: Growth of the sizes of sets that are cut into equally many parts, and shingles that may differ for each spare part.
GROWTH, SPARE = 1.35, 16
#: Bits of the parities of a set at least.
LEAST_BITS = 1024
#: Times that crowded keys are dealt into blocks at first.
DEALS = 2
_SEED = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_MUL, _ADD = _SEED[:SLOTS] | np.uint64(1), _SEED[SLOTS:]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FOLD = mix(np.arange(257, 257 + 64, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_values(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each word (bytes other than blank and 09-0D) of a batch, and the offsets of its texts in words."""
    value, start, _, word_offs = located_words(data, offs, lower)
    return value, word_offs


def located_words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, first bytes and ends of the words, and the offsets of the texts in words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # a word ends where its text ends
    before = np.r_[False, inside[:-1]] & ~edge[:n]
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] & ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    value = np.empty(len(start), np.uint64)
    step = 1 << 19  # stretches, so that work arrays stay small
    for a in range(0, len(start), step // 4):
        b = min(len(start), a + step // 4)
        lo, hi = start[a], end[b - 1]
        prefix = Prefix(_BYTE[data[lo:hi]])
        value[a:b] = mix(prefix.hash(start[a:b] - lo, end[a:b] - lo) + (end[a:b] - start[a:b]).astype(np.uint64))
    return value, start, end, np.searchsorted(start, offs)


def shingles(values: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text, with repeats, and their offsets: runs of ``size`` words, a shorter text whole."""
    counts = np.diff(offs)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offs = np.r_[0, np.cumsum(out_counts)]
    row = np.repeat(np.arange(len(counts)), out_counts)
    at = offs[row] + np.arange(out_offs[-1]) - out_offs[row]
    padded = np.r_[values, np.zeros(size, np.uint64)]
    total = np.zeros(len(at), np.uint64)
    length = np.minimum(counts[row], size)
    for j in range(size):
        total += np.where(j < length, padded[at + j] * (_FOLD[j] | np.uint64(1)), np.uint64(0))
    return mix(total + length.astype(np.uint64) * _FOLD[40]), out_offs


def text_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    values, word_offs = word_values(data, offs, lower=True)
    grams, gram_offs = shingles(values, word_offs, size)
    return [np.unique(grams[a:b]) for a, b in zip(gram_offs[:-1], gram_offs[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, CHUNKS) pieces of three 16-bit slots each; the sets are not empty."""
    out = np.empty((len(sets), SLOTS), np.uint64)
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    for k in range(SLOTS):
        out[:, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], at)
    slots = (mix(out) & np.uint64(0xFFFF)).reshape(len(sets), CHUNKS, SLOTS // CHUNKS)
    pieces = np.zeros((len(sets), CHUNKS), np.uint64)
    for j in range(SLOTS // CHUNKS):
        pieces |= slots[:, :, j] << np.uint64(16 * j)
    return pieces.view(np.int64)


SIGNED = "doc_id long, tag string, n long, f1 long, f2 long, sig array<long>"


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column("text"))
            sets = text_sets(data, offs, size)
            some = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for a in range(0, len(some), 256):
                part = some[a : a + 256]
                for k, row in zip(part, signatures([sets[k] for k in part]), strict=True):
                    sig[k] = row
            # two sums over a set are its name
            f1 = _names(sets)
            f2 = np.array([mix(s ^ _FOLD[50]).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2.view(np.int64)), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "tag", "n", "f1", "f2", "sig"])
        trim()

    return run


def index_keys(piece: Column, errors: int) -> Column:
    """Keys of one piece: of its slots all but ``errors``, in every way."""
    out, width = [], SLOTS // CHUNKS
    for drop in combinations(range(width), errors):
        mask = sum(0xFFFF << (16 * j) for j in range(width) if j not in drop)
        out.append(F.xxhash64(F.lit(mask), F.col("chunk"), piece.bitwiseAND(F.lit(mask))))
    return F.array(*out)


class Forest:
    """Union of numbered nodes, some of which may be joined before."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]
        self.size = int(self.label.max(initial=-1)) + 1

    def join(self, p: np.ndarray, q: np.ndarray) -> list[int]:
        """Places of pairs that joined two trees."""
        x, y = self.label[p], self.label[q]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return []
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        first = apart[np.unique(low * np.int64(self.size) + high, return_index=True)[1]]
        top: dict[int, int] = {}

        def find(i: int) -> int:
            root = i
            while (up := top.get(root, root)) != root:
                root = up
            while i != root:
                top[i], i = root, top.get(i, i)
            return root

        made = []
        for k, i, j in zip(first.tolist(), x[first].tolist(), y[first].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                top[max(i, j)] = min(i, j)
                made.append(k)
        new = np.arange(self.size)
        for i in top:
            new[i] = find(i)
        self.label = new[self.label]
        return made


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which signatures (rows of four 16-bit values a piece, the last unused) differ."""
    far = np.zeros((len(x), len(y)), np.uint8)
    for k in range(x.shape[1]):
        if k % 4 < 3:
            far += x[:, k, None] != y[None, :, k]
    return far


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = not held or not same(held[-1], held[-1].num_rows - 1, batch, 0)
        cut = np.flatnonzero(new)
        if not len(cut):
            held.append(batch)
            continue
        if cut[0]:
            held.append(batch.slice(0, int(cut[0])))
        if held:
            yield pa.Table.from_batches(held)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        held = [batch.slice(int(cut[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def _signatures_of(t: pa.Table) -> np.ndarray:
    flat = t.column("sig").combine_chunks()
    return np.ascontiguousarray(flat.flatten().to_numpy()).view(np.uint16).reshape(t.num_rows, -1)


#: What a group of rows is: a bucket or group of nodes, two of its parts, and a block of each.
MEET = ("key", "p", "q", "i", "j")


def _tiles(side: np.ndarray, slots: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one block, or of two blocks those across, tile by tile, and their distances; label, which may change, rules out tiles."""
    across = side.min() != side.max()
    for a in range(0, len(side), 256):
        for b in range(a, len(side), 256):
            x, y = label[a : a + 256], label[b : b + 256]
            if x[0] == y[0] and (x == x[0]).all() and (y == y[0]).all():
                continue  # one tree already: a large group costs little more than its first row of tiles
            d = distances(slots[a : a + 256], slots[b : b + 256])
            ok = x[:, None] != y[None, :]
            if across:
                ok &= side[a : a + 256, None] != side[None, b : b + 256]
            i, j = np.nonzero(np.triu(ok, 1) if a == b else ok)
            yield i + a, j + b, d[i, j]


def _forest(reach: int):
    """A spanning forest (a, b) of the pairs of each bucket that are in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        for t in _grouped(batches, MEET):
            if t.num_rows < 2:
                continue
            u, forest = t.column("u").to_numpy(), Forest(t.column("comp").to_numpy())
            label = forest.label.copy()
            for i, j, d in _tiles(t.column("side").to_numpy(), _signatures_of(t), label):
                near = d <= reach
                i, j = i[near], j[near]
                made += [(int(u[i[k]]), int(u[j[k]])) for k in forest.join(i, j)]
                label[:] = forest.label
            if len(made) > 10_000:
                yield _pairs(made)
                made = []
        yield _pairs(made)
        trim()

    return run


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _confirmed(reach: int, percent: int, size: int):
    """Links (a, b) that connect the nodes of a block, or of two, as far as their sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, MEET):
            if t.num_rows < 2:
                continue
            made: list[tuple[int, int]] = []
            u, label = t.column("u").to_numpy(), np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
            sets = [s for c in t.column("text").chunks for s in text_sets(*strings(c), size)]
            sizes = np.array([len(s) for s in sets])
            found = []
            for i, j, d in _tiles(t.column("side").to_numpy(), _signatures_of(t), label):
                # the sizes alone rule out what could not be similar enough
                fit = (d <= reach) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
                found.append((i[fit], j[fit], d[fit]))
            if not found:
                continue
            p, q, far = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(far, kind="stable")
            p, q = p[order], q[order]
            for start in range(0, len(p), 2000):
                x, y = p[start : start + 2000], q[start : start + 2000]
                for i, j in zip(*(z[label[x] != label[y]].tolist() for z in (x, y)), strict=True):
                    if label[i] == label[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        made.append((int(u[i]), int(u[j])))
                        label[label == label[j]] = label[i]
            yield _pairs(made)
        trim()

    return run


def _across(at: DataFrame, labels: DataFrame) -> DataFrame | None:
    """What still has to meet: (key, p, q, i, j, side, u, comp) of nodes of a key, as far as they are in different components, if there are any.

    at: (key, u, cost), where costs up to 1 make a block; labels: (u, comp). Nodes of a
    component that fills a block are a part, all other nodes of the key one (p
    or q -1); every two parts meet, block by block, and the last one itself.
    """
    own = at.join(labels, "u", "left").select("key", "u", "cost", F.coalesce("comp", "u").alias("comp"))
    several = own.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
    several = materialize(several, "several")
    if several.isEmpty():
        return None
    own = materialize(own.join(several, "key", "left_semi"), "apart")
    sums = own.groupBy("key", "comp").agg(F.sum("cost").alias("c"))
    great = materialize(sums.where("c >= 1").select("key", "comp", F.ceil("c").cast("int").alias("k")), "great")
    small = sums.where("c < 1").groupBy("key").agg(F.ceil(F.sum("c")).cast("int").alias("k"))
    parts = materialize(great.select("key", F.col("comp").alias("part"), "k").unionByName(small.select("key", F.lit(-1).cast("long").alias("part"), "k")), "parts")
    one, two = (parts.select("key", F.col("part").alias(x), F.col("k").alias(f"k{x}")) for x in ("p", "q"))
    meet = materialize(one.join(two, "key").where("p < q OR (p = -1 AND q = -1)"), "meet")
    rows, pairs = great.count(), meet.count()
    # a node's part and its block there
    own = own.join(bounded(great.withColumnRenamed("k", "kg"), rows), ["key", "comp"], "left").withColumn("part", F.when(F.col("kg").isNull(), F.lit(-1)).otherwise(F.col("comp")).cast("long"))
    meet = bounded(meet, pairs)
    block = lambda k: F.pmod(F.xxhash64("u", "key"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = own.join(meet, (own["key"] == meet["key"]) & (own["part"] == meet["p"])).drop(meet["key"]).select("key", "p", "q", "u", "comp", block("kp").alias("x"), every("kq").alias("y"))
    same = F.col("p") == F.col("q")
    left = left.select("key", "p", "q", F.when(same, F.least("x", "y")).otherwise(F.col("x")).alias("i"), F.when(same, F.greatest("x", "y")).otherwise(F.col("y")).alias("j"), F.when(same & (F.col("x") > F.col("y")), 1).otherwise(0).alias("side"), "u", "comp")
    right = own.join(meet, (own["key"] == meet["key"]) & (own["part"] == meet["q"]) & (meet["p"] < meet["q"])).drop(meet["key"]).select("key", "p", "q", "u", "comp", every("kp").alias("i"), block("kq").alias("j"))
    return left.unionByName(right.withColumn("side", F.lit(1)))


def _met(rows: DataFrame, task, label: str) -> DataFrame:
    """The links (a, b) that the task finds in groups of rows."""
    # so many tasks, however few bytes: the work lies in the pairs
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *MEET).sortWithinPartitions(*MEET)
    return materialize(rows.mapInArrow(task, "a long, b long").distinct(), label)


def _links(at: DataFrame, attach, task, label: str) -> DataFrame:
    """(a, b) that join the nodes of each key to the components that the task's links give them.

    at: (key, u, cost), where costs up to 1 make a block; attach: adds to rows with u what the
    task reads. A key of one block is done at once; others are dealt DEALS times
    into blocks, and then what is still apart meets.
    """
    sums = at.groupBy("key").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    sums = materialize(sums.select("key", F.greatest(F.lit(1), F.ceil(F.col("c") - 1e-6)).cast("int").alias("k")), f"{label}-sizes")
    deals = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(DEALS)))))
    shared = materialize(at.join(sums, "key"), f"{label}-shared")
    rows = shared.select("key", "u", "k", deals.alias("deal"))
    block = F.pmod(F.xxhash64("u", "key", "deal"), F.col("k")).cast("int")
    first = _met(attach(rows.select("key", F.lit(-2).cast("long").alias("p"), F.col("deal").cast("long").alias("q"), block.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "u", F.col("u").alias("comp"))), task, label)
    great = shared.where("k > 1").select("key", "u", "cost")
    if great.isEmpty():
        return first
    left = _across(great, components(first))
    return first if left is None else first.unionByName(_met(attach(left), task, label))


def _local_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of every node of the links of a partition, root being the smallest node that they reach."""
    got = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not got:
        return
    nodes, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["u", "root"])


#: Links that one task joins to trees.
LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(u, comp) of every node of a link, comp being the smallest node of its component.

    Tasks of up to LINKS links or so join these to trees; a node that has several roots
    links these, and such links, far fewer, go into the next round. Where they
    do not become fewer by half, components hook onto their smallest neighbour
    instead, which halves them surely.
    """
    edges, size = links.select("a", "b"), None
    left = edges.count()
    rounds: list[DataFrame] = []
    while True:
        trees = edges.coalesce(-(-left // LINKS) or 1).mapInArrow(_local_trees, "u long, root long")
        # no more roots for a node than there are partitions
        trees = trees.groupBy("u").agg(F.min("root").alias("comp"), F.collect_set("root").alias("roots"))
        trees = materialize(trees, "trees")
        rounds.append(trees)
        edges = trees.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("comp").alias("b")).where("a <> b")
        left = edges.count()
        if not left:
            break
        if size is not None and 2 * left > size:
            rounds.append(_hooked(edges))
            break
        size = left
    labels = rounds[0].select("u", "comp")
    for later in rounds[1:]:
        later = later.select(F.col("u").alias("comp"), F.col("comp").alias("to"))
        labels = labels.join(later, "comp", "left").select("u", F.coalesce("to", "comp").alias("comp"))
    return materialize(labels, "labels") if len(rounds) > 1 else labels


def _hooked(links: DataFrame) -> DataFrame:
    """(u, comp) by hooking, round by round: the number of components that still have links halves at least."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "u"), "labels")
    while True:
        la, lb = labels.select(F.col("u").alias("a"), F.col("comp").alias("x")), labels.select(F.col("u").alias("b"), F.col("comp").alias("y"))
        cut = links.join(la, "a").join(lb, "b").where("x <> y").select("x", "y")
        # a label may itself have a smaller label by now
        jump = labels.join(labels.select(F.col("u").alias("x"), F.col("comp").alias("y")), F.col("comp") == F.col("x")).where("x <> y").select("x", "y")
        cut = materialize(cut.unionByName(jump).distinct(), "cut")
        if cut.isEmpty():
            return labels
        sides = cut.unionByName(cut.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = sides.groupBy(F.col("x").alias("comp")).agg(F.min("y").alias("to")).where("to < comp")
        labels = materialize(labels.join(hook, "comp", "left").select("u", F.coalesce("to", "comp").alias("comp")), "labels")


def reach_of(percent: int) -> int:
    """Least number of slots, of SLOTS, that a pair of the similarity exceeds with a chance of MISS at most."""
    same, left = percent / 100, 1.0
    for reach in range(SLOTS):
        left -= comb(SLOTS, reach) * (1 - same) ** reach * same ** (SLOTS - reach)
        if left <= MISS:
            return reach
    return SLOTS - 1


def errors_of(percent: int) -> int:
    """Least number of slots to leave out of pieces so that a pair of the similarity meets but for a chance of MISS at most."""
    same, width = percent / 100, SLOTS // CHUNKS
    for errors in range(width):
        meets = sum(comb(width, k) * (1 - same) ** k * same ** (width - k) for k in range(errors + 1))
        if (1 - meets) ** CHUNKS <= MISS:
            return errors
    raise ValueError(f"{SLOTS} slots do not find pairs of {percent} percent")


def apart(sizes, percent: int):
    """Shingles in which two sets, of so many together, may differ at the least similarity."""
    return sizes * (100 - percent) // (100 + percent)


@cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each band of sizes the greatest size, the parts that a set is cut into, and how many more of these than one two similar sets have in common at least.

    Sets of the first band differ in nothing and are not cut.
    """
    top = [-(-(100 + percent) // (2 * (100 - percent))) - 1]
    while top[-1] < 1 << 40:
        top.append(int(top[-1] * GROWTH) + 1)
    tops = np.array(top, np.int64)
    spare = apart(2 * tops, percent) // SPARE
    return tops, apart(2 * tops, percent) + 1 + spare, spare


def part_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the parts of every set, the last byte of a key being its band.

    Two similar sets agree in a band, that of the larger one, in more parts than its spare ones.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tops, parts, _ = bands(percent)
    first, last = np.searchsorted(tops, sizes), np.searchsorted(tops, 100 * sizes // percent)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    place, value = mix(flat ^ _FOLD[51]), mix(flat ^ _FOLD[52])
    rows, keys = [], []
    for more in range(int((last - first).max(initial=0)) + 1):
        band = first + more
        count = np.where((band <= last) & (band > 0), parts[band], 0)
        start = np.cumsum(count) - count
        use = np.repeat(count > 0, sizes)
        row = np.repeat(np.arange(len(sets)), sizes)[use]
        part = (place[use] % parts[band][row].astype(np.uint64)).astype(np.int64)
        content = np.zeros(int(count.sum()), np.uint64)
        np.add.at(content, start[row] + part, value[use])
        owner = np.repeat(np.arange(len(sets)), count)
        number = (np.arange(len(content)) - start[owner]).astype(np.uint64)
        key = mix(mix(content) + mix(number ^ _FOLD[53]))
        keys.append(key & ~np.uint64(0xFF) | band[owner].astype(np.uint64))
        rows.append(owner)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _names(sets: list[np.ndarray]) -> np.ndarray:
    return mix(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)).view(np.int64)


def _parts(percent: int, size: int):
    """(key, f1) of the parts of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = text_sets(*strings(batch.column("text")), size)
            f1, some = np.unique(_names(sets), return_index=True)
            rows, keys = part_keys([sets[k] for k in some.tolist()], percent)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f1[rows])], names=["key", "f1"])
        trim()

    return run


def parities(shingle_set: np.ndarray) -> np.ndarray:
    """For each of at least four bits a shingle, LEAST_BITS at least and a power of two, whether an odd number of shingles falls on it; sets differ in as many shingles as bits at least."""
    width = max(LEAST_BITS, 1 << (4 * len(shingle_set) - 1).bit_length())
    at = mix(shingle_set ^ _FOLD[54]) & np.uint64(width - 1)
    odd = np.bincount(at.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _parity_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(s).tobytes() for s in text_sets(*strings(batch.column("text")), size)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("n"), pa.array(bits, pa.binary())], names=["u", "n", "bits"])
        trim()

    return run


def _folded(bits: list[np.ndarray], words: int) -> np.ndarray:
    """Parities of one width: halves of wider ones are added."""
    return np.stack([b if len(b) == words else np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) for b in bits])


def _sure_tiles(side: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], label: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block, or of two blocks those across, whose sizes and parities do not rule out the similarity; label as in :func:`_tiles`."""
    across, order = side.min() != side.max(), np.argsort(sizes, kind="stable")
    tiles = [order[a : a + 256] for a in range(0, len(order), 256)]
    for a, x in enumerate(tiles):
        for b, y in enumerate(tiles[a:], a):
            if 100 * sizes[x[-1]] < percent * sizes[y[0]]:
                break  # sizes rise
            ok = label[x][:, None] != label[y][None, :]
            if across:
                ok &= side[x][:, None] != side[y][None, :]
            if a == b:
                ok = np.triu(ok, 1)
            ok &= 100 * sizes[x][:, None] >= percent * sizes[y][None, :]
            if not ok.any():
                continue
            words = min(min(len(bits[k]) for k in x.tolist()), min(len(bits[k]) for k in y.tolist()))
            left, right = (_folded([bits[k] for k in z.tolist()], words) for z in (x, y))
            far = np.zeros(ok.shape, np.int64)
            for k in range(words):
                far += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
            i, j = np.nonzero(ok & (far <= apart(sizes[x][:, None] + sizes[y][None, :], percent)))
            yield x[i], y[j]


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of many whole groups, and each row's group, from batches that are sorted by the keys."""

    def groups(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in (t.column(k).to_numpy() for k in keys):
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        group = groups(t)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut), group[:cut]
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, groups(t)


def _sure_forest(percent: int):
    """A spanning forest (a, b) of the pairs of the keys that parities do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole(batches, MEET):
            u, n, side, comp = (t.column(k).to_numpy() for k in ("u", "n", "side", "comp"))
            forest, made = Forest(comp), []
            bits = [np.frombuffer(b, np.uint64) for b in t.column("bits").to_pylist()]
            rough = _folded(bits, LEAST_BITS // 64)
            first, size = np.unique(group, return_index=True, return_counts=True)[1:]
            across = (np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first))[group - group[0]]
            for step in range(1, int(size.max())):
                # each row and the one so many places on, of all groups at once
                i = np.flatnonzero(group[step:] == group[:-step])
                j = i + step
                limit = apart(n[i] + n[j], percent)
                ok = (forest.label[i] != forest.label[j]) & (abs(n[i] - n[j]) <= limit) & ~(across[i] & (side[i] == side[j]))
                i, j, limit = i[ok], j[ok], limit[ok]
                ok = np.bitwise_count(rough[i] ^ rough[j]).sum(axis=1, dtype=np.int64) <= limit
                near = []
                for x, y, most in zip(i[ok].tolist(), j[ok].tolist(), limit[ok].tolist(), strict=True):
                    words = min(len(bits[x]), len(bits[y]))
                    left, right = _folded([bits[x], bits[y]], words)
                    if np.bitwise_count(left ^ right).sum() <= most:
                        near.append((x, y))
                if near:
                    p, q = np.array(near).T
                    made += [(int(u[p[k]]), int(u[q[k]])) for k in forest.join(p, q)]
            yield _pairs(made)
        trim()

    return run


def _sure_confirmed(percent: int, size: int):
    """Links (a, b) that connect the nodes of a block, or of two, as far as their sets do, by parities and then in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, MEET):
            made: list[tuple[int, int]] = []
            u, label = t.column("u").to_numpy(), np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
            sets = [s for c in t.column("text").chunks for s in text_sets(*strings(c), size)]
            sizes = np.array([len(s) for s in sets])
            for x, y in _sure_tiles(t.column("side").to_numpy(), sizes, [parities(s) for s in sets], label, percent):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if label[i] == label[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        made.append((int(u[i]), int(u[j])))
                        label[label == label[j]] = label[i]
            yield _pairs(made)
        trim()

    return run


def _once(at: DataFrame) -> DataFrame:
    """(key, crowded) of the keys of at(key, u, comp) with nodes of several components; of those that are not crowded and have the same nodes, the least.

    Two hashes, 128 bits, and their number name the nodes of a key.
    """
    names = [F.bit_xor(F.xxhash64(F.lit(k), "u")).alias(f"h{k}") for k in (1, 2)]
    several = at.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m"), *names).where("c1 < c2")
    one = several.where(F.col("m") <= CROWD).groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", F.lit(0).alias("crowded"))
    return one.unionByName(several.where(F.col("m") > CROWD).select("key", F.lit(1).alias("crowded")))


def _missed(own: DataFrame, nodes: DataFrame, links: DataFrame, percent: int, size: int) -> DataFrame | None:
    """Links (a, b) between nodes that the given ones leave in different components, all of them as far as components go; None if there are none.

    A crowded part is left out for sets that have no more of them than spare
    parts: similar ones have another part in common. Of other parts that the
    same nodes share, as those of a long passage are, one is enough.
    """
    every = Window.partitionBy("key")
    keys = own.mapInArrow(_parts(percent, size), "key long, f1 long").withColumns({"lo": F.min("f1").over(every), "hi": F.max("f1").over(every)})
    keys = keys.where("lo < hi").select("key", "f1").distinct()
    labels = components(links)
    named = nodes.select("f1", "u").join(labels, "u", "left").select("f1", "u", F.coalesce("comp", "u").alias("comp"))
    at = materialize(keys.join(named, "f1").select("key", "u", "comp"), "parts")
    several = _once(at)
    band = F.col("key").bitwiseAND(F.lit(0xFF)).cast("int")
    spare = F.element_at(F.array(*map(F.lit, bands(percent)[2].tolist())), band + 1)
    at = at.join(several, "key").withColumn("many", F.sum("crowded").over(Window.partitionBy("u", band)))
    at = materialize(at.where((F.col("crowded") == 0) | (F.col("many") > spare)).select("key", "u", F.lit(1.0 / CROWD).alias("cost")), "parts")
    left = None if at.isEmpty() else _across(at, labels)
    if left is None:
        return None
    texts = null_safe(own, nodes.join(at.select("u").distinct(), "u").select("u", "n", "one.doc_id", "one.tag").hint("merge")).select("u", "n", "text")
    texts = materialize(texts, "texts")
    bits = materialize(texts.mapInArrow(_parity_rows(size), "u long, n long, bits binary"), "parities")
    near = _met(left.join(bits, "u"), _sure_forest(percent), "forest")
    if near.isEmpty():
        return None
    known = bits.select("u").join(labels, "u").where("u <> comp").select(F.col("u").alias("a"), F.col("comp").alias("b"))
    groups = components(near.unionByName(known)).withColumnRenamed("comp", "key")
    cost = F.lit(1.0 / SHARE) + F.col("n") / SHARE_SHINGLES
    left = _across(bits.join(groups, "u").select("key", "u", cost.alias("cost")), labels)
    return None if left is None else _met(left.join(texts, "u"), _sure_confirmed(percent, size), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = WORDS, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and kept, of each row.

    percent: least Jaccard similarity of the sets of ``size``-word shingles.
    By default every pair of the similarity is found: what signatures leave out,
    each with a chance of 2 * MISS at most, parts of the sets find; ValueError
    where there are too few slots for it. reach: slots that may differ; if it is
    given, only the pairs that do not differ in more are sure to be found.
    Texts without words have no shingle and no link; null texts count as
    empty. Repeated rows are linked like any equal texts. Null ids stay and
    count only if a component has no other id. Ids are integers. An empty table
    gives an empty table; other columns are ignored.
    """
    signed, nodes = _classes(keyed(docs, id_col, text_col), percent, size, reach)
    named = signed.where("n > 0").join(nodes.select("n", "f1", "f2", "component_id"), ["n", "f1", "f2"])
    out = named.select("doc_id", "n", "component_id").unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85, size: int = WORDS, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, that of the smallest id; of rows of one id and text, one. Texts without words stay.

    Null ids give way to others. Nulls, empty tables and other columns as with :func:`near_duplicates`.
    """
    own = keyed(docs, id_col, text_col, carry=True)
    signed, nodes = _classes(own.drop("row"), percent, size, reach)
    stay = nodes.groupBy("comp").agg(F.min("one").alias("one")).select("one.doc_id", "one.tag")
    stay = stay.unionByName(signed.where("n = 0").select("doc_id", "tag").distinct())
    out = null_safe(own, stay)
    if not signed.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "tag"])
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def _classes(own: DataFrame, percent: int, size: int, reach: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of a keyed table with the size and name of their set, and of each set its component, the least id there, and the row that stands for it."""
    exact = reach is None and percent < 100
    errors = errors_of(percent) if reach is None else reach // CHUNKS
    reach = reach_of(percent) if reach is None else reach
    if not 0 <= reach < SLOTS:
        raise ValueError(f"reach is 0 to {SLOTS - 1}")
    spark = own.sparkSession
    bound_batches(spark)
    with swept(spark):
        signed = materialize(own.mapInArrow(_signed(size), SIGNED), "signed")
        classes = settled(spark, lambda: _nodes(own, signed, percent, size, reach, errors, exact), "classes")
    return signed, classes


def _nodes(own: DataFrame, signed: DataFrame, percent: int, size: int, reach: int, errors: int, exact: bool) -> DataFrame:
    """The sets of signed rows, as :func:`_classes` gives them."""
    # equal sets are one node, one of whose rows stands for it; two sums over the set, 128 bits, and its size name it
    one = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tag", "sig")
    nodes = signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(one).alias("one"), F.min("doc_id").alias("least"))
    nodes = materialize(nodes.withColumn("u", F.monotonically_increasing_id()), "nodes")
    pieces = nodes.select("u", F.posexplode("one.sig").alias("chunk", "piece"))
    keys = pieces.select(F.explode(index_keys(F.col("piece"), errors)).alias("key"), "u", F.lit(1.0 / CROWD).alias("cost"))
    sigs = nodes.select("u", "one.sig")
    near = _links(keys, lambda rows: rows.join(sigs, "u"), _forest(reach), "forest")
    members = nodes.join(components(near), "u").select("comp", "u", "n", "one.doc_id", "one.tag", "one.sig")
    members = materialize(members, "members")
    # members grow with the documents, so that they are not broadcast whatever a first estimate says
    texts = null_safe(own, members.select("u", "sig", "doc_id", "tag").hint("merge")).select("u", "sig", "text")
    texts = materialize(texts, "texts")  # those of the groups, few of all, which several rounds may read
    cost = F.lit(1.0 / SHARE) + F.col("n") / SHARE_SHINGLES
    links = _links(members.select(F.col("comp").alias("key"), "u", cost.alias("cost")), lambda rows: rows.join(texts, "u"), _confirmed(reach, percent, size), "links")
    if exact:
        missed = _missed(own, nodes, links, percent, size)
        links = links if missed is None else links.unionByName(missed)
    linked = nodes.select("u", "least").join(components(links), "u")
    least = materialize(linked.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    linked = materialize(linked.select("u", "comp").join(least, "comp"), "linked")
    nodes = nodes.join(linked, "u", "left").select("n", "f1", "f2", "one", F.coalesce("comp", "u").alias("comp"), F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return nodes.withColumn("one", F.struct("one.null", "one.doc_id", "one.tag"))
