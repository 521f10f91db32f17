"""Exact top-k by inner product: tiles of queries and shards, partial selection, merging.

Rows are packed, without a shuffle, into shards of bounded size; query rows
into blocks. Every block meets every shard once, as one row of a join on lanes.
A tile is one matrix product; of each tile only the k best of each query stay,
a task merges them over its tiles, and a window merges what the tasks keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm.common import bound_batches

#: Rows of a shard and of a query block.
SHARD, BLOCK = 4096, 1024
#: Query blocks whose merged lists one task holds before it passes them on.
HELD = 8
PACK = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("mat", T.BinaryType())])
OUT = "query_id long, vec_id long, score long"


def _packed(rows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(dim: int) -> pd.DataFrame:
            part = sorted(held.pop(dim), key=lambda x: x[0])
            ids = np.array([i for i, _ in part], np.int64)
            mat = np.array([v for _, v in part], np.int64).reshape(len(part), dim)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "mat": [mat.tobytes()]})

        for batch in batches:
            for i, v in zip(batch["id"], batch["v"], strict=True):
                part = held.setdefault(len(v), [])
                part.append((int(i), np.asarray(v, np.int64)))
                if len(part) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return pack


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floats where they cannot lose a digit."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("inner products do not fit 64 bits")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, ties to the smaller id. ids ascend; int64 minimum is no candidate."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    kth = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    sure, tied = scores > kth, scores == kth
    keep = sure | (tied & (np.cumsum(tied, axis=1) <= k - sure.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)[1].reshape(len(scores), k)


def _tiles(k: int):
    low = np.iinfo(np.int64).min

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out(key: bytes) -> pd.DataFrame:
            q, ids, scores = held.pop(key)
            real = scores != low
            return pd.DataFrame({"query_id": np.repeat(q, ids.shape[1])[real.ravel()], "vec_id": ids[real], "score": scores[real]})

        for batch in batches:
            for dim, bi, bm, si, sm in zip(batch["dim"], batch["q_ids"], batch["q_mat"], batch["ids"], batch["mat"], strict=True):
                q, s = np.frombuffer(bi, np.int64), np.frombuffer(si, np.int64)
                scores = _product(np.frombuffer(bm, np.int64).reshape(len(q), dim), np.frombuffer(sm, np.int64).reshape(len(s), dim))
                scores[q[:, None] == s[None, :]] = low
                at = _best(scores, s, k)
                ids, best = s[at], np.take_along_axis(scores, at, 1)
                key = bi + bytes([dim & 255])
                if key in held:
                    ids, best = np.hstack([held[key][1], ids]), np.hstack([held[key][2], best])
                    order = np.lexsort((ids, -np.maximum(best, low + 1)), axis=1)[:, :k]
                    ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
                held[key] = (q, ids, best)
                if len(held) > HELD:
                    yield out(next(iter(held)))
        for key in list(held):
            yield out(key)

    return run


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id and v = floor(scale * x); without rows whose id or vector is null or holds null or non-finite components."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def exact_topk(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, lanes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query row, its own id apart.

    is_query: function of the id column. Ties go to the smaller id; fewer rows
    give fewer results. Vectors that are null or hold null or non-finite
    components, and rows with null ids, take no part; vectors of different
    length never meet. Repeated ids: each row is a candidate; as a query, the
    smallest of the vectors. Scores beyond 64 bits raise OverflowError. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    ints = integer_vectors(vectors, id_col, vec_col, scale)
    lanes = lanes or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = ints.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    blocks = asked.mapInPandas(_packed(BLOCK), PACK).select("dim", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    shards = ints.mapInPandas(_packed(SHARD), PACK).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    # what a lane multiplies is not in the estimate of the blocks, so that neither side is broadcast whatever it says
    near = shards.join(blocks.hint("merge"), ["lane", "dim"]).select("dim", "q_ids", "q_mat", "ids", "mat").mapInPandas(_tiles(k), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
