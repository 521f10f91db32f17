"""Embedding whitening: blockwise TSQR, one-sided Jacobi SVD of the triangle, projection.

A vector's components become whole numbers, so that its sums and its distance
from the mean are exact. Blocks of centred rows are reduced to triangles by QR,
triangles to one another by a tree of bounded fan-in, and plane rotations make
the columns of the last one orthogonal: their lengths are the standard
deviations (times the root of n), the rotations together the components. The
covariance is never formed, so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bound_batches

#: Rows of a block of the QR; triangles that one task merges; sweeps after which rotations must have converged.
BLOCK, FAN_IN, SWEEPS = 2048, 16, 60
#: A deviation below this share of the greatest is none: the data do not vary along that component.
NONE = 1e-12
#: Entries of this size and above do not fit the whole numbers that sums are exact in.
MOST = float(1 << 52)
OUT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


class Fit(NamedTuple):
    """n rows, exact sums of every dimension, components as columns, deviations falling, trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    trace: float


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> DataFrame:
    """id and x = floor(scale * c) + shift; without rows whose vector is null or empty or holds null or non-finite entries."""
    ok = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vec_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ok & F.forall(vec_col, lambda c: F.abs(c.cast("double")) < MOST / scale)).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The vectors as matrices of BLOCK rows at most."""
    for batch in batches:
        for k in range(0, len(batch), BLOCK):
            yield np.array(batch["x"].iloc[k : k + BLOCK].tolist(), np.int64)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums, exact; the same over n). Python integers where 64 bits could overflow."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1)
    exact = x * n - np.array(sums, np.int64) if 2 * most * n < 1 << 62 else x.astype(object) * n - np.array(sums, object)
    return exact, (exact / n).astype(np.float64)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, total = 0, None
    for x in _blocks(batches):
        n += len(x)
        high, low = x >> 26, x & ((1 << 26) - 1)  # a block's sums of either half fit 64 bits
        own = (high.sum(axis=0).astype(object) << 26) + low.sum(axis=0).astype(object)
        total = own if total is None else total + own
    if n:
        yield pd.DataFrame({"n": n, "dim": range(len(total)), "total": [Decimal(int(t)) for t in total]})


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR of rows: at most as many rows as columns."""
    return np.linalg.qr(rows, mode="r")


def _reduced(n: int, sums: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.empty((0, len(sums)))
        for x in _blocks(batches):
            r = triangle(np.vstack([r, _centred(x, n, sums)[1]]))
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    return run


def _merged(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.empty((0, dim))
        for batch in batches:
            for part in batch["r"]:
                r = triangle(np.vstack([r, np.frombuffer(part).reshape(-1, dim)]))
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    return run


def rounds_of_pairs(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tournament: in every round disjoint pairs, in all rounds together every pair of d columns once."""
    seats = list(range(d)) + [-1] * (d % 2)
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if a >= 0 and b >= 0]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi_svd(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): plane rotations from the right until the columns of r are orthogonal, by falling length.

    A pair of columns is turned by the angle that makes it orthogonal; disjoint
    pairs are turned together. It has converged when in a whole sweep no pair's
    cosine is over the rounding error; columns that are themselves rounding
    errors of the whole are left as they are.
    """
    a, v = np.array(r, np.float64), np.eye(r.shape[1])
    tol = np.finfo(float).eps * np.sqrt(max(r.shape[0], 1))
    noise = (np.finfo(float).eps * np.linalg.norm(a)) ** 2
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds_of_pairs(r.shape[1]):
            alpha, beta = np.einsum("ij,ij->j", a[:, p], a[:, p]), np.einsum("ij,ij->j", a[:, q], a[:, q])
            gamma = np.einsum("ij,ij->j", a[:, p], a[:, q])
            turn = (np.abs(gamma) > tol * np.sqrt(alpha * beta)) & (np.minimum(alpha, beta) > noise)
            if not turn.any():
                continue
            turned = True
            p, q, zeta = p[turn], q[turn], (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - c * t * m[:, q], c * t * m[:, p] + c * m[:, q]
        if not turned:
            break
    else:
        raise ArithmeticError(f"rotations did not converge in {SWEEPS} sweeps")
    lengths = np.sqrt(np.einsum("ij,ij->j", a, a))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def fit_whitening(rows: DataFrame) -> Fit | None:
    """Mean, components and deviations of all rows (id, x); None without rows. The driver holds one triangle, dim x dim."""
    totals = rows.select("x").mapInPandas(_sums, "n long, dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("dim").collect()
    if not totals:
        return None
    n, sums = totals[0]["n"], [int(t["total"]) for t in totals]
    parts = rows.select("x").mapInPandas(_reduced(n, sums), "r binary")
    left = rows.rdd.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInPandas(_merged(len(sums)), "r binary")
    r = np.vstack([np.frombuffer(p["r"]).reshape(-1, len(sums)) for p in parts.collect()])
    lengths, components = jacobi_svd(triangle(r))
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(len(sums))] < 0, -1.0, 1.0)
    return Fit(n, sums, components, lengths / np.sqrt(n), float((lengths**2).sum() / n))


def _scores(fit: Fit, most: int):
    """Whitened coordinates of centred rows for the components that vary, others null."""
    top = fit.deviations[:most]
    real = top > NONE * max(fit.deviations[0], np.finfo(float).tiny)
    basis = fit.components[:, :most] / np.where(real, top, np.nan)
    return lambda y: y @ basis


def _products(fit: Fit, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, first, second = _scores(fit, most), 0.0, 0.0
        for x in _blocks(batches):
            w = score(_centred(x, fit.n, fit.sums)[1])
            first, second = first + w.sum(axis=0), second + w.T @ w
        if np.ndim(first):
            k = len(first)
            yield pd.DataFrame({"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "a": np.repeat(first, k), "b": np.tile(first, k), "ab": second.ravel()})

    return run


def identity_error(rows: DataFrame, fit: Fit, most: int) -> float | None:
    """The entry of the whitened rows' covariance that lies furthest from the identity's; components without variance are left out."""
    got = rows.select("x").mapInPandas(_products(fit, most), "i int, j int, a double, b double, ab double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("a", "b", "ab")]).collect()
    gaps = [abs(g["ab"] / fit.n - g["a"] / fit.n * (g["b"] / fit.n) - (g["i"] == g["j"])) for g in got if g["ab"] is not None]
    gaps = [g for g in gaps if g == g]
    return max(gaps) if gaps else None


def _projected(fit: Fit, most: int):
    k = min(most, len(fit.deviations))
    explained = (fit.deviations[:k] ** 2 / fit.trace) if fit.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scores(fit, most)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                exact, y = _centred(np.array(part["x"].tolist(), np.int64), fit.n, fit.sums)
                safe = exact.dtype != object and int(np.abs(exact).max()) ** 2 * exact.shape[1] < 1 << 63
                deviation = [Decimal(int(d)) for d in ((exact if safe else exact.astype(object)) ** 2).sum(axis=1)]
                w = score(y)
                yield pd.DataFrame({
                    "id": part["id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), len(part)), "n": fit.n, "deviation": np.repeat(np.array(deviation, object), k),
                    "whitened": [None if v != v else v for v in w.ravel().tolist()], "explained": np.tile(explained, len(part)),
                })

    return run


def whitened(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """One row for each vector and each of its first ``most`` components: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become whole numbers x = floor(scale * c) + shift. deviation is the
    exact sum over the dimensions of (n * x - sum)^2, whitened the centred row's
    coordinate along a component over its standard deviation, explained that
    component's share of the variance. The fit is over all rows that take part.

    Vectors that are null or empty or hold null or non-finite entries, or one of
    2^52 / scale and above, take no part. If lengths differ, vectors of the most
    frequent length (the smaller of equals) take part. Repeated ids and repeated
    vectors count as often as they stand there; null ids give rows with null
    ids. Along a component without variance whitened is null; without any
    variance explained and identity_error are null too. An empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = whole_vectors(vectors, id_col, vec_col, scale, shift)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))
    fit = fit_whitening(rows) if lengths else None
    if fit is None:
        return spark.createDataFrame([], OUT).withColumn("identity_error", F.lit(None).cast("double")).withColumnRenamed("id", id_col)
    error = identity_error(rows, fit, most)
    out = rows.select("id", "x").mapInPandas(_projected(fit, most), OUT).withColumn("explained", F.nanvl("explained", F.lit(None).cast("double")))
    return out.withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("id", id_col)
