"""Transforms that prepare results for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_sizes(nodes: DataFrame, weight: str) -> DataFrame:
    """size from 0 to 1 by weight, a half where all weigh the same."""
    span = F.broadcast(nodes.agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi")))  # one row
    size = F.when(F.col("_hi") > F.col("_lo"), F.try_divide(F.col(weight) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.5))
    return nodes.join(span).withColumn("size", size).drop("_lo", "_hi")


def cyclic_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of the whole values 0 to bins - 1, empty ones too."""
    counts = df.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def cyclic_mean(df: DataFrame, value: str, period: float) -> DataFrame:
    """Mean on a circle: 23 and 1 o'clock average to midnight; null where the directions cancel."""
    turn = F.col(value) * (2 * 3.141592653589793 / period)
    out = df.agg(F.avg(F.sin(turn)).alias("s"), F.avg(F.cos(turn)).alias("c"))
    mean = F.pmod(F.degrees(F.atan2("s", "c")) / 360 * period, F.lit(float(period)))
    return out.select(F.lit(float(period)).alias("period"), F.when(F.abs("s") + F.abs("c") > 1e-12, mean).alias("mean"))


def histogram_rows(bins: DataFrame) -> DataFrame:
    """Rows to draw: bins, a single spike where the width is zero, and the overflow as a row of its own."""
    kind = F.when(F.col("lower") == F.col("upper"), "spike").otherwise("bin")
    over = bins.agg(F.max("overflow").alias("count"), F.max("upper").alias("lower")).where(F.col("count") > 0)
    return bins.select("bin", "lower", "upper", "count", kind.alias("kind")).unionByName(over.select(F.lit(-1).alias("bin"), "lower", F.lit(None).cast("double").alias("upper"), "count", F.lit("overflow").alias("kind")))
