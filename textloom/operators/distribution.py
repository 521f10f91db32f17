"""Distributions, heatmaps, correlations, lags and per-article relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.core import bucket, exact_quantiles, guarded_corr

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, extremes, mean and exact quantiles of each segment; without rows one row of zeros if there are no segments."""
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    marks = exact_quantiles(rows, by, value, QUANTILES)
    if by:
        return stats.join(marks, list(by))
    names = [f"p{round(p * 100):02d}" for p in QUANTILES]
    out = stats.join(F.broadcast(marks), how="left")  # one row each
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "min", "max", "mean", *names)])


def clamp_bins(bins: int) -> int:
    return max(1, min(200, bins))


def histogram(df: DataFrame, value: str, bins: int = 20, clamp: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins of each segment, empty ones too.

    clamp: the upper bound is the Tukey fence where that is below the maximum,
    and values at or over it are the overflow. Without a fence the last bin
    holds the maximum. Values that do not differ make one bin without width.
    """
    bins = clamp_bins(bins)
    s = summary(df, value, by) if by else summary(df, value).where("count > 0")
    fence = F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))
    clamped = (fence < F.col("max")) & (fence > F.col("min")) if clamp else F.lit(False)
    frame = s.select(*by, F.col("min").cast("double").alias("lo"), F.when(clamped, fence).otherwise(F.col("max")).cast("double").alias("hi"), clamped.alias("clamped"))
    frame = frame.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    empty = frame.select("*", F.explode(F.when(F.col("width") > 0, F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))).alias("bin"))
    rows = df.where(F.col(value).isNotNull())
    at = rows.join(frame, list(by)) if by else rows.join(F.broadcast(frame))  # a single row
    over = F.col("clamped") & (F.col(value) >= F.col("hi"))
    place = F.when(F.col("width") > 0, F.greatest(F.least(F.floor((F.col(value) - F.col("lo")) / F.when(F.col("width") > 0, F.col("width"))), F.lit(bins - 1)), F.lit(0))).otherwise(F.lit(0)).cast("int")
    counted = at.groupBy(*by, F.when(over, F.lit(-1)).otherwise(place).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    overflow = counted.where("bin = -1").select(*by, F.col("n").alias("overflow"))
    out = empty.join(counted.where("bin >= 0"), [*by, "bin"], "left")
    out = out.join(overflow, list(by), "left") if by else out.join(F.broadcast(overflow), how="left")
    return out.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"), F.when(F.col("width") > 0, F.col("lo") + (F.col("bin") + 1) * F.col("width")).otherwise(F.col("hi")).alias("upper"), F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("overflow", F.lit(0)).alias("overflow"))


def dimension(name: str) -> Column:
    """A heatmap axis as text."""
    axes = {"dayOfWeek": F.expr("extract(dayofweek_iso FROM timestamp)"), "hour": F.hour("timestamp"), "source": F.col("source"), "entityLabel": F.col("entity_label"), "language": F.col("language")}
    if name not in axes:
        raise ValueError(f"unknown dimension {name}")
    return axes[name].cast("string")


def heatmap(metrics: DataFrame, x: str, y: str, entities: DataFrame | None = None, languages: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Mean and count of each cell. Joins only for the axes that need them; entities fan rows out, as mentions do."""
    rows = metrics
    if "entityLabel" in (x, y):
        rows = rows.join(entities.select("article_id", "entity_label"), "article_id")
    if "language" in (x, y):
        rows = rows.join(languages.where("rank = 1").select("article_id", F.col("detected_language").alias("language")), "article_id")
    return rows.groupBy(dimension(x).alias("x"), dimension(y).alias("y")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("count"))


def correlation_matrix(metrics: DataFrame, names: Sequence[str], resolution: str = "5min") -> DataFrame:
    """Pearson's r of the bucket means of each two metrics over the buckets that have both."""
    if not 1 <= len(names) <= 10:
        raise ValueError("one to ten metrics")
    means = metrics.where(F.col("metric_name").isin(*names)).withColumn("bucket", bucket("timestamp", resolution)).groupBy("bucket").pivot("metric_name", list(names)).agg(F.avg("value"))
    pairs = [(a, b) for a in names for b in names]
    row = means.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), guarded_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("r"), F.count(F.when(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), 1)).alias("n")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(pairs))])).alias("c")).select("c.*")


def lead_lag(x: DataFrame, y: DataFrame, most: int = 168, value: str = "value") -> DataFrame:
    """r of x[h] and y[h + lag] for each lag up to most hours; x, y: (bucket, value)."""
    if not 0 <= most <= 720:
        raise ValueError("0 to 720 hours")
    lags = x.select("bucket", F.col(value).alias("x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    lags = lags.withColumn("hour", F.unix_timestamp(F.col("bucket").cast("timestamp")) + F.col("lag") * 3600)
    other = y.select(F.unix_timestamp(F.col("bucket").cast("timestamp")).alias("hour"), F.col(value).alias("y"))
    found = lags.join(other, "hour").groupBy("lag").agg(guarded_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    every = x.sparkSession.range(-most, most + 1).select(F.col("id").cast("int").alias("lag"))
    return every.join(found, "lag", "left").select("lag", "r", F.coalesce("n", F.lit(0)).alias("n"))


def peak_lag(lags: DataFrame) -> DataFrame:
    """The lag with the greatest r, the first of equals."""
    return lags.where(F.col("r").isNotNull()).agg(F.max(F.struct("r", (-F.col("lag")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("lag"), F.col("m.r").alias("r"))


def scatter(metrics: DataFrame, x: str, y: str, size: str | None = None, color: str | None = None, most: int = 10_000) -> DataFrame:
    """Means of two metrics (and two more) of each article that has both, in article order."""
    names = dict(zip(("x", "y", "size", "color"), (x, y, size, color), strict=True))
    cols = [(F.avg(F.when(F.col("metric_name") == n, F.col("value"))) if n else F.lit(None).cast("double")).alias(k) for k, n in names.items()]
    return metrics.where(F.col("metric_name").isin(*{n for n in names.values() if n})).groupBy("article_id").agg(*cols).where("x IS NOT NULL AND y IS NOT NULL").orderBy("article_id").limit(max(1, min(10_000, most)))


def parallel_coordinates(metrics: DataFrame, axes: Sequence[str], most: int = 3000) -> DataFrame:
    """Means on two to eight axes of each article that has all."""
    if not 2 <= len(axes) <= 8:
        raise ValueError("two to eight axes")
    means = metrics.where(F.col("metric_name").isin(*axes)).groupBy("article_id").agg(*[F.avg(F.when(F.col("metric_name") == a, F.col("value"))).alias(f"a{k}") for k, a in enumerate(axes)])
    full = means.where(" AND ".join(f"a{k} IS NOT NULL" for k in range(len(axes))))
    return full.orderBy("article_id").limit(most).select("article_id", *[f"a{k}" for k in range(len(axes))])


def silver_correlation(docs: DataFrame) -> DataFrame:
    return docs.agg(guarded_corr(F.col("cleaned_text_length").cast("double"), F.col("word_count").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
