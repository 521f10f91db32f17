"""Time series, rollups and their normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.core import bucket, ranked, row_cap

KEYS = ("bucket", "source", "metric_name")


def series(metrics: DataFrame, resolution: str = "daily") -> DataFrame:
    """Mean and count for each bucket, source and metric. Weeks begin on Sunday."""
    at = metrics.withColumn("bucket", bucket("timestamp", resolution, "sunday"))
    return at.groupBy(*KEYS).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("count"))


def capped(df: DataFrame, resolution: str, base: int = 10_000) -> tuple[DataFrame, bool]:
    """Rows in bucket order up to the cap of the resolution, and whether there were more."""
    cap = row_cap(resolution, base)
    more = df.limit(cap + 1).count() > cap
    return df.orderBy(*[c for c in KEYS if c in df.columns]).limit(cap), more


def series_with_spread(metrics: DataFrame, resolution: str = "daily") -> DataFrame:
    """series with the sample deviation, 0 for a single row; always from raw rows."""
    at = metrics.withColumn("bucket", bucket("timestamp", resolution, "sunday"))
    return at.groupBy(*KEYS).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("count"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("spread"))


def rollup(metrics: DataFrame, resolution: str) -> DataFrame:
    """Mergeable states (sum, count) of each bucket."""
    at = metrics.withColumn("bucket", bucket("timestamp", resolution, "sunday"))
    return at.groupBy(*KEYS).agg(F.sum("value").alias("sum"), F.count("value").alias("count"))


def from_rollup(states: DataFrame, resolution: str) -> DataFrame:
    """Series from states of a finer resolution: sums of sums over sums of counts."""
    at = states.withColumn("bucket", bucket("bucket", resolution, "sunday"))
    return at.groupBy(*KEYS).agg((F.sum("sum") / F.sum("count")).alias("value"), F.sum("count").alias("count"))


def distinct_states(metrics: DataFrame, resolution: str) -> DataFrame:
    """Mergeable states of distinct counts and maxima: a row for each article of a bucket, with its largest value."""
    at = metrics.withColumn("bucket", bucket("timestamp", resolution, "sunday"))
    return at.groupBy(*KEYS, "article_id").agg(F.max("value").alias("largest"))


def merged_states(states: DataFrame, resolution: str) -> DataFrame:
    """Articles and largest value of coarser buckets; an article of several finer ones counts once."""
    at = states.withColumn("bucket", bucket("bucket", resolution, "sunday"))
    return at.groupBy(*KEYS).agg(F.countDistinct("article_id").alias("articles"), F.max("largest").alias("largest"))


#: The stored rollup that answers each resolution; weeks are built from days, 5-minute buckets from raw rows.
ROUTES = {"hourly": "hourly", "daily": "daily", "weekly": "daily", "monthly": "monthly"}


def routed(resolution: str, raw: DataFrame, rollups: dict[str, DataFrame]) -> DataFrame:
    """series, read from a rollup where there is one for the resolution."""
    route = ROUTES.get(resolution)
    return from_rollup(rollups[route], resolution) if route in rollups else series(raw, resolution)


def activity(df: DataFrame, resolution: str = "hourly", time: str = "timestamp", by: tuple[str, ...] = ()) -> DataFrame:
    """Different articles of each bucket."""
    return df.withColumn("bucket", bucket(time, resolution)).groupBy("bucket", *by).agg(F.countDistinct("article_id").alias("articles"))


def metric_series(metrics: DataFrame, metric: str, resolution: str = "hourly") -> DataFrame:
    """Mean of one metric for each bucket."""
    return metrics.where(F.col("metric_name") == metric).withColumn("bucket", bucket("timestamp", resolution)).groupBy("bucket").agg(F.avg("value").alias("value"))


def document_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.countDistinct("article_id").alias("articles"))


def group_count(metrics: DataFrame, source: str, metric: str, day: str) -> DataFrame:
    """Different articles behind one source and metric on one day, for the k-anonymity gate."""
    rows = metrics.where((F.col("source") == source) & (F.col("metric_name") == metric) & (F.to_date("timestamp") == F.lit(day).cast("date")))
    return rows.agg(F.countDistinct("article_id").alias("articles"))


def source_counts(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Totals, window, last seven days (by the source's own newest) and frequency of each source."""
    newest = docs.groupBy("source").agg(F.max("timestamp").alias("last_seen"), F.min("timestamp").alias("first_seen"))
    at = docs.join(newest, "source")
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    within = (F.col("timestamp") >= a) & (F.col("timestamp") < b)
    recent = F.col("timestamp") > F.col("last_seen") - F.expr("INTERVAL 7 DAYS")
    out = at.groupBy("source").agg(
        F.countDistinct("article_id").alias("total"), F.countDistinct(F.when(within, F.col("article_id"))).alias("in_window"),
        F.countDistinct(F.when(recent, F.col("article_id"))).alias("recent"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    days = F.greatest(F.datediff(b.cast("date"), a.cast("date")), F.lit(1))
    return out.withColumn("per_day", F.col("in_window") / days).withColumn("recent_per_day", F.col("recent") / F.lit(7.0))


def baselines(metrics: DataFrame, languages: DataFrame, least: int = 2) -> DataFrame:
    """Mean and population deviation of each metric, source and language with at least two rows."""
    spoken = languages.where("rank = 1").select("article_id", F.col("detected_language").alias("language"))
    out = metrics.join(spoken, "article_id").groupBy("metric_name", "source", "language").agg(F.avg("value").alias("baseline_value"), F.stddev_pop("value").alias("baseline_std"), F.count(F.lit(1)).alias("n_documents"))
    return out.where(F.col("n_documents") >= least)


def zscore_series(metrics: DataFrame, languages: DataFrame, base: DataFrame, resolution: str = "daily") -> DataFrame:
    """Mean z-score of each bucket against the baseline of the article's language; no baseline or no spread, no row."""
    spoken = languages.where("rank = 1").select("article_id", F.col("detected_language").alias("language"))
    rows = metrics.join(spoken, "article_id", "left").join(base.where("baseline_std > 0"), ["metric_name", "source", "language"])
    rows = rows.withColumn("bucket", bucket("timestamp", resolution, "sunday")).withColumn("z", (F.col("value") - F.col("baseline_value")) / F.col("baseline_std"))
    return rows.groupBy(*KEYS).agg(F.avg("z").alias("value"), F.count(F.lit(1)).alias("count"))


def spoken_states(metrics: DataFrame, languages: DataFrame, resolution: str = "daily") -> DataFrame:
    """Count, mean and variance of each bucket and language: from them baselines and z-scores follow without the rows."""
    spoken = languages.where("rank = 1").select("article_id", F.col("detected_language").alias("language"))
    rows = metrics.join(spoken, "article_id").where(F.col("value").isNotNull()).withColumn("bucket", bucket("timestamp", resolution, "sunday"))
    return rows.groupBy(*KEYS, "language").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def baselines_of(states: DataFrame, least: int = 2) -> DataFrame:
    """:func:`baselines` from states: means of means, and variances within and between buckets."""
    out = states.groupBy("metric_name", "source", "language").agg(F.sum("n").alias("n_documents"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("baseline_value"), F.sum(F.col("n") * F.col("var")).alias("inside"), F.sum("n").alias("all"), F.collect_list(F.struct("n", "mean")).alias("buckets"))
    between = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + b["n"] * (b["mean"] - F.col("baseline_value")) * (b["mean"] - F.col("baseline_value")))
    out = out.select("metric_name", "source", "language", "baseline_value", F.sqrt((F.col("inside") + between) / F.col("all")).alias("baseline_std"), "n_documents")
    return out.where(F.col("n_documents") >= least)


def zscores_of(states: DataFrame, base: DataFrame) -> DataFrame:
    """:func:`zscore_series` from states: the mean z-score of a bucket is that of its mean."""
    rows = states.join(base.where("baseline_std > 0"), ["metric_name", "source", "language"])
    z = F.col("n") * (F.col("mean") - F.col("baseline_value")) / F.col("baseline_std")
    return rows.groupBy(*KEYS).agg((F.sum(z) / F.sum("n")).alias("value"), F.sum("n").alias("count"))


def excluded_count(metrics: DataFrame, languages: DataFrame) -> DataFrame:
    """Metric rows whose article has no language of rank 1."""
    return metrics.join(languages.where("rank = 1").select("article_id"), "article_id", "left_anti").agg(F.count(F.lit(1)).alias("excluded"))


def percentile_series(metrics: DataFrame, languages: DataFrame, resolution: str = "daily", tie: str = "version") -> DataFrame:
    """Mean percentile rank, (rank - 1) / (n - 1) within metric, source and language; ties by the tie column."""
    spoken = languages.where("rank = 1").select("article_id", F.col("detected_language").alias("language"))
    places = ranked(metrics.join(spoken, "article_id"), ["metric_name", "source", "language"], ["value", tie])
    share = F.when(F.col("n") > 1, (F.col("r") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return places.withColumn("bucket", bucket("timestamp", resolution, "sunday")).groupBy(*KEYS).agg(F.avg(share).alias("value"), F.count(F.lit(1)).alias("count"))
