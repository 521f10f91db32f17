"""Catalogue reads: article lists, dossiers, equivalence and validity, discovery and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.plans.gates import LEVELS


def article_list(metrics: DataFrame, languages: DataFrame, revision_rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row for each article, newest first: words, sentiment, language, chain length; paged."""
    pick = lambda m: F.avg(F.when(F.col("metric_name") == m, F.col("value")))
    wide = metrics.groupBy("article_id").agg(F.min("source").alias("source"), F.max("timestamp").alias("timestamp"), pick("word_count").alias("word_count"), pick("sentiment_score_sentiws").alias("sentiment"))
    spoken = languages.where("rank = 1").groupBy("article_id").agg(F.max(F.struct("confidence", "detected_language")).getField("detected_language").alias("language"))
    chains = revision_rows.groupBy("article_id").agg(F.count(F.lit(1)).alias("revisions"))
    page = wide.orderBy(F.desc("timestamp"), "article_id").offset(offset).limit(limit)
    return page.join(spoken, "article_id", "left").join(chains, "article_id", "left").withColumn("revisions", F.coalesce("revisions", F.lit(0)))


def latest_classification(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("classification_date"), "primary_function")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dossier_sources(sources: DataFrame, classifications: DataFrame, counts: DataFrame) -> DataFrame:
    """Sources with their latest classification and counts, 0 where there are none, by name."""
    own = sources.join(latest_classification(classifications).withColumnRenamed("source_id", "id"), "id", "left").join(counts.withColumnRenamed("source", "name"), "name", "left")
    return own.withColumns({c: F.coalesce(c, F.lit(0)) for c, t in counts.dtypes if t in ("bigint", "int")}).orderBy("name")


def resolve_source(sources: DataFrame, identifier: str) -> DataFrame:
    return sources.where((F.col("name") == identifier) | (F.col("id").cast("string") == identifier))


def resolve_article(docs: DataFrame, article_id: str) -> DataFrame:
    """The newest row of an article."""
    return docs.where(F.col("article_id") == article_id).groupBy("article_id").agg(F.max(F.struct("timestamp", "source", "bronze_object_key")).alias("r")).select("article_id", "r.*")


def level_rank(level: Column) -> Column:
    return F.coalesce(*[F.when(level == x, F.lit(k + 1)) for k, x in enumerate(LEVELS)], F.lit(0))


def equivalence_by_metric(grants: DataFrame) -> DataFrame:
    """The strongest grant of each metric and its languages."""
    out = grants.groupBy("metric_name").agg(F.max(F.struct(level_rank(F.col("equivalence_level")).alias("r"), "equivalence_level")).getField("equivalence_level").alias("level"), F.sort_array(F.collect_set("language")).alias("languages"))
    return out


def available(metrics: DataFrame, validity: DataFrame, grants: DataFrame, now: str) -> DataFrame:
    """Metric names with validation status and the strongest grant."""
    names = metrics.select("metric_name").distinct()
    valid = validity.groupBy("metric_name").agg(F.max("valid_until").alias("until"))
    status = F.when(F.col("until").isNull(), "unvalidated").when(F.col("until") > F.lit(now).cast("timestamp_ntz"), "validated").otherwise("expired")
    return names.join(valid, "metric_name", "left").withColumn("validation", status).drop("until").join(equivalence_by_metric(grants), "metric_name", "left")


def validation_status(grants: DataFrame) -> DataFrame:
    """Notes of the strongest grant of each metric."""
    return grants.groupBy("metric_name").agg(F.max(F.struct(level_rank(F.col("equivalence_level")).alias("r"), "equivalence_level", "notes")).alias("m")).select("metric_name", F.col("m.equivalence_level").alias("level"), F.col("m.notes").alias("cultural_context_notes"))


def probe_equivalence(languages: DataFrame, grants: DataFrame) -> DataFrame:
    """Level 1 always; 2 where a deviation or absolute grant covers every language; 3 where absolute ones do too."""
    spoken = languages.where("rank = 1").select(F.col("detected_language").alias("language")).distinct()
    n = F.broadcast(spoken.agg(F.count(F.lit(1)).alias("n")))  # one row
    covered = grants.join(spoken, "language").groupBy("metric_name").agg(F.countDistinct(F.when(F.col("equivalence_level").isin("deviation", "absolute"), F.col("language"))).alias("two"), F.countDistinct(F.when(F.col("equivalence_level") == "absolute", F.col("language"))).alias("three"))
    out = covered.join(n)
    return out.select("metric_name", F.when((F.col("two") == F.col("n")) & (F.col("three") == F.col("n")), 3).when(F.col("two") == F.col("n"), 2).otherwise(1).alias("level"))


def discovery_coverage(runs: DataFrame, window_days: int, now: str) -> DataFrame:
    """Per channel the last run's counts, the window's mean and the declared number. runs: channel, run_at, discovered, after_dedup, declared, indeterminate."""
    last = runs.groupBy("channel").agg(F.max(F.struct("run_at", "discovered", "after_dedup", "declared", "indeterminate")).alias("l"))
    recent = runs.where(F.col("run_at") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(window_days))).groupBy("channel").agg(F.avg("discovered").alias("mean_discovered"))
    return last.select("channel", "l.*").join(recent, "channel", "left")


def underflow(coverage: DataFrame, share: float = 0.5) -> DataFrame:
    """Channels whose last run found less than a share of the window's mean."""
    return coverage.withColumn("underflow", F.coalesce(F.col("discovered") < share * F.col("mean_discovered"), F.lit(False)))


def completeness(channels: DataFrame, gold_rows: int) -> DataFrame:
    """Gold rows over the declared number of the trustworthy channels, null without any, and the channels that are not."""
    sure = (~F.col("indeterminate")) & F.col("declared").isNotNull()
    out = channels.agg(F.sum(F.when(sure, F.col("declared"))).alias("declared"), F.sort_array(F.collect_set(F.when(~sure, F.col("channel")))).alias("indeterminate"))
    return out.withColumn("gold", F.lit(gold_rows)).withColumn("ratio", F.try_divide(F.col("gold"), F.col("declared")))


def funnel_rates(funnel: DataFrame) -> DataFrame:
    """Extraction and non-article rates; null where nothing was submitted or fetched."""
    return funnel.withColumn("extraction_rate", F.try_divide(F.col("gold"), F.col("submitted"))).withColumn("non_article_rate", F.try_divide(F.col("thin"), F.col("fetched")))
