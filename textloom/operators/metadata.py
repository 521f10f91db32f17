"""Categorical metadata: distributions, cross-tabs, flows, coverage and availability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def values(facts: DataFrame, field: str) -> DataFrame:
    """One row for each article and value of a field."""
    return facts.where(F.col("field") == field).select("article_id", "source", F.explode("value").alias("value"))


def categorical(facts: DataFrame, field: str, top: int = 20) -> DataFrame:
    """Articles of the first values, and with each the totals and the sum of the tail (multi-valued articles count in each)."""
    top = max(1, min(200, top))
    v = values(facts, field)
    counts = v.groupBy("value").agg(F.countDistinct("article_id").alias("articles"))
    totals = counts.agg(F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.sum("articles"), F.lit(0)).alias("all"))
    shown = counts.orderBy(F.desc("articles"), "value").limit(top)
    sums = shown.agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("shown"))
    total = v.agg(F.countDistinct("article_id").alias("total_articles"))
    one = F.broadcast(totals.join(sums).join(total))  # a single row
    return shown.join(one).select("value", "articles", "total_articles", "distinct_values", (F.col("all") - F.col("shown")).alias("other_value_articles"))


def cross_tab(facts: DataFrame, metrics: DataFrame, field: str, metric: str, top: int = 50) -> DataFrame:
    """Articles, mean and sample deviation of the article means of a metric for each value of a field."""
    means = metrics.where(F.col("metric_name") == metric).groupBy("article_id").agg(F.avg("value").alias("m"))
    out = values(facts, field).distinct().join(means, "article_id").groupBy("value").agg(F.countDistinct("article_id").alias("articles"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std"))
    return out.orderBy(F.desc("articles"), "value").limit(top)


def sankey(facts: DataFrame, fields: Sequence[str], top: int = 200) -> DataFrame:
    """Articles that flow between values of neighbouring fields; nodes are named layer::value."""
    if len(fields) < 2:
        raise ValueError("two fields at least")
    links = []
    for k, (a, b) in enumerate(zip(fields, fields[1:], strict=False)):
        left = values(facts, a).select("article_id", F.concat(F.lit(f"{k}::"), "value").alias("from_node"))
        right = values(facts, b).select("article_id", F.concat(F.lit(f"{k + 1}::"), "value").alias("to_node"))
        links.append(left.join(right, "article_id").groupBy("from_node", "to_node").agg(F.countDistinct("article_id").alias("articles")).orderBy(F.desc("articles"), "from_node", "to_node").limit(max(1, min(200, top))))
    return reduce(DataFrame.unionByName, links)


def coverage(cells: DataFrame, floor: int = 50) -> DataFrame:
    """Articles and population rate of each source and field from (source, field, method, articles).

    A field is structurally absent where at least ``floor`` articles were seen
    and none had a method.
    """
    out = cells.groupBy("source", "field").agg(F.sum("articles").alias("total"), F.sum(F.when(F.col("method") != "null", F.col("articles")).otherwise(0)).alias("populated"))
    return out.withColumn("rate", F.col("populated") / F.col("total")).withColumn("structurally_absent", (F.col("total") >= floor) & (F.col("populated") == 0))


def coverage_cells(rows: DataFrame) -> DataFrame:
    """Exact articles and newest sight for each source, field and method."""
    return rows.groupBy("source", "field", "method").agg(F.countDistinct("article_id").alias("articles"), F.max("seen_at").alias("last_seen"))


def coverage_rows(articles: DataFrame, fields: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """A row for each article and field: its method, or "null" where it is missing or unknown. articles: article_id, source, seen_at, methods (map)."""
    every = articles.select("article_id", "source", "seen_at", "methods", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    found = F.element_at("methods", F.col("field"))
    return every.select("article_id", "source", "seen_at", "field", F.when(found.isin(*methods), found).otherwise("null").alias("method"))


def global_field_stats(summary: DataFrame) -> DataFrame:
    """Totals over sources from coverage()."""
    out = summary.groupBy("field").agg(F.sum("total").alias("total"), F.sum("populated").alias("populated"), F.count(F.lit(1)).alias("sources_observed"), F.count_if(F.col("populated") > 0).alias("sources_populated"))
    return out.withColumn("rate", F.col("populated") / F.col("total"))


def field_cardinality(facts: DataFrame, metrics: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Different values of categorical fields and of metrics, and whether there is but one."""
    cat = facts.select(*by, F.col("field").alias("name"), F.explode("value").alias("v"))
    num = metrics.select(*by, F.col("metric_name").alias("name"), F.col("value").cast("string").alias("v"))
    out = cat.unionByName(num).groupBy(*by, "name").agg(F.countDistinct("v").alias("distinct_values"))
    return out.withColumn("constant", F.col("distinct_values") == 1)


def available_metrics(metrics: DataFrame, n_sources: int, share: float = 0.85) -> DataFrame:
    """Each metric: in how many sources, whether in all, different values, the share of the most frequent, and its class."""
    counts = metrics.groupBy("metric_name", "value").agg(F.count(F.lit(1)).alias("n"))
    conc = counts.groupBy("metric_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("m"), F.sum("n").alias("rows"))
    conc = conc.select("metric_name", "distinct_values", (-F.col("m.neg")).alias("dominant"), (F.col("m.n") / F.col("rows")).alias("dominant_share"))
    where = metrics.groupBy("metric_name").agg(F.countDistinct("source").alias("sources"))
    kind = F.when(F.col("distinct_values") <= 1, "degenerate").when((F.col("metric_name") == "image_count") | (F.col("distinct_values") <= 2) | (F.col("dominant_share") >= share), "low_signal").otherwise("usable")
    return where.join(conc, "metric_name").select("metric_name", "sources", (F.col("sources") == n_sources).alias("in_all_sources"), "distinct_values", "dominant", "dominant_share", kind.alias("class"))


def available_fields(facts: DataFrame, n_sources: int, share: float = 0.85) -> DataFrame:
    """The same for metadata fields, by articles, with the fields that are constant within every source."""
    v = facts.select("article_id", "source", "field", F.explode("value").alias("value"))
    total = v.groupBy("field").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("source").alias("sources"))
    top = v.groupBy("field", "value").agg(F.countDistinct("article_id").alias("n")).groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("most"))
    per = v.groupBy("field", "source").agg(F.countDistinct("value").alias("d")).groupBy("field").agg((F.max("d") == 1).alias("constant_in_source"))
    out = total.join(top, "field").join(per, "field").withColumn("dominant_share", F.col("most") / F.col("articles"))
    kind = F.when(F.col("field") == "article_type", "structural").when(F.col("distinct_values") <= 1, "degenerate").when((F.col("distinct_values") <= 2) & (F.col("dominant_share") >= share) | (F.col("dominant_share") >= share), "low_signal").otherwise("usable")
    return out.select("field", "articles", (F.col("sources") == n_sources).alias("in_all_sources"), "distinct_values", "dominant_share", "constant_in_source", kind.alias("class"))


def facet_fan_out(facts: DataFrame, metrics: DataFrame, field: str, metric: str, most: int = 12) -> DataFrame:
    """Mean of a metric for the first values of a facet, and whether values were left out."""
    counts = values(facts, field).groupBy("value").agg(F.countDistinct("article_id").alias("articles"))
    capped = F.broadcast(counts.agg((F.count(F.lit(1)) > most).alias("capped")))
    rows = values(facts, field).join(metrics.where(F.col("metric_name") == metric).select("article_id", F.col("value").alias("m")), "article_id")
    means = rows.join(F.broadcast(counts.orderBy(F.desc("articles"), "value").limit(most).select("value")), "value").groupBy("value").agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("rows"))
    return means.join(capped)
