"""Registered queries of the analytical operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import core
from textloom.operators import catalogue, crawl, density, distribution, extract, harmonise, metadata, network, profiles, revisions, timeseries
from textloom.sources import views
from textloom.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
START, END = "2024-01-08", "2024-01-22"


def register(sql: str | None = None, *names: str) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql may use the views that are named."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


BASELINES = """b AS (SELECT metric_name, m.source, detected_language AS language, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n
    FROM metrics m JOIN languages l USING (article_id) WHERE rank = 1 GROUP BY ALL HAVING count(*) >= 2)"""


# normalisation -------------------------------------------------------------------------


@register(f"""WITH {BASELINES}
    SELECT date_trunc('day', m.timestamp)::TIMESTAMP AS bucket, m.source, m.metric_name, round(avg((value - mu) / sd), 6) AS value, count(*) AS count
    FROM metrics m LEFT JOIN languages l USING (article_id) JOIN b ON b.metric_name = m.metric_name AND b.source = m.source AND b.language = l.detected_language
    WHERE sd > 0 GROUP BY ALL""", "metrics", "languages")
def g1_zscore_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = timeseries.spoken_states(views.metrics(spark, sf_dir), views.languages(spark, sf_dir))
    return rounded(timeseries.zscores_of(states, timeseries.baselines_of(states)))


@register("SELECT count(*) AS excluded FROM metrics m WHERE NOT EXISTS (SELECT 1 FROM languages l WHERE l.article_id = m.article_id AND l.detected_language <> 'fr')", "metrics", "languages")
def g2_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.excluded_count(views.metrics(spark, sf_dir), views.languages(spark, sf_dir).where("detected_language <> 'fr'"))


@register("""WITH r AS (SELECT m.*, row_number() OVER w AS rn, count(*) OVER (PARTITION BY metric_name, m.source, detected_language) AS n
      FROM metrics m JOIN languages l USING (article_id) WINDOW w AS (PARTITION BY metric_name, m.source, detected_language ORDER BY value, version))
    SELECT date_trunc('day', timestamp)::TIMESTAMP AS bucket, source, metric_name, round(avg(CASE WHEN n > 1 THEN (rn - 1.0) / (n - 1) ELSE 0 END), 6) AS value, count(*) AS count FROM r GROUP BY ALL""", "metrics", "languages")
def g3_percentile_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.percentile_series(views.metrics(spark, sf_dir), views.languages(spark, sf_dir)))


@register("SELECT source, article_id, version, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY article_id, metric_name ORDER BY version DESC) AS r FROM metrics) WHERE r = 1", "metrics")
def g5_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core.latest(views.metrics(spark, sf_dir), ["article_id", "metric_name"], "version").select("source", "article_id", "version", "value"))


@register(f"WITH {BASELINES} SELECT metric_name, source, language, round(mu, 6) AS baseline_value, round(sd, 6) AS baseline_std, n AS n_documents FROM b", "metrics", "languages")
def e3_metric_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.baselines(views.metrics(spark, sf_dir), views.languages(spark, sf_dir)))


# time series ---------------------------------------------------------------------------

for _res, _expr in {"5min": "time_bucket(INTERVAL 5 MINUTE, timestamp)", "hourly": "date_trunc('hour', timestamp)", "daily": "date_trunc('day', timestamp)", "weekly": "date_trunc('week', timestamp + INTERVAL 1 DAY) - INTERVAL 1 DAY", "monthly": "date_trunc('month', timestamp)"}.items():

    @register(f"SELECT ({_expr})::TIMESTAMP AS bucket, source, metric_name, round(avg(value), 6) AS value, count(*) AS count FROM metrics GROUP BY ALL", "metrics")
    def _series(spark: SparkSession, sf_dir: str, res: str = _res) -> DataFrame:
        return rounded(timeseries.series(views.metrics(spark, sf_dir), res))

    QUERIES[f"f1_metrics_timeseries_{_res}"] = QUERIES.pop("_series")
    ORACLES[f"f1_metrics_timeseries_{_res}"] = ORACLES.pop("_series")


@register("SELECT (date_trunc('week', timestamp + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP AS bucket, source, metric_name, round(avg(value), 6) AS value, count(*) AS count FROM metrics GROUP BY ALL", "metrics")
def f2_routed_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    return rounded(timeseries.routed("weekly", m, {"daily": timeseries.rollup(m, "daily")}))


@register("SELECT date_trunc('day', timestamp)::TIMESTAMP AS bucket, source, metric_name, round(avg(value), 6) AS value, count(*) AS count, round(coalesce(stddev_samp(value), 0), 6) AS spread FROM metrics GROUP BY ALL", "metrics")
def f5_metrics_with_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.series_with_spread(views.metrics(spark, sf_dir)))


for _res, _unit in {"hourly": "hour", "daily": "day", "monthly": "month"}.items():

    @register(f"SELECT date_trunc('{_unit}', timestamp)::TIMESTAMP AS bucket, source, metric_name, round(sum(value), 4) AS sum, count(value) AS count FROM metrics GROUP BY ALL", "metrics")
    def _rollup(spark: SparkSession, sf_dir: str, res: str = _res) -> DataFrame:
        return rounded(timeseries.rollup(views.metrics(spark, sf_dir), res), 4)

    QUERIES[f"f6_metrics_{_res}"] = QUERIES.pop("_rollup")
    ORACLES[f"f6_metrics_{_res}"] = ORACLES.pop("_rollup")


@register("SELECT source, field, 'json_ld' AS method, count(DISTINCT article_id) AS articles, max(timestamp) AS last_seen FROM article_metadata GROUP BY ALL", "article_metadata")
def f7_coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.article_metadata(spark, sf_dir).select("source", "field", "article_id", F.lit("json_ld").alias("method"), F.col("timestamp").alias("seen_at"))
    return metadata.coverage_cells(rows)


@register("SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, count(DISTINCT article_id) AS articles FROM metrics GROUP BY ALL", "metrics")
def f8_hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.activity(views.metrics(spark, sf_dir))


@register("SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, round(avg(value), 6) AS value FROM metrics WHERE metric_name = 'click' GROUP BY ALL", "metrics")
def f9_hourly_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.metric_series(views.metrics(spark, sf_dir), "click"))


@register("""SELECT source, date_trunc('week', snapshot_at)::TIMESTAMP AS bucket, count(*) FILTER (revision_index > 0) AS edits, count(DISTINCT article_id) FILTER (revision_index > 0) AS articles,
      count(*) FILTER (revision_index > 0 AND revision_trigger = 'republication') AS republication, count(*) FILTER (revision_index > 0 AND revision_trigger = 'sweep') AS sweep,
      count(*) FILTER (revision_index > 0 AND revision_trigger = 'chain_head') AS chain_head FROM revisions GROUP BY ALL""", "revisions")
def f10_revision_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.activity(views.revisions(spark, sf_dir))


@register("SELECT source, date_trunc('week', snapshot_at)::TIMESTAMP AS bucket, round(CAST(sum(CAST(sentiment_delta AS DECIMAL(20, 8))) AS DOUBLE) / count(sentiment_delta), 6) AS mean_delta, round(CAST(sum(CAST(sentiment_delta AS DECIMAL(20, 8))) AS DOUBLE), 6) AS sum_delta, count(sentiment_delta) AS scored FROM revisions WHERE revision_index > 0 GROUP BY ALL HAVING count(sentiment_delta) > 0", "revisions")
def f11_revision_discourse_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(revisions.discourse_shift(views.revisions(spark, sf_dir)))


@register("SELECT source, count(DISTINCT article_id) AS articles FROM silver GROUP BY ALL", "silver")
def f12_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.document_totals(views.silver(spark, sf_dir))


@register("SELECT count(DISTINCT article_id) AS articles FROM metrics WHERE source = 'src3' AND metric_name = 'click' AND CAST(timestamp AS DATE) = DATE '2024-01-10'", "metrics")
def f13_aggregation_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.group_count(views.metrics(spark, sf_dir), "src3", "click", "2024-01-10")


@register(f"""WITH n AS (SELECT source, max(timestamp) AS last_seen, min(timestamp) AS first_seen FROM silver GROUP BY source)
    SELECT source, count(DISTINCT article_id) AS total, count(DISTINCT article_id) FILTER (timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}') AS in_window,
      count(DISTINCT article_id) FILTER (timestamp > last_seen - INTERVAL 7 DAY) AS recent, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
      round(count(DISTINCT article_id) FILTER (timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}') / 14.0, 6) AS per_day,
      round(count(DISTINCT article_id) FILTER (timestamp > last_seen - INTERVAL 7 DAY) / 7.0, 6) AS recent_per_day
    FROM silver JOIN n USING (source) GROUP BY source""", "silver")
def f14_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.source_counts(views.silver(spark, sf_dir), START, END))


# distributions -------------------------------------------------------------------------

_Q = ", ".join(f"round(list_sort(list(value))[least(CAST(floor({p} * count(*)) AS BIGINT), count(*) - 1) + 1], 6) AS p{round(p * 100):02d}" for p in distribution.QUANTILES)
SUMMARY = f"count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, {_Q}"


@register(f"SELECT {SUMMARY} FROM metrics WHERE metric_name = 'click' AND timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'", "metrics")
def h1_distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.summary(core.in_scope(views.metrics(spark, sf_dir), metric="click", start=START, end=END), "value"))


HISTOGRAM = """WITH v AS (SELECT {seg} AS seg, {value} AS value FROM {rows}),
    q AS (SELECT seg, count(*) AS n, min(value) AS lo, max(value) AS mx, list_sort(list(value)) AS s FROM v GROUP BY seg),
    f AS (SELECT *, s[least(CAST(floor(0.25 * n) AS BIGINT), n - 1) + 1] AS q1, s[least(CAST(floor(0.75 * n) AS BIGINT), n - 1) + 1] AS q3 FROM q),
    g AS (SELECT seg, lo, {clamp} AND q3 + 1.5 * (q3 - q1) < mx AND q3 + 1.5 * (q3 - q1) > lo AS clamped, CASE WHEN {clamp} AND q3 + 1.5 * (q3 - q1) < mx AND q3 + 1.5 * (q3 - q1) > lo THEN q3 + 1.5 * (q3 - q1) ELSE mx END AS hi FROM f),
    w AS (SELECT *, (hi - lo) / {bins} AS width FROM g),
    b AS (SELECT *, unnest(range(0, CASE WHEN width > 0 THEN {bins} ELSE 1 END)) AS bin FROM w),
    c AS (SELECT seg, CASE WHEN clamped AND value >= hi THEN -1 WHEN width > 0 THEN greatest(least(CAST(floor((value - lo) / width) AS BIGINT), {bins} - 1), 0) ELSE 0 END AS bin, count(*) AS n FROM v JOIN w USING (seg) GROUP BY ALL)
    SELECT {out}CAST(b.bin AS INT) AS bin, round(lo + b.bin * width, 6) AS lower, round(CASE WHEN width > 0 THEN lo + (b.bin + 1) * width ELSE hi END, 6) AS upper, coalesce(c.n, 0) AS count, coalesce(o.n, 0) AS overflow
    FROM b LEFT JOIN c ON c.seg = b.seg AND c.bin = b.bin LEFT JOIN c o ON o.seg = b.seg AND o.bin = -1"""


@register(HISTOGRAM.format(seg="1", value="value", rows="metrics WHERE metric_name = 'click'", clamp="true", bins=20, out=""), "metrics")
def h2_distribution_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.histogram(views.metrics(spark, sf_dir).where("metric_name = 'click'"), "value", 20))


@register(HISTOGRAM.format(seg="source", value="value", rows="metrics WHERE metric_name = 'view'", clamp="true", bins=10, out="b.seg AS source, "), "metrics")
def h3_histogram_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.histogram(views.metrics(spark, sf_dir).where("metric_name = 'view'"), "value", 10, by=["source"]))


@register("SELECT CAST(isodow(timestamp) AS VARCHAR) AS x, CAST(hour(timestamp) AS VARCHAR) AS y, round(avg(value), 6) AS value, count(*) AS count FROM metrics GROUP BY ALL", "metrics")
def h4_heatmap_weekday_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.heatmap(views.metrics(spark, sf_dir), "dayOfWeek", "hour"))


@register("SELECT entity_label AS x, detected_language AS y, round(avg(value), 6) AS value, count(*) AS count FROM doc_metrics m JOIN entities e USING (article_id) JOIN languages l USING (article_id) WHERE metric_name = 'word_count' GROUP BY ALL", "doc_metrics", "entities", "languages")
def h4_heatmap_entity_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.doc_metrics(spark, sf_dir).where("metric_name = 'word_count'")
    return rounded(distribution.heatmap(m, "entityLabel", "language", views.entities(spark, sf_dir), views.languages(spark, sf_dir)))


@register("""WITH m AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS b, metric_name, avg(value) AS v FROM metrics WHERE metric_name IN ('click', 'view', 'purchase') GROUP BY ALL),
    n AS (SELECT unnest(['click', 'view', 'purchase']) AS a), p AS (SELECT x.a AS a, y.a AS b FROM n x, n y)
    SELECT p.a, p.b, CASE WHEN count(x.v) < 2 OR stddev_samp(x.v) * stddev_samp(y.v) = 0 THEN NULL ELSE round(covar_samp(x.v, y.v) / (stddev_samp(x.v) * stddev_samp(y.v)), 6) END AS r, count(x.v) AS n
    FROM p LEFT JOIN (m x JOIN m y ON x.b = y.b) ON x.metric_name = p.a AND y.metric_name = p.b GROUP BY p.a, p.b""", "metrics")
def h5_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.correlation_matrix(views.metrics(spark, sf_dir), ["click", "view", "purchase"], "hourly"))


LAGS = """WITH x AS (SELECT epoch(date_trunc('hour', timestamp)) AS h, {x} AS v FROM metrics WHERE {wx} GROUP BY 1), y AS (SELECT epoch(date_trunc('hour', timestamp)) AS h, {y} AS v FROM metrics WHERE {wy} GROUP BY 1),
    l AS (SELECT CAST(unnest(range(-{most}, {most} + 1)) AS INT) AS lag)
    SELECT lag, CASE WHEN count(y.v) < 2 OR stddev_samp(x.v) * stddev_samp(y.v) = 0 THEN NULL ELSE round(covar_samp(x.v, y.v) / (stddev_samp(x.v) * stddev_samp(y.v)), 6) END AS r, count(y.v) AS n
    FROM l LEFT JOIN (SELECT * FROM l l2, x x2) z(lag2, h, v) ON lag = lag2 LEFT JOIN x ON x.h = z.h LEFT JOIN y ON y.h = z.h + lag * 3600 WHERE y.v IS NOT NULL GROUP BY lag"""


@register(LAGS.format(x="avg(value)", wx="metric_name = 'click'", y="avg(value)", wy="metric_name = 'view'", most=24), "metrics")
def h6_metric_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    return rounded(distribution.lead_lag(timeseries.metric_series(m, "click"), timeseries.metric_series(m, "view"), 24))


@register(LAGS.format(x="CAST(count(DISTINCT article_id) AS DOUBLE)", wx="source IN ('src0', 'src1')", y="CAST(count(DISTINCT article_id) AS DOUBLE)", wy="source IN ('src2', 'src3')", most=12), "metrics")
def h7_probe_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    act = lambda *s: timeseries.activity(core.in_scope(m, s)).select("bucket", F.col("articles").cast("double").alias("value"))
    return rounded(distribution.lead_lag(act("src0", "src1"), act("src2", "src3"), 12))


@register("SELECT article_id, round(avg(value) FILTER (metric_name = 'word_count'), 6) AS x, round(avg(value) FILTER (metric_name = 'n_chars'), 6) AS y, round(avg(value) FILTER (metric_name = 'quality'), 6) AS size, CAST(NULL AS DOUBLE) AS color FROM doc_metrics GROUP BY article_id HAVING x IS NOT NULL AND y IS NOT NULL ORDER BY article_id LIMIT 10000", "doc_metrics")
def h8_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.scatter(views.doc_metrics(spark, sf_dir), "word_count", "n_chars", "quality"))


@register("SELECT article_id, round(avg(value) FILTER (metric_name = 'word_count'), 6) AS a0, round(avg(value) FILTER (metric_name = 'n_chars'), 6) AS a1, round(avg(value) FILTER (metric_name = 'toxic'), 6) AS a2 FROM doc_metrics GROUP BY article_id HAVING a0 IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL ORDER BY article_id LIMIT 3000", "doc_metrics")
def h9_parallel_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.parallel_coordinates(views.doc_metrics(spark, sf_dir), ["word_count", "n_chars", "toxic"]))


@register(HISTOGRAM.format(seg="1", value="CAST(word_count AS DOUBLE)", rows="silver", clamp="false", bins=30, out=""), "silver")
def h24_silver_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.silver(spark, sf_dir).select(F.col("word_count").cast("double").alias("word_count"))
    return rounded(distribution.histogram(docs, "word_count", 30, clamp=False))


@register("SELECT source AS x, CAST(isodow(timestamp) AS VARCHAR) AS y, round(avg(word_count), 6) AS value, count(*) AS count FROM silver GROUP BY ALL", "silver")
def h25_silver_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.heatmap(views.silver(spark, sf_dir), "source", "dayOfWeek", value="word_count"))


@register("SELECT round(covar_samp(len, word_count) / (stddev_samp(len) * stddev_samp(word_count)), 6) AS r, count(*) AS n FROM doc_base", "doc_base")
def h26_silver_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.silver_correlation(views.silver(spark, sf_dir)))


# metadata ------------------------------------------------------------------------------


@register("""WITH v AS (SELECT article_id, unnest(value) AS value FROM article_metadata WHERE field = 'labels'), c AS (SELECT value, count(DISTINCT article_id) AS articles FROM v GROUP BY value),
    r AS (SELECT *, row_number() OVER (ORDER BY articles DESC, value) AS k FROM c)
    SELECT value, articles, (SELECT count(DISTINCT article_id) FROM v) AS total_articles, (SELECT count(*) FROM c) AS distinct_values, CAST((SELECT coalesce(sum(articles), 0) FROM r WHERE k > 2) AS BIGINT) AS other_value_articles FROM r WHERE k <= 2""", "article_metadata")
def h10_categorical_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.categorical(views.article_metadata(spark, sf_dir), "labels", 2)


@register("""WITH v AS (SELECT DISTINCT article_id, unnest(value) AS value FROM article_metadata WHERE field = 'length_band'), m AS (SELECT article_id, avg(value) AS m FROM doc_metrics WHERE metric_name = 'word_count' GROUP BY article_id)
    SELECT value, count(DISTINCT article_id) AS articles, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std FROM v JOIN m USING (article_id) GROUP BY value""", "article_metadata", "doc_metrics")
def h11_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metadata.cross_tab(views.article_metadata(spark, sf_dir), views.doc_metrics(spark, sf_dir), "length_band", "word_count"))


@register("""WITH v AS (SELECT article_id, field, unnest(value) AS value FROM article_metadata),
    a AS (SELECT '0::' || x.value AS from_node, '1::' || y.value AS to_node, count(DISTINCT x.article_id) AS articles FROM v x JOIN v y USING (article_id) WHERE x.field = 'language' AND y.field = 'length_band' GROUP BY ALL),
    b AS (SELECT '1::' || x.value AS from_node, '2::' || y.value AS to_node, count(DISTINCT x.article_id) AS articles FROM v x JOIN v y USING (article_id) WHERE x.field = 'length_band' AND y.field = 'labels' GROUP BY ALL)
    SELECT * FROM a UNION ALL SELECT * FROM b""", "article_metadata")
def h12_sankey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.sankey(views.article_metadata(spark, sf_dir), ["language", "length_band", "labels"])


CELLS = "c AS (SELECT source, field, CASE WHEN field = 'labels' THEN 'null' ELSE 'json_ld' END AS method, count(DISTINCT article_id) AS articles FROM article_metadata GROUP BY ALL)"
COVER = "s AS (SELECT source, field, CAST(sum(articles) AS BIGINT) AS total, CAST(sum(CASE WHEN method <> 'null' THEN articles ELSE 0 END) AS BIGINT) AS populated FROM c GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.article_metadata(spark, sf_dir).withColumn("method", F.when(F.col("field") == "labels", "null").otherwise("json_ld")).withColumnRenamed("timestamp", "seen_at")
    return metadata.coverage(metadata.coverage_cells(rows))


@register(f"WITH {CELLS}, {COVER} SELECT *, round(populated / total, 6) AS rate, total >= 50 AND populated = 0 AS structurally_absent FROM s", "article_metadata")
def h30_metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir))


@register(f"WITH {CELLS}, {COVER} SELECT field, CAST(sum(total) AS BIGINT) AS total, CAST(sum(populated) AS BIGINT) AS populated, count(*) AS sources_observed, count(*) FILTER (populated > 0) AS sources_populated, round(sum(populated) / sum(total), 6) AS rate FROM s GROUP BY field", "article_metadata")
def h32_global_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metadata.global_field_stats(_cells(spark, sf_dir)))


@register("""WITH u AS (SELECT source, field AS name, unnest(value) AS v FROM article_metadata UNION ALL SELECT source, metric_name, CAST(value AS VARCHAR) FROM doc_metrics)
    SELECT source, name, count(DISTINCT v) AS distinct_values, count(DISTINCT v) = 1 AS constant FROM u GROUP BY ALL""", "article_metadata", "doc_metrics")
def h31_field_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.field_cardinality(views.article_metadata(spark, sf_dir), views.doc_metrics(spark, sf_dir))


@register("""WITH c AS (SELECT metric_name, value, count(*) AS n FROM doc_metrics GROUP BY ALL), k AS (SELECT metric_name, count(*) AS d, max(n) AS most, sum(n) AS rows FROM c GROUP BY ALL),
    t AS (SELECT c.metric_name, min(value) AS dominant FROM c JOIN k ON k.metric_name = c.metric_name AND n = most GROUP BY c.metric_name), s AS (SELECT metric_name, count(DISTINCT source) AS sources FROM doc_metrics GROUP BY ALL)
    SELECT metric_name, sources, sources = (SELECT count(DISTINCT source) FROM doc_metrics) AS in_all_sources, d AS distinct_values, dominant, round(most / rows, 6) AS dominant_share,
      CASE WHEN d <= 1 THEN 'degenerate' WHEN d <= 2 OR most / rows >= 0.85 THEN 'low_signal' ELSE 'usable' END AS class FROM s JOIN k USING (metric_name) JOIN t USING (metric_name)""", "doc_metrics")
def h28_scope_available_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.doc_metrics(spark, sf_dir)
    return rounded(metadata.available_metrics(m, m.select("source").distinct().count()))


@register("""WITH v AS (SELECT article_id, source, field, unnest(value) AS value FROM article_metadata), t AS (SELECT field, count(DISTINCT article_id) AS articles, count(DISTINCT source) AS sources FROM v GROUP BY ALL),
    k AS (SELECT field, count(*) AS d, max(n) AS most FROM (SELECT field, value, count(DISTINCT article_id) AS n FROM v GROUP BY ALL) GROUP BY ALL), p AS (SELECT field, max(d) = 1 AS constant_in_source FROM (SELECT field, source, count(DISTINCT value) AS d FROM v GROUP BY ALL) GROUP BY ALL)
    SELECT field, articles, sources = (SELECT count(DISTINCT source) FROM v) AS in_all_sources, d AS distinct_values, round(most / articles, 6) AS dominant_share, constant_in_source,
      CASE WHEN d <= 1 THEN 'degenerate' WHEN most / articles >= 0.85 THEN 'low_signal' ELSE 'usable' END AS class FROM t JOIN k USING (field) JOIN p USING (field)""", "article_metadata")
def h29_scope_available_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.article_metadata(spark, sf_dir)
    return rounded(metadata.available_fields(m, m.select("source").distinct().count()))


@register("""WITH v AS (SELECT article_id, unnest(value) AS value FROM article_metadata WHERE field = 'language'), r AS (SELECT value, row_number() OVER (ORDER BY count(DISTINCT article_id) DESC, value) AS k FROM v GROUP BY value)
    SELECT v.value, round(avg(m.value), 6) AS mean, count(*) AS rows, (SELECT count(*) > 3 FROM r) AS capped FROM v JOIN r ON r.value = v.value AND k <= 3 JOIN doc_metrics m ON m.article_id = v.article_id AND metric_name = 'n_chars' GROUP BY v.value""", "article_metadata", "doc_metrics")
def r4_facet_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metadata.facet_fan_out(views.article_metadata(spark, sf_dir), views.doc_metrics(spark, sf_dir), "language", "n_chars", 3))


@register("SELECT article_id, metric_name, value FROM doc_metrics WHERE article_id IN (SELECT article_id FROM article_metadata WHERE field = 'labels' AND list_contains(value, 'toxic:1'))", "doc_metrics", "article_metadata")
def b4_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.with_array_value(views.doc_metrics(spark, sf_dir), views.article_metadata(spark, sf_dir), "labels", "toxic:1").select("article_id", "metric_name", "value")


@register("SELECT DISTINCT article_id FROM entities WHERE contains(lower(entity_text), 'ther')", "entities")
def b5_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities(spark, sf_dir).where(core.contains_ci(F.col("entity_text"), "THER")).select("article_id").distinct()


# networks ------------------------------------------------------------------------------


@register("SELECT entity_text, entity_label, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM entities GROUP BY ALL ORDER BY mentions DESC, entity_text, entity_label LIMIT 100", "entities")
def h13_entity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.entity_ranking(views.entities(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@register("SELECT detected_language, count(*) AS detections, round(avg(confidence), 6) AS confidence, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM languages GROUP BY ALL", "languages")
def h14_language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.language_distribution(views.languages(spark, sf_dir)).withColumn("sources", F.array_join("sources", ",")))


COOC = "n AS (SELECT article_id, source, entity_text AS t, entity_label AS l, count(*) AS n FROM brands GROUP BY ALL), p AS (SELECT a.article_id, a.source, a.t AS a_text, b.t AS b_text, least(a.n, b.n) AS weight FROM n a JOIN n b ON a.article_id = b.article_id AND a.source = b.source AND a.t < b.t), e AS (SELECT a_text, b_text, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT article_id) AS articles FROM p GROUP BY ALL)"
ENDS = "t AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS total FROM (SELECT a_text AS node, weight FROM e UNION ALL SELECT b_text, weight FROM e) GROUP BY node)"


def _cooc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pairs(views.brands(spark, sf_dir))


@register(f"WITH {COOC} SELECT article_id, a_text, b_text, weight FROM p", "brands")
def e1_cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cooc(spark, sf_dir).select("article_id", "a_text", "b_text", "weight")


@register("SELECT article_id, count(DISTINCT entity_text) AS entities FROM brands WHERE article_id NOT IN (SELECT article_id FROM brands WHERE source <> 'src3') GROUP BY article_id HAVING count(DISTINCT entity_text) >= 2", "brands")
def e2_gap_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.gap_articles(views.brands(spark, sf_dir), _cooc(spark, sf_dir).where("source <> 'src3'"))


@register(f"WITH {COOC} SELECT * FROM e WHERE weight >= 2 ORDER BY weight DESC, a_text, b_text LIMIT 50", "brands")
def h16_cooccurrence_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.edge_first(_cooc(spark, sf_dir), 50, 2)


@register(f"""WITH {COOC}, {ENDS}, u AS (SELECT node FROM t ORDER BY total DESC, node LIMIT 10), a AS (SELECT * FROM e WHERE a_text IN (FROM u) AND b_text IN (FROM u)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a_text ORDER BY weight DESC, a_text, b_text) AS ra, row_number() OVER (PARTITION BY b_text ORDER BY weight DESC, a_text, b_text) AS rb FROM a)
    SELECT a_text, b_text, weight, articles FROM r WHERE least(ra, rb) <= 2""", "brands")
def h17_cooccurrence_node_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.node_first(_cooc(spark, sf_dir), 10, 20)[1]


@register(f"WITH {COOC}, {ENDS} SELECT node, degree, total FROM t", "brands")
def h16_node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.nodes_of(network.edges(_cooc(spark, sf_dir)))


@register(f"WITH {COOC} SELECT a_text, b_text, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM p GROUP BY ALL", "brands")
def h18_edge_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cooc(spark, sf_dir)
    return network.edge_presence(c, network.edges(c)).withColumn("sources", F.array_join("sources", ","))


@register(f"WITH {COOC} SELECT node, source, count(DISTINCT article_id) AS articles FROM (SELECT a_text AS node, source, article_id FROM p UNION ALL SELECT b_text, source, article_id FROM p) GROUP BY ALL", "brands")
def h18_node_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.node_presence(_cooc(spark, sf_dir))


@register("SELECT entity_text, round(avg(m), 6) AS value FROM (SELECT DISTINCT article_id, entity_text FROM entities) JOIN (SELECT article_id, avg(value) AS m FROM doc_metrics WHERE metric_name = 'word_count' GROUP BY article_id) USING (article_id) GROUP BY entity_text", "entities", "doc_metrics")
def h19_node_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.node_metric(views.entities(spark, sf_dir), views.doc_metrics(spark, sf_dir), "word_count"))


@register("SELECT count(*) AS articles FROM (SELECT article_id FROM entities GROUP BY article_id HAVING count(DISTINCT entity_text || '|' || entity_label) >= 2)", "entities")
def h21_articles_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.articles_in_scope(views.entities(spark, sf_dir))


@register(f"WITH {COOC} SELECT a_text, b_text, count(DISTINCT CASE WHEN CAST(article_id AS BIGINT) % 5 = 0 THEN article_id END) AS undated FROM p GROUP BY ALL", "brands")
def h22_undated_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.brands(spark, sf_dir)
    return network.undated_overlay(network.pairs(b), b.where(F.col("article_id").cast("long") % 5 == 0))


# revisions -----------------------------------------------------------------------------


@register("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY article_id, content_hash ORDER BY CASE WHEN revision_trigger = 'republication' THEN 0 ELSE 1 END, snapshot_at) AS k FROM revisions),
    o AS (SELECT article_id, snapshot_at, content_hash, row_number() OVER w - 1 AS revision_index, coalesce(lag(content_hash) OVER w, '') AS prev_content_hash, coalesce(round((epoch(snapshot_at) - epoch(lag(snapshot_at) OVER w)) / 3600.0, 6), 0) AS time_since_prev_hours FROM f WHERE k = 1 WINDOW w AS (PARTITION BY article_id ORDER BY snapshot_at, content_hash))
    SELECT * FROM o WHERE revision_index < 20""", "revisions")
def e7_revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.revisions(spark, sf_dir).drop("revision_index")
    return rounded(revisions.chain(r).select("article_id", "snapshot_at", "content_hash", "revision_index", "prev_content_hash", "time_since_prev_hours"))


@register("SELECT r.article_id, r.revision_index, r.snapshot_at, p.snapshot_at AS prev_at FROM revisions r LEFT JOIN revisions p ON p.article_id = r.article_id AND p.revision_index = r.revision_index - 1 WHERE r.revision_index > 0 AND NOT r.headline_changed ORDER BY r.snapshot_at DESC, r.article_id, r.revision_index LIMIT 100", "revisions")
def e8_undiffed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.undiffed_pairs(views.revisions(spark, sf_dir), F.col("headline_changed"), 100).select("article_id", "revision_index", "snapshot_at", "prev_at")


@register("SELECT r.article_id, min(r.source) AS source, 'revision_count' AS metric_name, CAST(count(*) FILTER (revision_index > 0 AND revision_trigger <> 'sweep') AS DOUBLE) AS value, coalesce(max(s.timestamp), max(snapshot_at)) AS timestamp FROM revisions r LEFT JOIN silver s USING (article_id) GROUP BY r.article_id", "revisions", "silver")
def e13_revision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.revision_counts(views.revisions(spark, sf_dir), views.silver(spark, sf_dir))


@register("SELECT article_id, content_hash AS digest, min(snapshot_at) AS snapshot_at FROM revisions WHERE revision_trigger <> 'sweep' GROUP BY ALL", "revisions")
def e16_collapsed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.revisions(spark, sf_dir).select("article_id", F.col("content_hash").alias("digest"), "snapshot_at", F.when(F.col("revision_trigger") == "sweep", 404).otherwise(200).alias("status"))
    return revisions.collapsed_snapshots(r).select("article_id", "digest", "snapshot_at")


@register("""SELECT date_trunc('day', snapshot_at)::TIMESTAMP AS bucket, entity, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS edits, round(avg(sentiment_delta), 6) AS mean_delta
    FROM (SELECT *, 'e' || CAST(CAST(content_hash AS BIGINT) % 50 AS VARCHAR) AS entity FROM revisions WHERE revision_index > 0) GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2 ORDER BY edits DESC, bucket, entity LIMIT 200""", "revisions")
def h34_edit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.array(F.concat(F.lit("e"), (F.col("content_hash").cast("long") % 50).cast("string")))
    return rounded(revisions.edit_clusters(views.revisions(spark, sf_dir), touched).withColumn("sources", F.array_join("sources", ",")))


@register("""SELECT article_id, revision_index, CASE WHEN revision_trigger = 'sweep' THEN 'identical' WHEN revision_trigger = 'republication' OR headline_changed THEN 'changed' ELSE 'pending' END AS diff_status FROM revisions""", "revisions")
def h35_revision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.when(F.col("revision_trigger") == "sweep", F.array(F.lit('{"op": "identical"}'))).when(F.col("revision_trigger") == "republication", F.array(F.lit('{"op": "add"}'))).otherwise(F.array().cast("array<string>"))
    return revisions.with_status(views.revisions(spark, sf_dir).withColumn("ops", ops)).select("article_id", "revision_index", "diff_status")


@register("SELECT r.article_id, r.revision_index, r.content_hash, p.content_hash AS prev_hash FROM revisions r LEFT JOIN revisions p ON p.article_id = r.article_id AND p.revision_index = r.revision_index - 1 WHERE r.revision_index > 0", "revisions")
def h36_revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.diff_pair(views.revisions(spark, sf_dir)).select("article_id", "revision_index", "content_hash", "prev_hash")


@register("SELECT article_id, min(source) AS source, count(*) AS chain_length, count(*) FILTER (revision_index > 0) AS edits, bool_or(headline_changed) AS headline_changed, max(snapshot_at) AS last_edit FROM revisions GROUP BY article_id HAVING count(*) FILTER (revision_index > 0) >= 1 AND count(*) >= 3 ORDER BY last_edit DESC, article_id LIMIT 50 OFFSET 10", "revisions")
def h37_revisions_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.edited_articles(views.revisions(spark, sf_dir), 3, 50, 10)


# extractors ----------------------------------------------------------------------------


@register("SELECT article_id, 'word_count' AS metric_name, word_count AS value FROM doc_base UNION ALL SELECT article_id, 'publication_hour', CAST(hour(timestamp) AS DOUBLE) FROM doc_base UNION ALL SELECT article_id, 'publication_weekday', CAST(isodow(timestamp) - 1 AS DOUBLE) FROM doc_base", "doc_base")
def d1_d2_document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "source", views.doc_time("doc_id").alias("timestamp"), "text")
    return extract.document_facts(d).select("article_id", "metric_name", "value")


#: A small lexicon for the oracle check of the sentiment operator.
LEXICON = [("the", 0.125), ("and", 0.25), ("idiot", -0.75), ("is", 0.0625), ("nicht", -0.25), ("la", 0.1875)]
_LEX = ", ".join(f"('{w}', {v})" for w, v in LEXICON)


@register(f"""WITH lex(word, weight) AS (VALUES {_LEX}), t AS (SELECT article_id, trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~') AS word FROM (SELECT article_id, unnest(regexp_split_to_array(lower(text), '[ \\n\\t]+')) AS w FROM doc_base))
    SELECT article_id, round(greatest(least(avg(CAST(weight AS DOUBLE)), 1.0), -1.0), 4) AS value FROM t JOIN lex USING (word) GROUP BY article_id""", "doc_base")
def d6b_lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
    return extract.lexicon_sentiment(d, spark.createDataFrame(LEXICON, "word string, weight double"))


# catalogue, links, topics --------------------------------------------------------------


def _grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, "metric_name string, language string, equivalence_level string, notes string")


#: Constant grants for the governance queries; the SQL has the same rows.
GRANTS = [("click", "de", "deviation", "n1"), ("click", "en", "absolute", "n2"), ("click", "fr", "deviation", "n3"), ("click", "es", "absolute", "n4"), ("view", "de", "absolute", "n5"), ("purchase", "en", "temporal", "n6"), ("purchase", "de", "temporal", "n7")]
GRANT_SQL = "g(metric_name, language, equivalence_level, notes) AS (VALUES " + ", ".join(str(x) for x in GRANTS) + "), k AS (SELECT *, CASE equivalence_level WHEN 'temporal' THEN 1 WHEN 'deviation' THEN 2 WHEN 'absolute' THEN 3 ELSE 0 END AS r FROM g)"


@register("""WITH w AS (SELECT article_id, min(source) AS source, max(timestamp) AS timestamp, round(avg(value) FILTER (metric_name = 'word_count'), 6) AS word_count, CAST(NULL AS DOUBLE) AS sentiment FROM doc_metrics GROUP BY article_id ORDER BY timestamp DESC, article_id LIMIT 50 OFFSET 5)
    SELECT w.*, l.detected_language AS language, coalesce(n, 0) AS revisions FROM w LEFT JOIN languages l USING (article_id) LEFT JOIN (SELECT article_id, count(*) AS n FROM revisions GROUP BY article_id) USING (article_id)""", "doc_metrics", "languages", "revisions")
def h33_article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue.article_list(views.doc_metrics(spark, sf_dir), views.languages(spark, sf_dir), views.revisions(spark, sf_dir), 50, 5))


@register(f"""WITH {GRANT_SQL}, s AS (SELECT DISTINCT detected_language AS language FROM languages), c AS (SELECT metric_name, count(DISTINCT language) FILTER (equivalence_level IN ('deviation', 'absolute')) AS two, count(DISTINCT language) FILTER (equivalence_level = 'absolute') AS three FROM g JOIN s USING (language) GROUP BY metric_name)
    SELECT metric_name, CASE WHEN two = (SELECT count(*) FROM s) AND three = (SELECT count(*) FROM s) THEN 3 WHEN two = (SELECT count(*) FROM s) THEN 2 ELSE 1 END AS level FROM c""", "languages")
def h38_probe_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.probe_equivalence(views.languages(spark, sf_dir), _grants(spark))


@register(f"WITH {GRANT_SQL} SELECT metric_name, arg_max(equivalence_level, r) AS level, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM k GROUP BY metric_name")
def h44_equivalence_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.equivalence_by_metric(_grants(spark)).withColumn("languages", F.array_join("languages", ","))


@register(f"WITH {GRANT_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY r DESC, equivalence_level DESC, notes DESC) AS p FROM k) SELECT metric_name, equivalence_level AS level, notes AS cultural_context_notes FROM o WHERE p = 1")
def h43_metric_validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.validation_status(_grants(spark))


@register(f"""WITH {GRANT_SQL}, v AS (SELECT event_type AS metric_name, max(ts) AS until FROM events WHERE event_type <> 'view' GROUP BY event_type), n AS (SELECT DISTINCT event_type AS metric_name FROM events), e AS (SELECT metric_name, arg_max(equivalence_level, r) AS level FROM k GROUP BY metric_name)
    SELECT metric_name, CASE WHEN until IS NULL THEN 'unvalidated' WHEN until > TIMESTAMP '2024-01-30 23:00:00' THEN 'validated' ELSE 'expired' END AS validation, level FROM n LEFT JOIN v USING (metric_name) LEFT JOIN e USING (metric_name)""")
def h27_available_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    validity = m.where("metric_name <> 'view'").select("metric_name", F.col("timestamp").alias("valid_until"))
    return catalogue.available(m, validity, _grants(spark), "2024-01-30 23:00:00").drop("languages")


RUNS = "r AS (SELECT 'ch' || CAST(user_id % 6 AS VARCHAR) AS channel, CAST(ts AS DATE) AS day, count(*) AS discovered, count(DISTINCT user_id) AS after_dedup FROM events GROUP BY ALL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").withColumn("channel", F.concat(F.lit("ch"), (F.col("user_id") % 6).cast("string"))).withColumn("day", F.to_date("ts"))
    out = e.groupBy("channel", "day").agg(F.count(F.lit(1)).alias("discovered"), F.countDistinct("user_id").alias("after_dedup"))
    return out.withColumn("run_at", F.col("day").cast("timestamp_ntz")).withColumn("indeterminate", F.col("channel") == "ch5").withColumn("declared", F.when(F.col("channel") != "ch4", F.col("discovered") * 2))


@register(f"WITH {RUNS}, l AS (SELECT channel, arg_max(discovered, day) AS discovered, arg_max(after_dedup, day) AS after_dedup FROM r GROUP BY channel), m AS (SELECT channel, round(avg(discovered), 6) AS mean_discovered FROM r WHERE day >= DATE '2024-01-24' GROUP BY channel) SELECT channel, discovered, after_dedup, mean_discovered, coalesce(discovered < 0.9 * mean_discovered, false) AS underflow FROM l LEFT JOIN m USING (channel)")
def h39_discovery_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue.underflow(catalogue.discovery_coverage(_runs(spark, sf_dir), 7, "2024-01-31"), 0.9)).select("channel", "discovered", "after_dedup", "mean_discovered", "underflow")


@register(f"WITH {RUNS}, l AS (SELECT channel, arg_max(discovered, day) * 2 AS declared FROM r GROUP BY channel) SELECT CAST(sum(declared) FILTER (channel NOT IN ('ch4', 'ch5')) AS BIGINT) AS declared, 'ch4,ch5' AS indeterminate, 277 AS gold, round(277.0 / sum(declared) FILTER (channel NOT IN ('ch4', 'ch5')), 6) AS ratio FROM l")
def h40_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = catalogue.discovery_coverage(_runs(spark, sf_dir), 7, "2024-01-31")
    return rounded(catalogue.completeness(channels, 277).withColumn("indeterminate", F.array_join("indeterminate", ",")))


FUNNEL = "f AS (SELECT CAST(ts AS DATE) AS run_id, count(*) FILTER (event_type = 'click') AS discovered, count(*) FILTER (event_type = 'view') AS fetched, count(*) FILTER (event_type = 'purchase') AS thin, 0 AS failed, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS submitted FROM events GROUP BY ALL)"


@register(f"WITH {FUNNEL} SELECT *, round(fetched / nullif(submitted, 0), 6) AS extraction_rate, round(thin / nullif(fetched, 0), 6) AS non_article_rate FROM (SELECT run_id, discovered, fetched, thin, CAST(failed AS BIGINT) AS failed, submitted FROM f)")
def h41_m11_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = views.table(spark, sf_dir, "events").select(F.to_date("ts").alias("run_id"), F.when(kind == "click", "discovered").when(kind == "view", "fetched").when(kind == "purchase", "thin").otherwise("submitted").alias("outcome"))
    return rounded(catalogue.funnel_rates(crawl.funnel(e).withColumn("gold", F.col("fetched"))).drop("gold"))


@register(f"""WITH {RUNS}, w AS (SELECT channel, day, discovered, discovered < 60 AS low, coalesce(lag(discovered < 60) OVER o, false) AS l1, coalesce(lag(discovered < 60, 2) OVER o, false) AS l2 FROM r WINDOW o AS (PARTITION BY channel ORDER BY day))
    SELECT channel, day, discovered, CASE WHEN low AND l1 THEN 'alerted' WHEN low THEN 'pending' WHEN l1 AND l2 THEN 'recovered' ELSE 'ok' END AS state FROM w""")
def m9_underflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.underflow_states(_runs(spark, sf_dir).withColumn("floor", F.lit(60))).select("channel", "day", "discovered", "state")


@register("""WITH f AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_type AS channel, max(ts) AS lastmod FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY list_position(['view', 'click', 'purchase', 'login', 'logout', 'search', 'scroll'], channel), lastmod DESC) AS k FROM f WHERE channel IN ('view', 'click', 'purchase'))
    SELECT url, channel, lastmod FROM o WHERE k = 1""")
def m10_merged_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    found = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("channel")).agg(F.max("ts").alias("lastmod"))
    return crawl.merged_channels(found, ["view", "click", "purchase"])


@register("""WITH f AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, max(ts) AS lastmod FROM events GROUP BY 1), s AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, max(ts) FILTER (event_type = 'view') AS seen, max(ts) AS seen_at FROM events WHERE user_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT * FROM (SELECT url, lastmod, CASE WHEN seen_at IS NULL THEN 'new' WHEN lastmod > seen THEN 'changed' WHEN seen_at < TIMESTAMP '2024-01-17' THEN 'stale' END AS reason FROM f LEFT JOIN s USING (url)) WHERE reason IS NOT NULL""")
def m8_changed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").withColumn("url", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    old = e.where("user_id % 3 <> 0 AND ts < TIMESTAMP_NTZ '2024-01-20'")
    state = old.groupBy("url").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("seen_lastmod"), F.max("ts").alias("fetched_at"))
    return crawl.changed_addresses(e.groupBy("url").agg(F.max("ts").alias("lastmod")), state, "2024-01-31")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.silver(spark, sf_dir)
    topic = F.when(F.col("article_id").cast("long") % 11 == 0, -1).otherwise((F.col("article_id").cast("long") % 5).cast("int"))
    week = F.date_trunc("week", "timestamp").cast("timestamp_ntz")
    return d.select("article_id", "source", "language", "timestamp", week.alias("window_start"), (week + F.expr("INTERVAL 7 DAYS")).alias("window_end"), topic.alias("topic_id"), F.concat(F.lit("t"), topic.cast("string")).alias("topic_label"), F.when(topic == -1, 0.0).otherwise(1.0).alias("topic_confidence"), F.lit("m1").alias("model_hash"))


TOPICS = "t AS (SELECT article_id, source, language, timestamp, date_trunc('week', timestamp) AS window_start, CASE WHEN CAST(article_id AS BIGINT) % 11 = 0 THEN -1 ELSE CAST(article_id AS BIGINT) % 5 END AS topic_id FROM silver)"


@register(f"WITH {TOPICS} SELECT language, CAST(topic_id AS INT) AS topic_id, 't' || CAST(topic_id AS VARCHAR) AS label, count(DISTINCT article_id) AS articles, 1.0::DOUBLE AS confidence, 'm1' AS model FROM t WHERE window_start = (SELECT max(window_start) FROM t) AND topic_id <> -1 GROUP BY ALL", "silver")
def h15_topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.topic_distribution(_topics(spark, sf_dir))


@register(f"""WITH {TOPICS}, r AS (SELECT *, CAST(floor((epoch(timestamp) - epoch(TIMESTAMP '{START}')) * 14 / 1209600) AS INT) AS bucket FROM t WHERE timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}'),
    k AS (SELECT topic_id, row_number() OVER (ORDER BY count(DISTINCT article_id) DESC, topic_id) AS k FROM r WHERE topic_id <> -1 GROUP BY topic_id),
    n AS (SELECT r.*, CASE WHEN r.topic_id = -1 THEN 'outlier' WHEN k.k <= 3 THEN CAST(r.topic_id AS VARCHAR) ELSE 'other' END AS topic FROM r LEFT JOIN k ON k.topic_id = r.topic_id),
    f AS (SELECT topic, CAST(unnest(range(0, 14)) AS INT) AS bucket FROM (SELECT DISTINCT topic FROM n)), c AS (SELECT topic, bucket, count(DISTINCT article_id) AS articles FROM n GROUP BY ALL)
    SELECT f.topic, f.bucket, coalesce(articles, 0) AS articles FROM f LEFT JOIN c ON c.topic = f.topic AND c.bucket = f.bucket""", "silver")
def r1_topic_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.topic_evolution(_topics(spark, sf_dir), START, END, 3)


ALIASES_SQL = "l AS (SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS qid, lower(trim(p_name)) AS alias, CASE WHEN p_size % 2 = 0 THEN 'label' ELSE 'altLabel' END AS source, p_size AS sitelinks FROM part)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 2 == 0, "label").otherwise("altLabel").alias("source"), F.col("p_size").alias("sitelinks"))


@register("""WITH l AS (SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS qid, lower(trim(translate(p_name, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''))) AS alias, CASE WHEN p_size % 2 = 0 THEN 'label' ELSE 'altLabel' END AS source, p_size AS sitelinks FROM part)
    SELECT alias, qid, source, sitelinks FROM l WHERE alias <> ''""")
def e17_alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.alias_index(_labels(spark, sf_dir))


@register("""WITH l AS (SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS qid, lower(trim(translate(p_brand, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''))) AS alias, CASE WHEN p_size % 2 = 0 THEN 'label' ELSE 'altLabel' END AS source, max(p_size) AS sitelinks FROM part GROUP BY ALL),
    w AS (SELECT DISTINCT p_brand AS entity_text, lower(trim(translate(p_brand, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''))) AS alias FROM part),
    r AS (SELECT entity_text, qid, CASE source WHEN 'label' THEN 1.0 ELSE 0.85 END AS c, source, row_number() OVER (PARTITION BY entity_text ORDER BY CASE source WHEN 'label' THEN 1.0 ELSE 0.85 END DESC, sitelinks DESC, source DESC, qid) AS k FROM w JOIN l USING (alias))
    SELECT entity_text, qid AS wikidata_qid, CAST(c AS DOUBLE) AS link_confidence, source AS link_method FROM r WHERE k = 1""")
def d5_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    labels = p.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), F.col("p_brand").alias("text"), F.when(F.col("p_size") % 2 == 0, "label").otherwise("altLabel").alias("source"), F.col("p_size").alias("sitelinks"))
    return extract.entity_links(p.select(F.col("p_brand").alias("entity_text")), extract.alias_index(labels))


# embeddings, conversations, pages ------------------------------------------------------


@register("""WITH c AS (SELECT label, [%s] AS m FROM embeddings GROUP BY label), e AS (SELECT vec_id, label, embedding FROM embeddings)
    SELECT vec_id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), m) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(m, m)), 6) AS distance FROM e JOIN c USING (label)""" % ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(64)))
def e11_centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    centre = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("m"))
    return rounded(e.join(centre, "label").select("vec_id", core.cosine_distance(F.col("embedding"), F.col("m")).alias("distance")))


@register("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, sha256(coalesce(text, '')) AS content_hash, coalesce(lag(sha256(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev_content_hash FROM conversations")
def g6_previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = views.table(spark, sf_dir, "conversations").withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), "content_hash", F.coalesce(F.lag("content_hash").over(w), F.lit("")).alias("prev_content_hash"))


@register("SELECT page_id, sha256('pages' || url) AS document_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS language FROM pages")
def c2_c7_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", harmonise.document_id(F.lit("pages"), F.col("url")).alias("document_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("language"))


@register(r"""WITH b AS (SELECT page_id, html, nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '') AS article, nullif(regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1), '') AS main, nullif(array_to_string(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), ' '), '') AS paragraphs FROM pages),
    t AS (SELECT page_id, CASE WHEN article IS NOT NULL THEN 'article' WHEN main IS NOT NULL THEN 'main' WHEN paragraphs IS NOT NULL THEN 'paragraphs' ELSE 'page' END AS extraction_method,
      trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(article, main, paragraphs, html), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM b)
    SELECT page_id, extraction_method, sha256(x) AS text_hash, len(list_filter(string_split(x, ' '), lambda w: w <> '')) AS word_count FROM t""")
def c5_web_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harmonise.web(views.table(spark, sf_dir, "pages").withColumnRenamed("html", "raw_html"))
    return out.select("page_id", "extraction_method", F.sha2("cleaned_text", 256).alias("text_hash"), F.col("word_count").cast("long").alias("word_count"))


@register()
def c7_c10_resolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harmonise.resolve_fields(views.table(spark, sf_dir, "pages").withColumnRenamed("html", "raw_html"))
    return out.select("page_id", "title.value", "title.method", F.col("published.method").alias("published_method"))


@register(r"SELECT article_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{Nd}_]+'), lambda w: regexp_full_match(w, '[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+'))) AS raw_entity_count FROM doc_base", "doc_base")
def c15_raw_entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("article_id"), harmonise.capitalised(F.col("text")).cast("long").alias("raw_entity_count"))


@register("SELECT page_id, count(DISTINCT h) AS article_links, count(DISTINCT h) >= 5 AS is_listing FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1)) AS h FROM pages) WHERE regexp_matches(h, '^/[a-z]+$') GROUP BY page_id")
def a20_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.listing_pages(crawl.links(views.table(spark, sf_dir, "pages")), "^/[a-z]+$")


@register()
def d3_language_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.detections(views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text"))


@register()
def d3_agreed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    second = profiles.by_profiles(profiles.fit_profiles(d.select(F.col("lang").alias("language"), "text")))
    return extract.detections(d.select(F.col("doc_id").cast("string").alias("article_id"), "text"), second)


@register()
def d4_entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.entity_spans(views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text"))


@register()
def e5_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.topics(views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("lang").alias("language"), "text"))


@register()
def e5_density_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_topics(views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("lang").alias("language"), "text"))


@register()
def e9_paragraph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = views.table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where(F.col("before").isNotNull()).select("conv_id", "turn", F.array_join(revisions.paragraph_diff("before", "text"), "\n").alias("ops"))


@register()
def r2_all_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.communities(network.edges(_cooc(spark, sf_dir)))


@register()
def r2_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.communities(network.edge_first(_cooc(spark, sf_dir), 100))


@register()
def r2_louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.louvain(network.edges(_cooc(spark, sf_dir)))
