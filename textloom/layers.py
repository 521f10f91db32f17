"""Registered queries of ingest, harmonisation, crawl state, gates and display transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import core
from textloom.operators import catalogue, crawl, display, distribution, extract, gazetteer, harmonise, metadata, network, revisions
from textloom.plans import gates
from textloom.queries import LAGS, LEXICON, _LEX, register, rounded
from textloom.sources import files, views
from textloom.streaming import jobs



def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events")


# ingest and object state ---------------------------------------------------------------


@register("SELECT user_id AS job_id, count(*) AS documents, count(*) FILTER (event_type = 'click') AS upload_failed, count(*) FILTER (event_type = 'view') AS status_failed, CASE WHEN count(*) FILTER (event_type = 'click') = 0 THEN 'completed' WHEN count(*) FILTER (event_type = 'click') = count(*) THEN 'failed' ELSE 'completed_with_errors' END AS status FROM events GROUP BY user_id")
def a1_a19_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "click", "upload_failed").when(F.col("event_type") == "view", "status_failed").otherwise("ok")
    return crawl.job_status(events(spark, sf_dir).select(F.col("user_id").alias("job_id"), outcome.alias("outcome")))


@register("SELECT 'k' || CAST(user_id AS VARCHAR) AS object_key, arg_max(event_type, event_id) AS status, max(event_id) AS version FROM events GROUP BY user_id")
def a2_document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("object_key"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    return core.latest(log, ["object_key"], "version")


@register("SELECT DISTINCT user_id % 40 AS job_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 18:00:00'")
def a3_jobs_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = events(spark, sf_dir).select((F.col("user_id") % 40).alias("job_id"), F.col("ts").alias("ingested_at"))
    return crawl.expired(docs, docs.select("job_id").distinct(), "2024-01-31 18:00:00", 1)[1]


@register("SELECT article_id, source, language, cleaned_text_length, CAST(word_count AS INT) AS word_count, timestamp FROM silver", "silver")
def a6_silver_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").cast("string").alias("article_id"), "source", F.col("lang").alias("language"), F.col("text").alias("cleaned_text"), core.word_count(F.col("text")).alias("word_count"), views.doc_time("doc_id").alias("timestamp"))
    return files.projection(docs)


@register("SELECT article_id, metric_name, max(version) AS version FROM metrics GROUP BY ALL", "metrics")
def a7_m5_deduplicated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    return core.latest(m.unionByName(m), ["article_id", "metric_name"], "version").select("article_id", "metric_name", "version")


_REJECT = "CASE WHEN source = 'src3' THEN 'unknown_source_type' WHEN doc_id % 13 = 0 THEN 'extraction_failed' WHEN doc_id % 17 = 0 THEN 'silver_validation_failed' WHEN source IN ('src0', 'src1') AND lang NOT IN ('en', 'de') THEN 'language_scope_violation' END"


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = views.table(spark, sf_dir, "documents")
    docs = d.select("doc_id", "source", F.when(F.col("source") == "src3", "odd").otherwise("legacy").alias("source_type"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise("x").alias("raw_text"), F.when(F.col("doc_id") % 13 != 0, F.lit("x")).alias("cleaned_text"), F.col("lang").alias("language"), views.doc_time("doc_id").alias("timestamp"))
    return harmonise.split_rejects(docs, spark.createDataFrame([("src0", ["en", "de"]), ("src1", ["en", "de"])], "source string, languages array<string>"))


@register(f"SELECT doc_id, {_REJECT} AS reject_reason FROM documents WHERE {_REJECT} IS NOT NULL")
def a8_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir)[1].select("doc_id", "reject_reason")


@register(f"SELECT doc_id FROM documents WHERE {_REJECT} IS NULL")
def b14_c22_kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir)[0].select("doc_id")


@register("SELECT 'https://e.org/' || strftime(d, '%Y/%m/%d') AS url FROM (SELECT CAST(unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)")
def a12_archive_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = views.table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    return crawl.archive_addresses("https://e.org/{yyyy}/{MM}/{dd}", str(first), str(last), spark=spark).select("url")


@register("SELECT 'n' || CAST(p_partkey AS VARCHAR) AS subject, 'label' AS predicate, p_name AS object, 'en' AS lang FROM part UNION ALL SELECT 'n' || CAST(p_partkey AS VARCHAR), 'brand', p_brand, '' FROM part")
def a13_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    s = F.concat(F.lit("<n"), F.col("p_partkey").cast("string"), F.lit("> "))
    lines = p.select(F.explode(F.array(F.concat(s, F.lit('<label> "'), "p_name", F.lit('"@en .')), F.concat(s, F.lit("<brand> <"), "p_brand", F.lit("> .")), F.concat(s, F.lit('<size> "1" .')))).alias("value"))
    return crawl.triples(lines, ["label", "brand"])


@register("SELECT page_id, url FROM pages WHERE page_id = 10")
def a16_point_read(spark: SparkSession, sf_dir: str, key: int = 10) -> DataFrame:
    return crawl.point_read(views.table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", [key]).select("page_id", "url")


@register("SELECT k AS page_id, url, CASE WHEN page_id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM (VALUES (0), (3), (4), (10), (1099511627776)) v(k) LEFT JOIN pages ON page_id = k")
def a16_point_reads(spark: SparkSession, sf_dir: str, keys: Sequence[int] = (0, 3, 4, 10, 1 << 40)) -> DataFrame:
    return crawl.point_read(views.table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", keys)


@register("SELECT count(*) AS samples, round(avg(CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '-[0-9]{3,}\\.html$') THEN 1 ELSE 0 END), 6) AS numbered, round(avg(CASE WHEN ends_with(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '.html') THEN 1 ELSE 0 END), 6) AS html FROM pages")
def a21_inferred_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crawl.inferred_pattern(views.table(spark, sf_dir, "pages").select("url"))).select("samples", "numbered", "html")


@register("WITH c AS (SELECT event_type AS channel, max(n) AS observed FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1) SELECT channel, observed, CAST(floor((SELECT sum(observed) FROM c) / 2) AS BIGINT) AS floor FROM c")
def a22_floor_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.floor_seed(events(spark, sf_dir).groupBy(F.col("event_type").alias("channel"), "user_id").agg(F.count(F.lit(1)).alias("observed")))


@register("""WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS e, max(ts) AS held, count(*) % 7 AS n FROM events GROUP BY user_id)
    SELECT 'k' || CAST(u AS VARCHAR) AS object_key, CASE WHEN e IN ('click') THEN 'skip' WHEN coalesce(n, 0) >= 5 THEN 'quarantine' WHEN e = 'view' AND held < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 900 SECOND THEN 'reclaim' WHEN e = 'view' THEN 'skip' ELSE 'process' END AS action FROM (SELECT unnest(range(0, 200)) AS u UNION SELECT user_id FROM events) LEFT JOIN s ON user_id = u""")
def m3_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("e"), F.max("ts").alias("claimed_at"), (F.count(F.lit(1)) % 7).alias("attempts"))
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("object_key")
    state = e.select(key("user_id"), F.when(F.col("e") == "click", "processed").when(F.col("e") == "view", "processing").otherwise("pending").alias("status"), "claimed_at", "attempts")
    arrived = spark.range(200).select(key("id")).union(e.select(key("user_id"))).distinct()  # some of them without a state
    return jobs.claims(state, arrived, "2024-01-30 12:00:00")


@register("SELECT date_trunc('hour', ts) AS bucket, 'src' || CAST(user_id % 7 AS VARCHAR) AS source, event_type AS metric_name, round(sum(value), 4) AS sum, count(value) AS count FROM events GROUP BY ALL")
def m6_rolling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    return rounded(jobs.rolling(m), 4)


@register("SELECT event_id AS k, ts AS cached_at FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def m15_fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), F.col("event_id").alias("payload"))
    return crawl.fresh_cache(cache, "2024-01-31").select(F.col("payload").alias("k"), "cached_at")


# filters ---------------------------------------------------------------------------------


@register("SELECT source, metric_name, count(*) AS n FROM metrics WHERE source IN ('src1', 'src4') AND metric_name = 'view' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' GROUP BY ALL", "metrics")
def b1_b3_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, _ = gates.resolve_scope({"p": ["src1"]}, None, ["p"], ["src4", "src1"])
    return core.in_scope(views.metrics(spark, sf_dir), sources, "view", "2024-01-05", "2024-01-20", closed=True).groupBy("source", "metric_name").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT metric_name, count(*) AS n FROM doc_metrics WHERE article_id IN (SELECT article_id FROM languages WHERE rank = 1 AND detected_language = 'de') GROUP BY ALL", "doc_metrics", "languages")
def b6_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = views.languages(spark, sf_dir).where("rank = 1 AND detected_language = 'de'").select("article_id")
    return views.doc_metrics(spark, sf_dir).join(de, "article_id", "left_semi").groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CASE WHEN v <= -0.05 THEN 'negative' WHEN v >= 0.05 THEN 'positive' ELSE 'neutral' END AS band, count(*) AS n FROM (SELECT l_discount - 0.05 AS v FROM lineitem) GROUP BY 1")
def b7_sentiment_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("v"))
    band = F.when(core.sentiment_band(F.col("v"), "negative"), "negative").when(core.sentiment_band(F.col("v"), "positive"), "positive").otherwise("neutral")
    return v.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
def b9_tuple_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return views.table(spark, sf_dir, "lineitem").join(F.broadcast(pairs), ["l_returnflag", "l_linestatus"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT page_id, NOT (regexp_matches(p, '\\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|mp3|mp4|css|js|ico|xml)$') OR starts_with(p, '/a/') OR p = '/a' OR starts_with(p, '/th')) AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)) AS p FROM pages)")
def b11_address_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", crawl.allowed_address(F.col("url"), ["/A/", "/th"]).alias("allowed"))


@register("SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN word_count < 50 THEN 'thin' ELSE 'kept' END AS outcome, count(*) AS pages FROM doc_base GROUP BY 1", "doc_base")
def b12_page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return crawl.page_counters(d.select(F.lit("text/HTML").alias("content_type"), F.length("text").alias("body_length"), core.word_count(F.col("text")).alias("word_count")))


@register("SELECT source, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY) AS recent, count(*) FILTER (timestamp < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY) AS archived FROM silver GROUP BY source", "silver")
def b13_m7_analytical_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent, old = harmonise.analytical_window(views.silver(spark, sf_dir), "2024-01-31", 20)
    both = recent.select("source", F.lit(1).alias("r")).unionByName(old.select("source", F.lit(0).alias("r")))
    return both.groupBy("source").agg(F.count_if(F.col("r") == 1).alias("recent"), F.count_if(F.col("r") == 0).alias("archived"))


@register("SELECT p_partkey, trim(p_name) <> '' AND length(p_name) <= 80 AND len(string_split(trim(p_name), ' ')) <= 6 AS valid FROM part")
def b15_span_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", extract.valid_span(F.col("p_name")).alias("valid"))


@register("""SELECT article_id, array_to_string(list_filter([CASE WHEN CAST(article_id AS BIGINT) % 3 = 0 THEN 'no_real_date' END, CASE WHEN CAST(article_id AS BIGINT) % 5 = 0 THEN 'headline_changed' END, CASE WHEN word_count < 50 THEN 'thin' END, CASE WHEN CAST(article_id AS BIGINT) % 30 >= 20 THEN 'long_chain' END], lambda x: x IS NOT NULL), ',') AS negative_space FROM silver""", "silver")
def b16_negative_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("article_id").cast("long")
    d = views.silver(spark, sf_dir).withColumns({"timestamp_source": F.when(i % 3 == 0, "fetch_at_fallback").otherwise("published"), "headline_changed": i % 5 == 0, "chain_length": i % 30})
    return harmonise.negative_space(d).select("article_id", F.array_join("negative_space", ",").alias("negative_space"))


# harmonisation -----------------------------------------------------------------------------


@register("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_hash, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS word_count FROM documents")
def c3_legacy_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harmonise.legacy(views.table(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text"))
    return out.select("doc_id", F.sha2("cleaned_text", 256).alias("text_hash"), F.col("word_count").cast("long").alias("word_count"))


@register("""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace('T ' || html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_hash FROM pages""")
def c4_rss_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harmonise.rss(views.table(spark, sf_dir, "pages").select("page_id", F.lit("T").alias("title"), F.col("html").alias("raw_text")))
    return out.select("page_id", F.sha2("cleaned_text", 256).alias("text_hash"))


@register("""WITH i AS (SELECT p_type AS article_id, p_partkey AS nth, 'https://img.e.org/' || replace(p_brand, '#', '') || CASE WHEN p_size % 3 = 0 THEN '-640x480' ELSE '' END || '.jpg' AS url FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY article_id, lower(regexp_replace(url, '-640x480', '')) ORDER BY nth) AS r FROM i)
    SELECT article_id, nth, url FROM k WHERE r = 1""")
def c11_distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://img.e.org/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.when(F.col("p_size") % 3 == 0, "-640x480").otherwise(""), F.lit(".jpg"))
    return harmonise.distinct_images(views.table(spark, sf_dir, "part").select(F.col("p_type").alias("article_id"), F.col("p_partkey").alias("nth"), url.alias("url")))


@register("""WITH t AS (SELECT event_id, CASE WHEN event_id % 4 < 2 THEN date_trunc('day', ts) END AS p, CASE WHEN event_id % 3 = 0 THEN ts END AS s, CASE WHEN event_id % 5 = 0 THEN ts - INTERVAL 1 DAY END AS h, ts + INTERVAL 1 HOUR AS f FROM events)
    SELECT event_id, CASE WHEN p IS NOT NULL AND CAST(s AS DATE) = CAST(p AS DATE) AND s <> p THEN s ELSE coalesce(p, s, h, f) END AS timestamp, CASE WHEN p IS NOT NULL AND CAST(s AS DATE) = CAST(p AS DATE) AND s <> p THEN 'sitemap_time_upgrade' WHEN p IS NOT NULL THEN 'published' WHEN s IS NOT NULL THEN 'sitemap_lastmod' WHEN h IS NOT NULL THEN 'http_last_modified' ELSE 'fetch_at_fallback' END AS timestamp_source FROM t""")
def c12_timestamp_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts")
    t = harmonise.timestamp_of(F.when(i % 4 < 2, F.date_trunc("day", ts).cast("timestamp_ntz")), F.when(i % 3 == 0, ts), F.when(i % 5 == 0, ts - F.expr("INTERVAL 1 DAY")), ts + F.expr("INTERVAL 1 HOUR"))
    return events(spark, sf_dir).select("event_id", t.alias("t")).select("event_id", "t.*")


@register("SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || rtrim(substr(url, length(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) + 1), '/') AS url FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?utm_source=[a-z]*$', '') AS url FROM pages)")
def c14_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#a"))
    return views.table(spark, sf_dir, "pages").select("page_id", harmonise.canonical_url(dirty).alias("url"))


@register("SELECT o_custkey AS source_id, o_orderpriority AS primary_function FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority) AS r FROM orders) WHERE r = 1")
def c16_latest_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("primary_function"), F.col("o_orderdate").alias("classification_date"))
    return catalogue.latest_classification(o).select("source_id", "primary_function")


@register("SELECT CAST(doc_id AS VARCHAR) AS article_id, 'paywall' AS metric_name, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS value FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'comment_count', CAST(n_chars AS DOUBLE) FROM documents WHERE doc_id % 5 = 0")
def c17_scalar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    one = lambda ok, v: F.struct(F.when(ok, v).alias("value"), F.when(ok, "json_ld").otherwise("null").alias("method"))
    d = views.table(spark, sf_dir, "documents").select(i.cast("string").alias("article_id"), one(i % 3 == 0, (i % 2 == 0).cast("string")).alias("paywall"), one(i % 5 == 0, F.col("n_chars").cast("string")).alias("comment_count"))
    return harmonise.scalar_facts(d, ["paywall", "comment_count"])


@register("SELECT CAST(doc_id AS VARCHAR) AS article_id, 'section' AS field, source AS value FROM documents WHERE source <> 'src0' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'tags', lang || ',' || source FROM documents")
def c18_categorical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.when(F.col("source") != "src0", F.col("source")).otherwise("").alias("section"), F.array("lang", "source", F.lit("")).alias("tags"))
    return harmonise.categorical_facts(d, ["section", "tags"]).withColumn("value", F.array_join("value", ","))


@register("SELECT CAST(doc_id AS VARCHAR) AS article_id, field, CASE WHEN field = 'title' THEN 'og' WHEN field = 'author' AND doc_id % 2 = 0 THEN 'json_ld' ELSE 'null' END AS method FROM documents, (VALUES ('title'), ('author'), ('tags')) f(field)")
def c19_coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    methods = F.create_map(F.lit("title"), F.lit("og"), F.lit("author"), F.when(F.col("doc_id") % 2 == 0, "json_ld").otherwise("unheard_of"))
    rows = metadata.coverage_rows(d.select(F.col("doc_id").cast("string").alias("article_id"), "source", views.doc_time("doc_id").alias("seen_at"), methods.alias("methods")), ["title", "author", "tags"], ["og", "json_ld"])
    return rows.select("article_id", "field", "method")


@register("SELECT doc_id, CASE WHEN lang <> 'de' THEN '' WHEN doc_id % 3 = 0 THEN 'de-AT' WHEN doc_id % 3 = 1 THEN 'de-CH' ELSE 'de-DE' END AS variety FROM documents")
def c20_language_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("doc_id") % 3 == 0, "x.at").when(F.col("doc_id") % 3 == 1, "x.ch").otherwise("x.de")
    return views.table(spark, sf_dir, "documents").select("doc_id", harmonise.variety(F.col("lang"), host).alias("variety"))


@register("SELECT c_custkey, n_name AS discourse_function FROM customer JOIN nation ON c_nationkey = n_nationkey")
def c21_discourse_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.col("n_name").alias("discourse_function"))


@register("SELECT lower(p_name) AS word, min(p_retailprice) AS weight FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 7) GROUP BY 1 UNION ALL SELECT lower(p_name), min(-1.0::DOUBLE) FROM part WHERE p_size = 7 GROUP BY 1")
def d7_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    own = p.select(F.col("p_name").alias("word"), F.col("p_retailprice").alias("weight"), F.lit("").alias("inflections"))
    return extract.lexicon(own, p.where("p_size = 7").select(F.col("p_name").alias("word"), F.lit(-1.0).alias("weight")))


# sweeps and catalogue -------------------------------------------------------------------------


@register("SELECT CAST(user_id AS VARCHAR) AS article_id, event_id FROM events WHERE event_type NOT IN ('click', 'view') ")
def e14_open_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("article_id"), "event_id", F.when(kind == "click", "ok").when(kind == "view", "no_snapshots").otherwise("error").alias("status"), F.lit("u").alias("canonical_url"))
    return revisions.open_lookups(rows, 1 << 30).select("article_id", "event_id")


@register("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS status FROM events")
def e15_lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", revisions.lookup_status(F.col("event_type"), ("click", "view")).alias("status"))


@register("SELECT folded, alias, qid FROM (SELECT lower(p_brand) AS folded, lower(p_brand) AS alias, 'Q' || CAST(p_partkey AS VARCHAR) AS qid, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_size DESC, lower(p_brand), 'Q' || CAST(p_partkey AS VARCHAR)) AS r FROM part) WHERE r = 1")
def e18_folded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").select(F.lower("p_brand").alias("alias"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), F.col("p_size").alias("sitelinks"))
    return extract.folded_index(p).select("folded", "alias", "qid")


@register("SELECT entity_text AS node, max(qid) AS wikidata_qid, max(label) AS label FROM (SELECT p_brand AS entity_text, arg_max('Q' || p_type, CAST(p_size AS VARCHAR) || '|Q' || p_type) AS qid FROM (SELECT p_brand, p_type, lpad(CAST(p_size AS VARCHAR), 3, '0') AS p_size FROM part) GROUP BY 1) q LEFT JOIN (SELECT DISTINCT 'Q' || p_type AS k, 'L' || p_type AS label FROM part) ON k = qid GROUP BY 1")
def h20_node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    qid = F.concat(F.lit("Q"), "p_type")
    links = p.select(F.col("p_brand").alias("entity_text"), F.col("p_size").cast("double").alias("link_confidence"), qid.alias("wikidata_qid"))
    labels = p.select(qid.alias("wikidata_qid"), F.lit("en").alias("language"), F.concat(F.lit("L"), "p_type").alias("label")).distinct()
    return network.node_labels(p.select(F.col("p_brand").alias("node")).distinct(), links, labels, "en")


@register("SELECT s_name AS name, s_suppkey AS id, coalesce(o_orderpriority, '') AS primary_function, coalesce(n, 0) AS total FROM supplier LEFT JOIN (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority) AS r FROM orders) ON o_custkey = s_suppkey AND r = 1 LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def h42_dossier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("primary_function"), F.col("o_orderdate").alias("classification_date"))
    n = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("total")).join(s, "id").select(F.col("name").alias("source"), "total")
    return catalogue.dossier_sources(s, o, n).select("name", "id", F.coalesce("primary_function", F.lit("")).alias("primary_function"), "total")


@register("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 3")
def h45_resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.resolve_source(views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "3")


# joins, gates, display --------------------------------------------------------------------------


@register("SELECT c.c_custkey, coalesce(o.n, 0) AS orders, coalesce(o.last, TIMESTAMP '1970-01-01') AS last_order FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def i_default_filled_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    return views.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("last", F.lit("1970-01-01").cast("timestamp_ntz")).alias("last_order"))


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def i_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey").join(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("SELECT metric_name, CASE WHEN max(timestamp) > TIMESTAMP '2024-01-30 23:30:00' THEN 'validated' ELSE 'expired' END AS status FROM metrics GROUP BY 1", "metrics")
def q8_validity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.validity_status(views.metrics(spark, sf_dir).withColumnRenamed("timestamp", "valid_until"), "2024-01-30 23:30:00")


@register("SELECT 'click' AS metric_name, true AS allowed UNION ALL SELECT 'unknown', false")
def q1_normalisation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    eq = spark.createDataFrame([("click", "de", "deviation")], "metric_name string, language string, equivalence_level string")
    out = [(n, isinstance(gates.normalisation_gate(n, m, eq), gates.Allowed)) for n in ("click", "unknown")]
    return spark.createDataFrame(out, "metric_name string, allowed boolean")


@register("SELECT node, total, round(CASE WHEN (SELECT max(total) - min(total) FROM t) = 0 THEN 0.5 ELSE (total - (SELECT min(total) FROM t)) / (SELECT max(total) - min(total) FROM t) END, 6) AS size FROM (SELECT p_brand AS node, count(*) AS total FROM part GROUP BY 1) t".replace("(SELECT max(total) - min(total) FROM t)", "(SELECT max(c) - min(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_brand))").replace("(SELECT min(total) FROM t)", "(SELECT min(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_brand))"))
def r3_node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("node")).agg(F.count(F.lit(1)).alias("total"))
    return rounded(display.node_sizes(nodes, "total"))


@register("WITH b AS (SELECT CAST(unnest(range(0, 24)) AS INT) AS bin), c AS (SELECT hour(timestamp) AS bin, count(*) AS n FROM metrics GROUP BY 1) SELECT bin, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bin)", "metrics")
def r6_cyclic_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.cyclic_bins(views.metrics(spark, sf_dir).select(F.hour("timestamp").alias("v")), "v", 24)


@register("SELECT 24.0::DOUBLE AS period, round(((degrees(atan2(avg(sin(2 * pi() * h / 24)), avg(cos(2 * pi() * h / 24)))) / 360 * 24) + 24) % 24, 4) AS mean FROM (SELECT hour(timestamp) AS h FROM metrics WHERE metric_name = 'view' AND hour(timestamp) BETWEEN 3 AND 9)", "metrics")
def r6_cyclic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metrics(spark, sf_dir).where("metric_name = 'view' AND hour(timestamp) BETWEEN 3 AND 9").select(F.hour("timestamp").alias("v"))
    return rounded(display.cyclic_mean(rows, "v", 24), 4)


@register("WITH h AS (SELECT CAST(floor(least(value, 99) / 10) AS INT) AS bin, count(*) AS n, 0 AS overflow FROM metrics WHERE value >= 0 GROUP BY 1) SELECT bin, n AS count, 'bin' AS kind FROM h", "metrics")
def r7_histogram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metrics(spark, sf_dir).where("value >= 0").groupBy(F.floor(F.least("value", F.lit(99)) / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = rows.withColumns({"lower": F.col("bin") * 10.0, "upper": F.col("bin") * 10.0 + 10, "overflow": F.lit(0)})
    return display.histogram_rows(frame).select("bin", "count", "kind")


@register("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def k_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@register("SELECT lang AS k, count(*) AS n, CAST((SELECT count(*) FROM documents) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 2)) AS BIGINT) AS other FROM documents GROUP BY lang ORDER BY n DESC, k LIMIT 2")
def k_top_with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return core.top_with_tail(counts, [F.desc("n"), F.col("k")], 2, "n")


@register("SELECT source, round(covar_samp(n_chars, word_count) / (stddev_samp(n_chars) * stddev_samp(word_count)), 6) AS r FROM doc_base GROUP BY source", "doc_base")
def j_guarded_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("source", F.col("n_chars").cast("double").alias("a"), core.word_count(F.col("text")).cast("double").alias("b"))
    return rounded(d.groupBy("source").agg(core.guarded_corr("a", "b").alias("r")))


@register("SELECT metric_name, round(list_sort(list(value))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1], 6) AS p90 FROM metrics GROUP BY 1", "metrics")
def j_exact_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core.exact_quantiles(views.metrics(spark, sf_dir), ["metric_name"], "value", [0.9]))


@register("SELECT lag, r FROM (" + LAGS.format(x="avg(value)", wx="metric_name = 'click'", y="avg(value)", wy="metric_name = 'view'", most=24) + ") WHERE r IS NOT NULL ORDER BY r DESC, lag LIMIT 1", "metrics")
def h6_peak_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators import timeseries

    m = views.metrics(spark, sf_dir)
    return rounded(distribution.peak_lag(distribution.lead_lag(timeseries.metric_series(m, "click"), timeseries.metric_series(m, "view"), 24)))


@register("SELECT url AS loc, make_timestamp(1704067200000000 + page_id * 1000000) AS lastmod FROM (SELECT page_id, regexp_replace(url, '[?&#].*$', '') AS url FROM pages)")
def a9_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    xml = p.select(F.concat(F.lit("<urlset><url><loc>"), F.regexp_replace("url", "[?&#].*$", ""), F.lit("</loc><lastmod>"), stamp, F.lit("</lastmod></url></urlset>")).alias("content"))
    return crawl.sitemap_entries(xml).withColumn("lastmod", F.col("lastmod").cast("timestamp_ntz"))


@register("SELECT 'https://e.org/' || CAST(page_id AS VARCHAR) AS link, make_timestamp(1704067200000000 + page_id * 1000000) AS published FROM pages WHERE page_id >= 60")
def a10_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "d MMM yyyy HH:mm:ss +0000")
    xml = p.select(F.concat(F.lit("<rss><item><link>https://e.org/"), F.col("page_id").cast("string"), F.lit("</link><pubDate>Mon, "), stamp, F.lit("</pubDate></item></rss>")).alias("content"))
    return crawl.feed_entries(xml, since="2024-01-01 00:01:00").withColumn("published", F.col("published").cast("timestamp_ntz"))


@register("SELECT page_id, count(DISTINCT h) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1)) AS h FROM pages) GROUP BY page_id")
def a11_html_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.links(views.table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@register("""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')), '') AS headline FROM pages""")
def c13_custom_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonise.custom_fields(views.table(spark, sf_dir, "pages"), {"headline": "title"}, "html").select("page_id", "headline")


#: Rules of a source as the selector engine reads them; none stands for a real source.
RULES = {"headline": {"css": "article > h1"}, "second": {"xpath": "//article/p[2]"}, "encoding": {"xpath": "//meta/@charset"}, "first_link": {"css": "nav li:first-child > a[href^='/']"}, "last_link": {"xpath": "//nav//li[last()]/a/@href"}, "odd": {"css": "p:hover"}}


@register()
def c13_selector_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonise.custom_fields(views.table(spark, sf_dir, "pages"), RULES, "html").select("page_id", *RULES)


@register()
def c6_block_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harmonise.web_by_blocks(views.table(spark, sf_dir, "pages").withColumnRenamed("html", "raw_html"))
    return out.select("page_id", "extraction_method", "cleaned_text", F.col("word_count").cast("long").alias("word_count"))


@register()
def c6_scored_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a template without article, main and p would have them."""
    html = F.regexp_replace(F.regexp_replace("html", r"<(/?)article", "<$1div"), r"<(/?)p>", "<$1div>")
    page = F.concat(F.lit('<div itemtype="http://schema.org/Article">'), html, F.lit("</div>"))
    out = harmonise.web_by_blocks(views.table(spark, sf_dir, "pages").withColumn("raw_html", page))
    return out.select("page_id", "extraction_method", "cleaned_text", F.col("word_count").cast("long").alias("word_count"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to three words: how the benchmark's items begin, labelled by item."""
    b = views.table(spark, sf_dir, "benchmark").select("item_id", F.split("text", r"\s+").alias("w"))
    label = F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG")), (F.col("item_id") % 3 + 1).cast("int"))
    return b.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("alias"), label.alias("label"), F.col("item_id").alias("sitelinks"))


@register()
def d4_gazetteer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
    return gazetteer.gazetteer_spans(d, _aliases(spark, sf_dir))


def _stored_sitemaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sitemaps of a site that has every page in one: inner pages' are indexes of three below and of the root, every thirteenth is cut off, one in seven is missing."""
    p = views.table(spark, sf_dir, "pages").select("page_id", "url")
    n = p.agg((F.max("page_id") + 1).alias("n"))
    name = lambda i: F.concat(F.lit("https://e.org/s"), i.cast("string"), F.lit(".xml"))
    i = F.col("page_id")
    below = F.filter(F.array(i * 3 + 1, i * 3 + 2, i * 3 + 3, F.lit(0).cast("long")), lambda k: k < F.col("n"))
    index = F.concat(F.lit("<?xml version='1.0'?><sitemapindex xmlns='x'>"), F.array_join(F.transform(below, lambda k: F.concat(F.lit("<sitemap><loc> "), name(k), F.lit(" </loc></sitemap>"))), ""), F.lit("</sitemapindex>"))
    urls = F.concat(F.lit("<n:urlset xmlns:n='x'><n:url><n:loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</n:loc><n:lastmod>2024-01-0"), (i % 9 + 1).cast("string"), F.lit("</n:lastmod></n:url></n:urlset>"))
    text = F.when(i * 3 + 1 < F.col("n"), index).otherwise(urls)
    docs = p.join(F.broadcast(n)).where(i % 7 != 6).select(name(i).alias("url"), F.when(i % 13 == 12, F.expr("left(url, 9)")).otherwise(text).alias("content"))
    return p.where(i < 3).select(name(i).alias("root")), docs


@register()
def a9_sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, stats = crawl.walked_sitemaps(*_stored_sitemaps(spark, sf_dir))
    return entries.join(stats, "root", "full").select("root", "loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "documents", "entries", "indeterminate")


def _share_of_vowels(texts: list[str]) -> list[tuple[float, float]]:
    """A stand-in classifier for the check of the operator around it."""
    return [(len([c for c in t if c in "aeiou"]) / max(1, len(t)), 0.25) for t in texts]


@register("SELECT article_id, round(length(regexp_replace(text, '[^aeiou]', '', 'g')) / greatest(1, length(text)) - 0.25, 4) AS value FROM doc_base WHERE lang IN ('en', 'de')", "doc_base")
def d8_model_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("lang").alias("language"), "text")
    return rounded(extract.model_sentiment(d, _share_of_vowels, ["en", "de"]), 4)


@register("SELECT 'k' || CAST(user_id AS VARCHAR) AS object_key, count(*) FILTER (event_type <> 'purchase' OR user_id % 2 = 0) AS failures, CASE WHEN bool_or(event_type = 'purchase' AND user_id % 2 = 1) THEN 'processed' WHEN count(*) >= 5 THEN 'quarantined' ELSE 'pending' END AS status FROM events GROUP BY user_id")
def m4_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("object_key"), ((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 1)).alias("ok"))
    return jobs.attempts(e).drop("processed")


_NEG = ", ".join(f"'{w}'" for w in extract.NEGATORS)


@register(f"""WITH lex(word, weight) AS (VALUES {_LEX}), c AS (SELECT article_id, list_transform(regexp_split_to_array(cl, '[ \\t]+'), lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) AS ws FROM (SELECT article_id, unnest(regexp_split_to_array(lower(text), '[,.;:!?\\n]+')) AS cl FROM doc_base)),
    p AS (SELECT article_id, ws, coalesce(list_position(list_transform(ws, lambda w: w IN ({_NEG})), true), 0) AS neg FROM c), t AS (SELECT article_id, neg, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM p)
    SELECT article_id, round(greatest(least(avg(CASE WHEN neg > 0 AND pos > neg THEN -CAST(weight AS DOUBLE) ELSE CAST(weight AS DOUBLE) END), 1.0), -1.0), 4) AS value FROM t JOIN lex USING (word) GROUP BY article_id""", "doc_base")
def d6_negated_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
    return extract.negated_sentiment(d, spark.createDataFrame(LEXICON, "word string, weight double"))


def _short_words(docs: DataFrame) -> DataFrame:
    """A lexicon from the texts: words of three to six letters that are in a fiftieth of the documents at least, with a weight of their own."""
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    words = F.transform(F.split(F.lower("text"), r"[,.;:!?\n \t]+"), lambda w: F.btrim(w, F.lit(extract.PUNCTUATION)))
    short = F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{L}{3,6}$")))
    # one row for a document, however often its id is repeated, so that counts are summed before they are sent
    own = docs.where(F.col("article_id").isNotNull()).select("article_id", short.alias("words")).groupBy("article_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    often = own.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).where(F.col("df") * 50 >= F.col("docs"))
    return often.select("word", ((F.crc32(F.col("word").cast("binary")) % 17 - 8) / 8.0).alias("weight"))


@register()
def d6_compound_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
    return extract.negated_sentiment(d, extract.with_compounds(d, _short_words(d)))


@register("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS headline FROM pages")
def e10_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", F.coalesce(revisions.headline(F.col("html")), F.lit("")).alias("headline"))


@register("SELECT r.article_id, r.revision_index, CASE WHEN r.revision_trigger = 'chain_head' THEN r.content_hash ELSE p.content_hash END AS before_hash, CASE WHEN r.revision_trigger = 'chain_head' THEN p.content_hash ELSE r.content_hash END AS after_hash FROM revisions r JOIN revisions p ON p.article_id = r.article_id AND p.revision_index = r.revision_index - 1", "revisions")
def e12_pair_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = revisions.diff_pair(views.revisions(spark, sf_dir))
    head = F.col("revision_trigger") == "chain_head"
    return d.select("article_id", "revision_index", F.when(head, F.col("content_hash")).otherwise(F.col("prev_hash")).alias("before_hash"), F.when(head, F.col("prev_hash")).otherwise(F.col("content_hash")).alias("after_hash"))


@register("SELECT s.article_id, s.language, s.word_count FROM silver s WHERE s.article_id IN (SELECT article_id FROM metrics)", "silver", "metrics")
def e6_silver_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.silver(spark, sf_dir).join(views.metrics(spark, sf_dir).select("article_id"), "article_id", "left_semi").select("article_id", "language", F.col("word_count").cast("double").alias("word_count"))


@register("SELECT * FROM (VALUES ('5min', 10000), ('hourly', 120000), ('daily', 2880000), ('weekly', 20160000), ('monthly', 86400000)) t(resolution, cap)")
def f4_row_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r, core.row_cap(r)) for r in core.CAP_FACTOR], "resolution string, cap int")


@register("SELECT count(*) AS rows, count(DISTINCT source) AS sources FROM metrics WHERE source IN ('src0', 'src2', 'src5')", "metrics")
def h23_multi_scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = network.scope_union({"a": ["src0", "src2"], "b": ["src2", "src5"]}, dict.fromkeys(("src0", "src2", "src5"), "de"))
    return core.in_scope(views.metrics(spark, sf_dir), scope).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"))


@register("SELECT source, metric_name, count(DISTINCT article_id) AS articles, count(DISTINCT article_id) >= 20 AS allowed FROM metrics GROUP BY ALL", "metrics")
def q6_k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.metrics(spark, sf_dir).groupBy("source", "metric_name").agg(F.countDistinct("article_id").alias("articles"))
    return n.withColumn("allowed", gates.enough_articles(F.col("articles"), F.lit(False), 20))


@register("SELECT s_name AS name, s_suppkey % 2 = 0 AS eligible FROM supplier")
def q7_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("silver_eligible"))
    return s.select("name", F.col("silver_eligible").alias("eligible"))


@register("SELECT article_id, detected_language, confidence FROM languages WHERE rank = 1 AND detected_language IN ('de', 'fr')", "languages")
def b10_language_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ["de", "en", "es", "fr"]
    wanted = [gates.known_language(x, known) for x in ("de", "fr")]
    return views.languages(spark, sf_dir).where((F.col("rank") == 1) & F.col("detected_language").isin(*wanted)).select("article_id", "detected_language", "confidence")
