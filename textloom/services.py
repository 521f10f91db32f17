"""Registered queries of readers, sinks, streams, gates and the smaller helpers, each run on whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import core
from textloom.functions.scratch import folder
from textloom.layers import _share_of_vowels, events
from textloom.operators import catalogue, extract, network, revisions, timeseries
from textloom.plans import gates
from textloom.queries import register, rounded
from textloom.sources import files, views, sqlite_index
from textloom.streaming import buckets, claims, jobs


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("article_id"), "source", views.doc_time("doc_id").alias("timestamp"), F.col("lang").alias("language"), F.col("text").alias("cleaned_text"), core.word_count(F.col("text")).alias("word_count"), "n_chars")


# sinks and readers ---------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "envelopes")
    files.write_envelopes(_articles(spark, sf_dir), path)
    return path


@register("SELECT article_id, source, CAST(word_count AS INT) AS word_count, CAST(n_chars AS BIGINT) AS n_chars, sha256(text) AS text_hash FROM doc_base", "doc_base")
def a5_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(_stored(spark, sf_dir))
    return rows.select("core.article_id", "core.source", "core.word_count", F.col("meta.n_chars").cast("long").alias("n_chars"), F.sha2("core.cleaned_text", 256).alias("text_hash"))


@register("SELECT article_id, source, CAST(word_count AS INT) AS word_count FROM doc_base WHERE article_id = '10'", "doc_base")
def a16_envelope_read(spark: SparkSession, sf_dir: str, article_id: str = "10") -> DataFrame:
    return files.read_envelope(spark, _stored(spark, sf_dir), article_id).select("core.article_id", "core.source", "core.word_count")


@register("SELECT DISTINCT source, TIMESTAMP '2024-02-01' AS event_at FROM documents")
def a17_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = files.replay(spark, _stored(spark, sf_dir), "source=", "2024-02-01 00:00:00")
    return again.select(F.regexp_extract("object_key", "source=([^/]+)/", 1).alias("source"), F.col("event_at").cast("timestamp_ntz").alias("event_at")).distinct()


@register("SELECT p_partkey AS id, p_name || ' ' || p_brand AS label FROM part")
def a14_tsv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "index")
    files.write_tsv(views.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("\t\r\n"), "p_brand").alias("label")), path)
    return spark.read.schema("id long, label string").csv(path, sep="\t", quote="")


@register("SELECT p_partkey AS id, p_name || chr(9) || p_brand AS label, p_retailprice AS price FROM part")
def a14_sqlite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "sqlite")
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("\t"), "p_brand").alias("label"), F.col("p_retailprice").alias("price"))
    sqlite_index.write_index(part.repartition(4), path, "id", {"made_from": "part"})
    return sqlite_index.read_index(spark, path, "id long, label string, price double")


@register("SELECT p_partkey AS id, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS label, p_retailprice AS price FROM part")
def a18_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "export")
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type")
    files.write_csv(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), F.col("p_retailprice").alias("price")), path)
    return spark.read.schema("id long, label string, price double").csv(path, header=True, multiLine=True, quote='"', escape='"')


@register("SELECT doc_id, lang, sha256(text) AS text_hash FROM documents")
def a18_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "export")
    files.write_json(views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))


@register("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def a15_cached_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = files.Cached(lambda: views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    held.get()
    return held.get()


# streams -------------------------------------------------------------------------------


#: Documents of a file: what a task writes does not grow with the table.
FILE_ROWS = 20_000


def _raw_objects(spark: SparkSession, sf_dir: str, parts: int) -> str:
    """Documents as raw JSON objects in a folder, dealt over so many files."""
    path = folder(spark, "raw")
    at = views.doc_time("doc_id").cast("timestamp")
    d = views.table(spark, sf_dir, "documents")
    files.write_json(d.select("source", F.lit("legacy").alias("source_type"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("object_key"), F.lit("").alias("title"), F.col("text").alias("raw_text"), F.lit("").alias("raw_html"), F.lit("").alias("url"), at.alias("timestamp"), F.col("lang").alias("language"), at.alias("event_at")).repartition(parts), path)
    return path


@register(r"SELECT sha256(source || 'k' || CAST(doc_id AS VARCHAR)) AS article_id, 'k' || CAST(doc_id AS VARCHAR) AS object_key, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' THEN 'kept' ELSE 'silver_validation_failed' END AS outcome, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS word_count FROM documents")
def a4_m1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, silver, rejects, at = _raw_objects(spark, sf_dir, 8), folder(spark, "silver"), folder(spark, "rejects"), folder(spark, "offsets")
    jobs.ingest(spark, raw, silver, rejects, at).awaitTermination()
    kept = spark.read.parquet(silver).withColumn("outcome", F.lit("kept"))
    aside = spark.read.parquet(rejects).withColumnRenamed("reject_reason", "outcome")
    return kept.unionByName(aside).select("article_id", "object_key", "outcome", F.col("word_count").cast("long").alias("word_count"))


@register("SELECT 3 AS batches, count(*) AS rows FROM documents")
def m2_bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = -(-views.table(spark, sf_dir, "documents").count() // (3 * FILE_ROWS)) or 1
    raw, out, at = _raw_objects(spark, sf_dir, 3 * share), folder(spark, "batches"), folder(spark, "offsets")
    query = jobs.raw_stream(spark, raw, files=share).writeStream.foreachBatch(lambda df, k: jobs.write_batch(df, out, k)).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).agg(F.countDistinct("batch").alias("batches"), F.count(F.lit(1)).alias("rows"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages about objects: what is bought is done, what is clicked failed, the rest arrives."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "failed").otherwise("arrived")
    return events(spark, sf_dir).select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("object_key"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))


@register()
def m3_claim_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims over all events, the first half of the time and then, from the checkpoint, the rest."""
    spark.conf.set(*next(iter(claims.STORE.items())))
    raw, out, at = folder(spark, "messages"), folder(spark, "actions"), folder(spark, "offsets")
    messages = _messages(spark, sf_dir)
    half = messages.agg((F.min("at").cast("long") + F.max("at").cast("long")) / 2).first()[0]
    for part in (F.unix_timestamp("at") < half, F.unix_timestamp("at") >= half):
        messages.where(part).coalesce(1).write.mode("append").parquet(raw)
        stream = claims.claimed(spark.readStream.schema(messages.schema).parquet(raw), stale_seconds=10**8, delay="400 days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(claims.OUT).parquet(out)


@register("SELECT 'k' || CAST(user_id AS VARCHAR) AS object_key, arg_max(event_type, event_id) AS status, max(event_id) AS version FROM events GROUP BY user_id")
def a2_bucketed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document log, taken in by three batches, one of them twice."""
    log = events(spark, sf_dir).select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("object_key"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    table = buckets.BucketTable(spark, folder(spark, "log"), log.schema, ["object_key"], "version", 32)
    for k in (0, 1, 1, 2):
        table.apply(log.where(F.col("version") % 3 == (k + 1) % 3), k)
    return table.rows()


@register("""WITH f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts, 'src' || CAST(user_id % 7 AS VARCHAR) AS source, event_type AS metric_name, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value FROM events)
    SELECT date_trunc('hour', ts) AS bucket, source, metric_name, round(sum(value), 4) AS sum, count(value) AS count FROM f GROUP BY ALL HAVING count(value) > 0""")
def m6_retracting_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of facts of which a third comes again an hour later with twice the value: what they replace is taken back."""
    fact = events(spark, sf_dir).select("event_id", F.lit(1).alias("version"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"), F.col("event_type").alias("metric_name"), "value")
    again = fact.where("event_id % 3 = 0").withColumns({"version": F.lit(2), "bucket": F.col("bucket") + F.expr("INTERVAL 1 HOUR"), "value": F.col("value") * 2})
    raw, out, at = folder(spark, "facts"), folder(spark, "rollup"), folder(spark, "offsets")
    groups = ["bucket", "source", "metric_name"]
    each = buckets.retracting_rollup(buckets.BucketTable(spark, folder(spark, "state"), fact.schema, ["event_id"], "version", 32), out, groups, "value")
    for part in (fact, again):
        part.write.mode("append").parquet(raw)
        spark.readStream.schema(fact.schema).parquet(raw).writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return rounded(buckets.rolled_up(spark, out, groups), 4)


@register("SELECT count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type NOT IN ('view', 'click')) AS quarantined, count(*) FILTER (event_type = 'view') > 1000 AS alert FROM events")
def m14_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "processed").when(F.col("event_type") == "view", "pending").otherwise("quarantined")
    return jobs.backlog(events(spark, sf_dir).select(status.alias("status")))


@register("""SELECT doc_id, t AS source_type, t <> 'odd' AS adapted, CASE t WHEN 'legacy' THEN len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) WHEN 'rss' THEN 2 WHEN 'web' THEN 3 ELSE 0 END AS word_count
    FROM (SELECT *, CASE source WHEN 'src1' THEN 'rss' WHEN 'src2' THEN 'web' WHEN 'src3' THEN 'odd' ELSE 'legacy' END AS t FROM documents)""")
def c1_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source") == "src1", "rss").when(F.col("source") == "src2", "web").when(F.col("source") == "src3", "odd")
    d = views.table(spark, sf_dir, "documents").withColumn("source_type", kind)
    d = d.withColumns({"object_key": F.col("doc_id").cast("string"), "title": F.lit("T"), "raw_text": F.when(kind == "rss", F.concat(F.lit("<b>"), "lang", F.lit("</b>"))).otherwise(F.col("text")), "raw_html": F.lit("<article>a b <i>c</i></article>"), "event_at": views.doc_time("doc_id").cast("timestamp")})
    return jobs.harmonised(d).select("doc_id", "source_type", F.col("cleaned_text").isNotNull().alias("adapted"), F.coalesce(F.col("word_count").cast("long"), F.lit(0)).alias("word_count"))


# extractors ----------------------------------------------------------------------------


def _capital(text: str) -> float:
    if not re.match("[A-Z]", text):
        raise ValueError("no capital")
    return 1.0


@register("SELECT article_id, CAST(length(text) AS DOUBLE) AS size, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 1.0::DOUBLE END AS capital, CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'ValueError: no capital' END AS error FROM doc_base", "doc_base")
def d10_isolated_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.isolated(_articles(spark, sf_dir).withColumnRenamed("cleaned_text", "text"), {"size": lambda t: float(len(t)), "capital": _capital})
    return out.select("article_id", F.col("size.value").alias("size"), F.col("capital.value").alias("capital"), F.col("capital.error").alias("error"))


@register("""SELECT article_id, '{"language":"l1","words":"w' || CASE WHEN lang = 'de' THEN '2' ELSE '1' END || '"}' AS provenance FROM doc_base""", "doc_base")
def d11_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("language") == "de", extract.provenance({"words": "w2", "language": "l1"})).otherwise(extract.provenance({"words": "w1", "language": "l1"}))
    return _articles(spark, sf_dir).select("article_id", F.to_json(by).alias("provenance"))


@register("SELECT article_id, round(length(regexp_replace(text, '[^aeiou]', '', 'g')) / greatest(1, length(text)) - 0.25, 4) AS value FROM doc_base WHERE lang = 'de'", "doc_base")
def d9_german_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.model_sentiment(_articles(spark, sf_dir).withColumnRenamed("cleaned_text", "text"), _share_of_vowels, ["de"]), 4)


@register("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), w AS (SELECT *, list_distinct(string_split(t, ' ')) AS a, list_distinct(string_split(p, ' ')) AS b, CAST(length(t) AS DOUBLE) AS x, CAST(length(p) AS DOUBLE) AS y FROM c)
    SELECT conv_id, turn, round(x - y, 4) AS sentiment_delta, sha256(array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), '|')) AS added, sha256(array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(a, v))), '|')) AS removed, round(1 - (x * y + 1) / sqrt((x * x + 1) * (y * y + 1)), 6) AS topic_shift_score, p IS NOT NULL AS deltas_computed FROM w WHERE p IS NOT NULL""")
def e11_turn_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    c = c.withColumn("p", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("p").isNotNull())
    size, names = lambda x: F.length(x).cast("double"), lambda x: F.split(x, " ")
    out = c.select("conv_id", "turn", *revisions.discourse_delta(size("p"), size("t"), names("p"), names("t"), F.array(size("p"), F.lit(1.0)), F.array(size("t"), F.lit(1.0))))
    digest = lambda x: F.sha2(F.array_join(x, "|"), 256)
    return rounded(out.select("conv_id", "turn", "sentiment_delta", digest("entities_added").alias("added"), digest("entities_removed").alias("removed"), "topic_shift_score", "deltas_computed"))


# gates and resolvers -------------------------------------------------------------------


@register("SELECT metric_name, count(*) AS n FROM metrics WHERE timestamp < TIMESTAMP '2024-01-15' GROUP BY 1", "metrics")
def b2_resolved_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = gates.resolve_window(None, "2024-01-15T00:00:00", "2024-02-01T00:00:00")
    return core.in_scope(views.metrics(spark, sf_dir), start=start, end=end).groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT source, count(*) AS n FROM metrics WHERE metric_name = 'view' GROUP BY 1", "metrics")
def b8_metric_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).withColumn("metric_name", F.when(F.col("metric_name") == "view", "sentiment_score_sentiws").otherwise(F.col("metric_name")))
    return core.in_scope(m, metric=gates.canonical_metric("sentiment_score")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _outcome(spark: SparkSession, rows: list[tuple[str, gates.Allowed | gates.Refusal]]) -> DataFrame:
    return spark.createDataFrame([(k, isinstance(g, gates.Allowed), getattr(g, "message", "")) for k, g in rows], "request string, allowed boolean, message string")


@register("SELECT metric_name || ':' || level AS request, level <> 'temporal' OR metric_name = 'publication_hour' AS allowed FROM (SELECT DISTINCT metric_name FROM metrics UNION SELECT 'publication_hour'), (VALUES ('temporal'), ('deviation'), ('absolute')) l(level)", "metrics")
def q2_accepted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.metrics(spark, sf_dir).select("metric_name").distinct().union(spark.createDataFrame([("publication_hour",)], "metric_name string"))
    timed = F.col("metric_name").isin(*gates.TEMPORAL_METRICS)
    grants = F.when(timed, F.array(*map(F.lit, gates.accepted_levels("publication_hour")))).otherwise(F.array(*map(F.lit, gates.accepted_levels("view"))))
    return names.withColumn("g", grants).select("metric_name", "g", F.explode(F.array(*map(F.lit, gates.LEVELS))).alias("level")).select(F.concat_ws(":", "metric_name", "level").alias("request"), F.array_contains("g", F.col("level")).alias("allowed"))


@register("""WITH s AS (SELECT DISTINCT lang FROM documents), g AS (SELECT 'click' AS m, lang FROM s UNION ALL SELECT 'view', 'de'), r AS (SELECT m, s.lang, g.lang IS NULL AS missing FROM (VALUES ('click'), ('view')) v(m) JOIN s ON true LEFT JOIN g USING (m, lang))
    SELECT m AS request, NOT bool_or(missing) AS allowed, CASE WHEN bool_or(missing) THEN 'no grant for ' || string_agg(lang, ', ' ORDER BY lang) FILTER (missing) ELSE '' END AS message FROM r GROUP BY m""")
def q3_cross_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = views.languages(spark, sf_dir)
    grants = spoken.select(F.lit("click").alias("metric_name"), F.col("detected_language").alias("language")).distinct().union(spark.createDataFrame([("view", "de")], "metric_name string, language string"))
    grants = grants.withColumn("equivalence_level", F.lit("deviation"))
    return _outcome(spark, [(m, gates.cross_frame_gate(m, spoken, grants)) for m in ("click", "view")])


@register("""WITH g AS (SELECT DISTINCT lang FROM documents WHERE lang <> 'fr'), r AS (SELECT k, l, l NOT IN (SELECT lang FROM g) AS missing FROM (VALUES ('de,en', 'de'), ('de,en', 'en'), ('en,fr', 'en'), ('en,fr', 'fr')) v(k, l))
    SELECT k AS request, NOT bool_or(missing) AS allowed, CASE WHEN bool_or(missing) THEN 'no temporal grant for ' || string_agg(l, ', ' ORDER BY l) FILTER (missing) ELSE '' END AS message FROM r GROUP BY k""")
def q4_lead_lag_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = views.languages(spark, sf_dir).where("detected_language <> 'fr'").select(F.col("detected_language").alias("language")).distinct()
    grants = spoken.withColumns({"metric_name": F.lit("publication_hour"), "equivalence_level": F.lit("temporal")})
    return _outcome(spark, [(k, gates.lead_lag_gate(grants, k.split(","))) for k in ("de,en", "en,fr")])


@register("SELECT 'Supplier of ' || CAST(k AS VARCHAR) AS request, s_suppkey IS NOT NULL AND k % 2 = 0 AS allowed, CASE WHEN s_suppkey IS NULL THEN 'unknown source ' || k WHEN k % 2 = 1 THEN k || ' is not reviewed as eligible' ELSE '' END AS message FROM (VALUES (1), (2), (1099511627776)) v(k) LEFT JOIN supplier ON s_suppkey = k")
def q7_eligibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("silver_eligible"))
    return _outcome(spark, [(f"Supplier of {k}", gates.eligibility_gate(str(k), s)) for k in (1, 2, 1 << 40)])


@register("SELECT * FROM (SELECT 'brands' AS name, least(greatest(count(DISTINCT p_brand) * 5, 5), 6000) AS cap FROM part UNION ALL SELECT 'documents', least(greatest(count(*) * 5, 5), 6000) FROM documents)")
def r5_edge_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = views.table(spark, sf_dir, "part").select("p_brand").distinct().count()
    return spark.createDataFrame([("brands", gates.edge_cap(brands)), ("documents", gates.edge_cap(views.table(spark, sf_dir, "documents").count()))], "name string, cap long")


@register("SELECT p_partkey, CAST(CASE WHEN p_size * 4 - 60 <= 0 THEN 20 ELSE least(p_size * 4 - 60, 100) END AS INT) AS clamped FROM part")
def q9_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits as they are asked for, from far below to far above what is allowed."""
    return views.table(spark, sf_dir, "part").select("p_partkey", gates.clamped((F.col("p_size") * 4 - 60).cast("int"), 1, 100, 20).alias("clamped"))


@register("SELECT 'one' AS scope, true AS allowed UNION ALL SELECT 'two', (SELECT count(DISTINCT lang) FROM documents WHERE lang IN ('de', 'en')) < 2")
def q5_cross_language_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = [r[0] for r in views.languages(spark, sf_dir).where("detected_language IN ('de', 'en')").select("detected_language").distinct().orderBy("detected_language").collect()]

    def allowed(languages: dict[str, str]) -> bool:
        try:
            return bool(network.scope_union({k: [k] for k in languages}, languages))
        except PermissionError:
            return False

    return spark.createDataFrame([("one", allowed({"src0": "de", "src1": "de"})), ("two", allowed({f"src{i}": x for i, x in enumerate(spoken)}))], "scope string, allowed boolean")


# series, sets and states ---------------------------------------------------------------


@register("""WITH s AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, source, metric_name, round(avg(value), 6) AS value, count(*) AS count FROM metrics GROUP BY ALL)
    SELECT *, (SELECT count(*) FROM s) > 500 AS truncated FROM s ORDER BY bucket, source, metric_name LIMIT 500""", "metrics")
def f1_f4_capped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, more = timeseries.capped(timeseries.series(views.metrics(spark, sf_dir), "5min"), "5min", 500)
    return rounded(rows).withColumn("truncated", F.lit(more))


@register("SELECT metric_name, m.source, detected_language AS language, round(avg(value), 6) AS baseline_value, round(stddev_pop(value), 6) AS baseline_std, count(*) AS n_documents FROM metrics m JOIN languages l USING (article_id) WHERE rank = 1 AND m.timestamp >= TIMESTAMP '2024-01-08' AND m.timestamp < TIMESTAMP '2024-01-22' GROUP BY ALL HAVING count(*) >= 2", "metrics", "languages")
def e19_ranged_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = core.in_scope(views.metrics(spark, sf_dir), start="2024-01-08", end="2024-01-22")
    return rounded(timeseries.baselines(inside, views.languages(spark, sf_dir)))


@register("SELECT time_bucket(INTERVAL 1 MONTH, timestamp) AS bucket, source, metric_name, count(DISTINCT article_id) AS articles, max(value) AS largest FROM metrics GROUP BY ALL", "metrics")
def j10_merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.merged_states(timeseries.distinct_states(views.metrics(spark, sf_dir), "daily"), "monthly")


@register("SELECT article_id, timestamp FROM doc_base WHERE (timestamp, article_id) > (TIMESTAMP '2024-01-10', '5') ORDER BY timestamp, article_id LIMIT 50", "doc_base")
def k5_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.page_after(_articles(spark, sf_dir).select("article_id", "timestamp"), {"timestamp": F.lit("2024-01-10").cast("timestamp_ntz"), "article_id": F.lit("5")}, 50)


@register("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def k7_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.where("event_type = 'click'").select("user_id").union(e.where("event_type = 'purchase'").select("user_id")).distinct()


@register("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS p FROM v) SELECT vec_id, round(p[1] / list_sum(p), 6) AS first, round(p[len(p)] / list_sum(p), 6) AS last FROM p")
def l18_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", core.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    return rounded(e.select("vec_id", F.get("p", F.lit(0)).alias("first"), F.get("p", F.size("p") - 1).alias("last")))


@register("SELECT CAST(user_id AS VARCHAR) AS article_id, max(ts) AS timestamp, 'k' || CAST(arg_max(event_id, (ts, 'k' || CAST(event_id AS VARCHAR))) AS VARCHAR) AS bronze_object_key FROM events WHERE user_id = 3 GROUP BY user_id")
def h45_resolve_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("article_id"), F.col("ts").alias("timestamp"), F.lit("s").alias("source"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("bronze_object_key"))
    return catalogue.resolve_article(docs, "3").select("article_id", "timestamp", "bronze_object_key")
