"""The analytical tables, derived from the base tables; VIEWS_SQL states the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.core import word_count
from textloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts from the event stream."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("timestamp"), "value", F.col("event_type").alias("metric_name"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"), F.col("user_id").cast("string").alias("article_id"), F.col("event_id").alias("version"))


def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts of each document: words, characters and, where labelled, quality and toxicity."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = d.join(l, "doc_id", "left").select(F.col("doc_id").cast("string").alias("article_id"), "source", doc_time("doc_id").alias("timestamp"), word_count(F.col("text")).cast("double").alias("word_count"), F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return base.unpivot(["article_id", "source", "timestamp"], ["word_count", "n_chars", "quality", "toxic"], "metric_name", "value").where(F.col("value").isNotNull())


def doc_time(column: str):
    return F.timestamp_seconds(F.lit(1704067200) + (F.col(column) * 7919) % 2592000).cast("timestamp_ntz")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("article_id"), "source", doc_time("doc_id").alias("timestamp"), F.col("lang").alias("detected_language"), F.lit(1).alias("rank"), F.lit(1.0).alias("confidence"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("article_id"), "source", doc_time("doc_id").alias("timestamp"), F.col("lang").alias("language"), F.length("text").alias("cleaned_text_length"), word_count(F.col("text")).alias("word_count"))


def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical facts with array values."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = [F.col("doc_id").cast("string").alias("article_id"), "source", doc_time("doc_id").alias("timestamp")]
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    one = d.select(*key, F.map_from_arrays(F.array(F.lit("language"), F.lit("length_band")), F.array(F.array("lang"), F.array(band))).alias("m"))
    one = one.select("article_id", "source", "timestamp", F.explode("m").alias("field", "value"))
    labels = d.join(l, "doc_id").select(*key, F.lit("labels").alias("field"), F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.concat(F.lit("toxic:"), F.col("toxic").cast("string"))).alias("value"))
    return one.unionByName(labels)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised ASCII words; the label is by length."""
    d = table(spark, sf_dir, "documents")
    tokens = d.select(F.col("doc_id").cast("string").alias("article_id"), "source", doc_time("doc_id").alias("timestamp"), F.posexplode(F.split("text", " ")).alias("start_char", "entity_text"))
    return tokens.where(F.col("entity_text").rlike("^[A-Z][a-z]{3,}$")).withColumn("entity_label", F.when(F.length("entity_text") % 2 == 0, "ORG").otherwise("PER"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity mentions for co-occurrence at scale: the brands of an order's parts."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").cast("string").alias("article_id"), F.concat(F.lit("src"), (F.col("l_orderkey") % 7).cast("string")).alias("source"), F.col("l_shipdate").alias("timestamp"), F.col("p_brand").alias("entity_text"), F.lit("BRAND").alias("entity_label"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision rows: the lines of an order in the order of shipping."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.select(
        F.col("l_orderkey").cast("string").alias("article_id"), F.concat(F.lit("src"), (F.col("l_orderkey") % 7).cast("string")).alias("source"), F.col("l_shipdate").alias("snapshot_at"), F.col("l_partkey").cast("string").alias("content_hash"),
        F.when(F.col("l_returnflag") == "A", "republication").when(F.col("l_returnflag") == "N", "sweep").otherwise("chain_head").alias("revision_trigger"), F.col("l_discount").alias("sentiment_delta"), (F.col("l_linestatus") == "O").alias("headline_changed"),
        (F.row_number().over(w) - 1).alias("revision_index"), F.col("l_linenumber").alias("line"),
    )


#: The same views for DuckDB, to be put before a query that names them.
VIEWS_SQL = {
    "metrics": "metrics AS (SELECT ts AS timestamp, value, event_type AS metric_name, 'src' || CAST(user_id % 7 AS VARCHAR) AS source, CAST(user_id AS VARCHAR) AS article_id, event_id AS version FROM events)",
    "doc_base": "doc_base AS (SELECT CAST(d.doc_id AS VARCHAR) AS article_id, source, make_timestamp((1704067200 + (d.doc_id * 7919) % 2592000) * 1000000) AS timestamp, CAST(len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> '')) AS DOUBLE) AS word_count, CAST(n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, lang, length(text) AS len, text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)",
    "doc_metrics": "doc_metrics AS (SELECT article_id, source, timestamp, 'word_count' AS metric_name, word_count AS value FROM doc_base UNION ALL SELECT article_id, source, timestamp, 'n_chars', n_chars FROM doc_base UNION ALL SELECT article_id, source, timestamp, 'quality', quality FROM doc_base WHERE quality IS NOT NULL UNION ALL SELECT article_id, source, timestamp, 'toxic', toxic FROM doc_base WHERE toxic IS NOT NULL)",
    "languages": "languages AS (SELECT article_id, source, timestamp, lang AS detected_language, 1 AS rank, 1.0 AS confidence FROM doc_base)",
    "silver": "silver AS (SELECT article_id, source, timestamp, lang AS language, len AS cleaned_text_length, word_count FROM doc_base)",
    "article_metadata": "article_metadata AS (SELECT article_id, source, timestamp, 'language' AS field, [lang] AS value FROM doc_base UNION ALL SELECT article_id, source, timestamp, 'length_band', [CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END] FROM doc_base UNION ALL SELECT article_id, source, timestamp, 'labels', ['quality:' || CAST(CAST(quality AS INT) AS VARCHAR), 'toxic:' || CAST(CAST(toxic AS INT) AS VARCHAR)] FROM doc_base WHERE quality IS NOT NULL)",
    "entities": "entities AS (SELECT article_id, source, timestamp, t AS entity_text, CASE WHEN length(t) % 2 = 0 THEN 'ORG' ELSE 'PER' END AS entity_label FROM (SELECT article_id, source, timestamp, unnest(string_split(text, ' ')) AS t FROM doc_base) WHERE regexp_full_match(t, '[A-Z][a-z]{3,}'))",
    "brands": "brands AS (SELECT CAST(l_orderkey AS VARCHAR) AS article_id, 'src' || CAST(l_orderkey % 7 AS VARCHAR) AS source, l_shipdate AS timestamp, p_brand AS entity_text, 'BRAND' AS entity_label FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "revisions": "revisions AS (SELECT CAST(l_orderkey AS VARCHAR) AS article_id, 'src' || CAST(l_orderkey % 7 AS VARCHAR) AS source, l_shipdate AS snapshot_at, CAST(l_partkey AS VARCHAR) AS content_hash, CASE l_returnflag WHEN 'A' THEN 'republication' WHEN 'N' THEN 'sweep' ELSE 'chain_head' END AS revision_trigger, l_discount AS sentiment_delta, l_linestatus = 'O' AS headline_changed, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS revision_index, l_linenumber AS line FROM lineitem)",
}
_NEEDS = {"doc_metrics": ["doc_base"], "languages": ["doc_base"], "silver": ["doc_base"], "article_metadata": ["doc_base"], "entities": ["doc_base"]}


def with_views(query: str, *names: str) -> str:
    """query after the definitions of the views that it names; its own WITH items follow after 'WITH'."""
    order: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, []), n):
            if x not in order:
                order.append(x)
    head = ", ".join(VIEWS_SQL[n] for n in order)
    query = query.strip()
    return f"WITH {head}, {query[4:].lstrip()}" if query[:4].upper() == "WITH" else f"WITH {head} {query}"
