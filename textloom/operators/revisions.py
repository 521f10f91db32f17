"""Revision chains: building, activity, discourse shift, clusters, lists."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from textloom.functions.core import bucket, cosine_distance

#: Snapshots that a chain keeps, the oldest.
MOST_SNAPSHOTS = 20


def chain(snapshots: DataFrame) -> DataFrame:
    """Chain of each article from (article_id, source, snapshot_at, content_hash, revision_trigger).

    Of equal hashes the earliest stays (a republication first), then the oldest
    MOST_SNAPSHOTS by time get an index, the previous hash and the hours since.
    """
    first = Window.partitionBy("article_id", "content_hash").orderBy(F.when(F.col("revision_trigger") == "republication", 0).otherwise(1), "snapshot_at")
    one = snapshots.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    order = Window.partitionBy("article_id").orderBy("snapshot_at", "content_hash")
    out = one.withColumn("revision_index", F.row_number().over(order) - 1).where(F.col("revision_index") < MOST_SNAPSHOTS)
    gap = (F.unix_timestamp(F.col("snapshot_at").cast("timestamp")) - F.unix_timestamp(F.lag("snapshot_at").over(order).cast("timestamp"))) / F.lit(3600.0)
    return out.withColumn("prev_content_hash", F.coalesce(F.lag("content_hash").over(order), F.lit(""))).withColumn("time_since_prev_hours", F.coalesce(gap, F.lit(0.0)))


def republished(articles: DataFrame, days: int = 7) -> DataFrame:
    """Articles modified at least so many days after publication."""
    return articles.where(F.col("modified_at") >= F.col("published_at") + F.make_interval(days=F.lit(days)))


def activity(rev: DataFrame, resolution: str = "weekly") -> DataFrame:
    """Edits, articles and edits by trigger of each source and bucket; weeks begin on Monday, first rows are no edits."""
    at = rev.withColumn("bucket", bucket("snapshot_at", resolution))
    edit = F.col("revision_index") > 0
    return at.groupBy("source", "bucket").agg(F.count_if(edit).alias("edits"), F.countDistinct(F.when(edit, F.col("article_id"))).alias("articles"), *[F.count_if(edit & (F.col("revision_trigger") == t)).alias(t) for t in ("republication", "sweep", "chain_head")])


def discourse_shift(rev: DataFrame, resolution: str = "weekly") -> DataFrame:
    """Mean and sum of the sentiment deltas of scored edits; buckets without any are left out.

    Summed as decimals of eight places, so that no order of the rows changes them.
    """
    at = rev.where(F.col("revision_index") > 0).withColumn("bucket", bucket("snapshot_at", resolution))
    out = at.groupBy("source", "bucket").agg(F.sum(F.col("sentiment_delta").cast("decimal(20,8)")).cast("double").alias("sum_delta"), F.count("sentiment_delta").alias("scored"))
    return out.where("scored > 0").select("source", "bucket", (F.col("sum_delta") / F.col("scored")).alias("mean_delta"), "sum_delta", "scored")


def edit_clusters(rev: DataFrame, touched: Column, resolution: str = "daily", sources: int = 2, limit: int = 200) -> DataFrame:
    """Entities that several sources touch in one bucket. touched: array of entity texts of an edit."""
    sources = max(2, min(10, sources))
    at = rev.where(F.col("revision_index") > 0).withColumn("bucket", bucket("snapshot_at", resolution)).select("source", "article_id", "sentiment_delta", "bucket", F.explode(F.array_distinct(touched)).alias("entity"))
    out = at.groupBy("bucket", "entity").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("edits"), F.avg("sentiment_delta").alias("mean_delta"))
    return out.where(F.size("sources") >= sources).orderBy(F.desc("edits"), "bucket", "entity").limit(limit)


def with_status(rev: DataFrame, ops: str = "ops") -> DataFrame:
    """diff_status: identical (sentinel), changed (any operation or a new headline), pending."""
    return rev.withColumn("diff_status", F.when(F.exists(ops, lambda o: F.get_json_object(o, "$.op") == "identical"), "identical").when((F.size(ops) > 0) | F.col("headline_changed"), "changed").otherwise("pending"))


def diff_pair(rev: DataFrame) -> DataFrame:
    """Each edit with the time of the revision before it."""
    prev = rev.select("article_id", (F.col("revision_index") + 1).alias("revision_index"), F.col("snapshot_at").alias("prev_at"), F.col("content_hash").alias("prev_hash"))
    return rev.where("revision_index > 0").join(prev, ["article_id", "revision_index"], "left")


def undiffed_pairs(rev: DataFrame, computed: Column, limit: int = 100) -> DataFrame:
    """Neighbouring revisions still without a diff, newest first."""
    return diff_pair(rev).where(~computed).orderBy(F.desc("snapshot_at"), "article_id", "revision_index").limit(limit)


def open_pairs(rev: DataFrame, docs: DataFrame, computed: Column, limit: int = 100, captured: str = "cdx_snapshot") -> DataFrame:
    """Pairs still without a diff: neighbouring captures, newest first, then up to the limit chain heads, whose article as it is now is held against its newest archive.

    rev: with archive_url; docs: article_id, language, version, of which the newest names the language.
    """
    prev = rev.select("article_id", (F.col("revision_index") + 1).alias("revision_index"), F.col("archive_url").alias("prev_archive_url"), F.col("revision_trigger").alias("prev_trigger"))
    due = rev.where((F.col("revision_trigger") == captured) & ~computed & (F.col("archive_url") != ""))
    mid = due.where("revision_index > 0").join(prev, ["article_id", "revision_index"]).where((F.col("prev_trigger") == captured) & (F.col("prev_archive_url") != ""))
    mid = mid.select(*rev.columns, F.lit("mid_chain").alias("kind"), "prev_archive_url", F.lit(None).cast("string").alias("compare_archive_url"))
    ends = rev.groupBy("article_id").agg(F.min("revision_index").alias("revision_index"), F.max(F.when(F.col("archive_url") != "", F.struct("snapshot_at", "archive_url")))["archive_url"].alias("compare_archive_url"))
    head = due.join(ends, ["article_id", "revision_index"]).select(*rev.columns, F.lit("chain_head").alias("kind"), F.lit("").alias("prev_archive_url"), "compare_archive_url")
    language = docs.groupBy("article_id").agg(F.max_by("language", "version").alias("language"))
    pairs = mid.unionByName(head).orderBy(F.desc("kind"), F.desc("snapshot_at"), "article_id", "revision_index").limit(limit)
    return pairs.join(language, "article_id", "left").orderBy(F.desc("kind"), F.desc("snapshot_at"), "article_id", "revision_index")


def edited_articles(rev: DataFrame, least: int = 2, limit: int = 50, offset: int = 0) -> DataFrame:
    """Chain length, edits and headline flag of articles with an edit at least; paged."""
    out = rev.groupBy("article_id").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("chain_length"), F.count_if(F.col("revision_index") > 0).alias("edits"), F.max("headline_changed").alias("headline_changed"), F.max("snapshot_at").alias("last_edit"))
    return out.where((F.col("edits") >= 1) & (F.col("chain_length") >= least)).orderBy(F.desc("last_edit"), "article_id").offset(offset).limit(limit)


def revision_counts(rev: DataFrame, docs: DataFrame) -> DataFrame:
    """The metric rows that keep revision_count in step: editorial edits, timed by the document or else the newest snapshot."""
    counts = rev.groupBy("article_id").agg(F.min("source").alias("source"), F.count_if((F.col("revision_index") > 0) & (F.col("revision_trigger") != "sweep")).alias("value"), F.max("snapshot_at").alias("newest"))
    times = docs.groupBy("article_id").agg(F.max("timestamp").alias("at"))
    late = F.lit("2000-01-01").cast("timestamp_ntz")
    return counts.join(times, "article_id", "left").select("article_id", "source", F.lit("revision_count").alias("metric_name"), F.col("value").cast("double").alias("value"), F.when(F.col("at") > late, F.col("at")).otherwise(F.col("newest")).alias("timestamp"))


def lookup_status(status: Column, known: tuple[str, ...] = ("ok", "no_snapshots", "error", "circuit_open", "rate_limited")) -> Column:
    return F.when(status.isin(*known), status).otherwise("unknown")


def open_lookups(lookups: DataFrame, limit: int = 100) -> DataFrame:
    """Articles whose lookup is to be tried again."""
    return lookups.where(~F.col("status").isin("ok", "no_snapshots") & (F.col("canonical_url") != "")).orderBy("article_id").limit(limit)


def collapsed_snapshots(snapshots: DataFrame) -> DataFrame:
    """The first good snapshot of each digest."""
    w = Window.partitionBy("article_id", "digest").orderBy("snapshot_at")
    return snapshots.where("status = 200").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def discourse_delta(before: Column, after: Column, entities_before: Column, entities_after: Column, vector_before: Column, vector_after: Column) -> list[Column]:
    """Sentiment delta, entities added and removed, topic shift, and whether all could be computed."""
    return [F.round(after - before, 4).alias("sentiment_delta"), F.sort_array(F.array_except(entities_after, entities_before)).alias("entities_added"), F.sort_array(F.array_except(entities_before, entities_after)).alias("entities_removed"), F.round(cosine_distance(vector_before, vector_after), 6).alias("topic_shift_score"), (before.isNotNull() & after.isNotNull() & entities_before.isNotNull() & entities_after.isNotNull()).alias("deltas_computed")]


def longest_common(a: str, b: str, most: int) -> tuple[int, int, int]:
    """(place in a, place in b, letters) of the longest string, of ``most`` letters at most, that both have, the first in a, then in b.

    Whether there is one of a length is asked of the hashes of all strings of that
    length, and the length is found by doubling and halving.
    """
    def first(n: int) -> int:
        seen = {hash(b[j : j + n]) for j in range(len(b) - n + 1)}
        return next((i for i in range(len(a) - n + 1) if hash(a[i : i + n]) in seen and a[i : i + n] in b), -1)

    most = min(most, len(a), len(b))
    low, at, high = 0, 0, 1
    while high <= most and (i := first(high)) >= 0:
        low, at, high = high, i, 2 * high
    high = min(high, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        if (i := first(middle)) >= 0:
            low, at = middle, i
        else:
            high = middle
    return at, b.find(a[at : at + low]), low


def similarity(a: str, b: str, least: float = 0.0, enough: float = 2.0) -> float:
    """The ratio that difflib's SequenceMatcher gives two strings without junk; where it is sure to lie under ``least`` or not under ``enough``, some number there."""
    whole, found, open_letters = len(a) + len(b), 0, min(len(a), len(b))
    if not whole:
        return 1.0
    todo = [(a, b, open_letters)]
    while todo and 2.0 * (found + open_letters) / whole >= least and 2.0 * found / whole < enough:
        x, y, most = todo.pop()
        i, j, n = longest_common(x, y, most)
        found += n
        open_letters -= min(len(x), len(y))
        for left, right in ((x[:i], y[:j]), (x[i + n :], y[j + n :])) if n else ():
            if left and right:
                open_letters += min(len(left), len(right))
                todo.append((left, right, n))
    return 2.0 * found / whole


def most_similar(text: str, others: list[str], least: float = 0.4) -> int:
    """Place of the most similar of the others, the last of equals, or -1 if none is as similar as ``least``."""
    best, at = least, -1
    for k, other in enumerate(others):
        # one that is left needs no more than to be similar enough
        ratio = similarity(text, other, best, least if len(others) == 1 else 2.0)
        if ratio >= best:
            best, at = ratio, k
    return at


def paragraph_ops(before: str | None, after: str | None, headline_changed: bool = False) -> list[str]:
    """Operations, as JSON, that turn the paragraphs of one text into those of another.

    In a replaced block each old paragraph takes the most similar new one still
    free, the later of equals, from a ratio of 0.4 on; the others are deletions
    and additions. No letter is too frequent to count (autojunk is off).
    """
    old, new = ([p.strip() for p in (t or "").split("\n") if p.strip()] for t in (before, after))
    ops: list[dict] = []
    for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        free = list(range(b0, b1))
        for a in range(a0, a1):
            found = most_similar(old[a], [new[b] for b in free]) if kind == "replace" else -1
            if found >= 0:
                ops.append({"op": "mod", "before": old[a], "after": new[free.pop(found)]})
            else:
                ops.append({"op": "del", "before": old[a]})
        ops += [{"op": "add", "after": new[b]} for b in free]
    if not ops and not headline_changed:
        ops = [{"op": "identical"}]
    return [json.dumps(o, ensure_ascii=False) for o in ops]


@F.pandas_udf(ArrayType(StringType()))
def paragraph_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([paragraph_ops(a, b) for a, b in zip(before, after, strict=True)])


def headline(html: Column, metadata_title: Column | None = None) -> Column:
    """Title of a page: given, <title>, og:title in either attribute order, first h1; tags removed, blanks collapsed."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))

    raw = [found(r"(?is)<title[^>]*>(.*?)</title>"), found(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), found(r'(?is)<meta[^>]*content="([^"]*)"[^>]*property="og:title"'), found(r"(?is)<h1[^>]*>(.*?)</h1>")]
    text = F.coalesce(*([metadata_title] if metadata_title is not None else []), *raw)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>", ""), r"\s+", " "))
