"""Discovery and crawl state: sources of addresses, filters, change detection, channel merge, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.scratch import materialize

#: Endings of addresses that are no pages.
BINARY = ("jpg", "jpeg", "png", "gif", "svg", "webp", "pdf", "zip", "mp3", "mp4", "css", "js", "ico", "xml")


def sitemap_entries(xml: DataFrame, text: str = "content") -> DataFrame:
    """(loc, lastmod) of sitemap or index documents held as text."""
    blocks = xml.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)).alias("b"))
    return blocks.select(F.trim(F.regexp_extract("b", r"(?is)<loc>\s*(.*?)\s*</loc>", 1)).alias("loc"), F.try_to_timestamp(F.nullif(F.regexp_extract("b", r"(?is)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit(""))).alias("lastmod")).where("loc <> ''")


#: Sitemap documents that one root may lead to.
MOST_SITEMAPS = 50


def sitemap_kind(text: Column) -> Column:
    """"index", "urlset" (any other root), or "unreadable": no text, no root, or a root that is not closed at the end."""
    root = F.regexp_extract(text, r"(?s)^\ufeff?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z_][\w.:-]*)", 1)
    closed = F.regexp_extract(text, r"(?s)(?:</([A-Za-z_][\w.:-]*)\s*>|(/)>)\s*(?:<!--.*?-->\s*)*$", 1)
    whole = (root != "") & ((closed == root) | text.rlike(r"(?s)^[^<]*(?:<\?.*?\?>\s*)*<[^<>]*/>\s*$"))
    local = F.lower(F.regexp_extract(root, r"([^:]*)$", 1))
    return F.when(~F.coalesce(whole, F.lit(False)), "unreadable").when(local == "sitemapindex", "index").otherwise("urlset")


def walked_sitemaps(roots: DataFrame, documents: DataFrame, most: int = MOST_SITEMAPS) -> tuple[DataFrame, DataFrame]:
    """Entries (root, loc, lastmod) and statistics (root, documents, entries, indeterminate) of sitemaps and the indexes above them.

    roots: root; documents: url, content, one row a url, as fetched; what is
    not there could not be fetched. Each root is walked breadth first, in the
    order in which indexes list their children, a document once, ``most``
    documents at most. A root is indeterminate if a document was unreadable or
    was left when the bound was reached. One join a level, with all roots in
    it; null roots and null addresses are left out.
    """
    spark = roots.sparkSession
    held = documents.where("url IS NOT NULL").dropDuplicates(["url"]).select("url", "content")
    level = materialize(roots.where("root IS NOT NULL").select("root").distinct().select("root", F.col("root").alias("url"), F.lit(1).cast("long").alias("nth")), "frontier")
    done = spark.createDataFrame([], "root string, url string, kind string, content string, rank long")
    while not level.isEmpty():
        spent = done.groupBy("root").agg(F.count(F.lit(1)).alias("spent"))
        fresh = level.groupBy("root", "url").agg(F.min("nth").alias("nth")).join(done.select("root", "url"), ["root", "url"], "left_anti")
        ranked = fresh.join(spent, "root", "left").withColumn("rank", F.coalesce("spent", F.lit(0)) + F.row_number().over(Window.partitionBy("root").orderBy("nth")))
        got = ranked.where(F.col("rank") <= most).join(held, "url", "left").select("root", "url", sitemap_kind(F.col("content")).alias("kind"), "content", F.col("rank").cast("long").alias("rank"))
        # what is left when the bound is reached, a document that was seen before included, leaves the count open
        last = got.groupBy("root").agg(F.max(F.when(F.col("rank") == most, F.lit(1))).alias("full"))
        at = ranked.where(F.col("rank") == most).select("root", F.col("nth").alias("until"))
        left = level.join(at, "root").where(F.col("nth") > F.col("until")).select("root").distinct()
        got = materialize(got, "fetched")
        over = materialize(left.unionByName(_children(got).join(last.where("full = 1").select("root"), "root", "left_semi").select("root")).distinct().select("root", F.lit(None).cast("string").alias("url"), F.lit("left").alias("kind"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("rank")), "left")
        done = done.unionByName(got).unionByName(over)
        more = _children(got).join(over.select("root"), "root", "left_anti")
        level = materialize(more.select("root", "url", F.row_number().over(Window.partitionBy("root").orderBy("rank", "place")).cast("long").alias("nth")), "frontier")
    entries = done.where("kind = 'urlset'").select("root", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)<(?:[\w.-]+:)?url>(.*?)</(?:[\w.-]+:)?url>"), 1)).alias("b"))
    entries = entries.select("root", _address(F.col("b")).alias("loc"), F.try_to_timestamp(F.nullif(F.regexp_extract("b", r"(?is)<(?:[\w.-]+:)?lastmod>\s*(.*?)\s*</", 1), F.lit(""))).alias("lastmod")).where("loc <> ''")
    stats = done.groupBy("root").agg(F.count("url").alias("documents"), F.max(F.col("kind").isin("unreadable", "left")).alias("indeterminate"))
    return entries, stats.join(entries.groupBy("root").agg(F.count(F.lit(1)).alias("entries")), "root", "left").select("root", "documents", F.coalesce("entries", F.lit(0)).alias("entries"), "indeterminate")


def _address(block: Column) -> Column:
    return F.trim(F.replace(F.regexp_extract(block, r"(?is)<(?:[\w.-]+:)?loc>\s*(.*?)\s*</", 1), F.lit("&amp;"), F.lit("&")))


def _children(fetched: DataFrame) -> DataFrame:
    """(root, rank, place, url) of what indexes list."""
    listed = fetched.where("kind = 'index'").select("root", "rank", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?is)<(?:[\w.-]+:)?sitemap>(.*?)</(?:[\w.-]+:)?sitemap>"), 1)).alias("place", "b"))
    return listed.select("root", "rank", "place", _address(F.col("b")).alias("url")).where("url <> ''")


def feed_entries(xml: DataFrame, text: str = "content", since: str | None = None) -> DataFrame:
    """(link, published) of the items of RSS documents held as text."""
    items = xml.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?is)<item[ >](.*?)</item>"), 1)).alias("b"))
    when = F.coalesce(F.try_to_timestamp(F.regexp_extract("b", r"(?is)<pubDate>\s*(?:[A-Za-z]{3}, )?(.*?)\s*</pubDate>", 1), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.nullif(F.regexp_extract("b", r"(?is)<dc:date>\s*(.*?)\s*</dc:date>", 1), F.lit(""))))
    out = items.select(F.trim(F.regexp_extract("b", r"(?is)<link>\s*(.*?)\s*</link>", 1)).alias("link"), when.alias("published")).where("link <> ''")
    return out if since is None else out.where(F.col("published").isNull() | (F.col("published") >= F.lit(since).cast("timestamp")))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Different hrefs of each page. pages: page_id, html."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]+)"'), 1))).alias("href"))


def archive_addresses(template: str, since: str, now: str, step: str = "day", spark=None) -> DataFrame:
    """Addresses of a date-indexed archive, newest first; template has strftime-like {yyyy}, {MM}, {dd}."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{since}', DATE '{now}', INTERVAL 1 {step})) AS d")
    url = F.lit(template)
    for key in ("yyyy", "MM", "dd"):
        url = F.replace(url, F.lit("{" + key + "}"), F.date_format("d", key))
    return days.select("d", url.alias("url")).orderBy(F.desc("d"))


def triples(lines: DataFrame, predicates: Sequence[str], value: str = "value") -> DataFrame:
    """(subject, predicate, object, lang) of N-Triples lines with one of the predicates."""
    pattern = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*\.\s*$'
    part = lambda k: F.regexp_extract(value, pattern, k)
    out = lines.select(part(1).alias("subject"), part(2).alias("predicate"), F.coalesce(F.nullif(part(3), F.lit("")), part(4)).alias("object"), part(5).alias("lang"))
    return out.where(F.col("predicate").isin(*predicates))


def allowed_address(url: Column, excluded: Sequence[str], extensions: Sequence[str] = BINARY) -> Column:
    """Neither of an excluded extension nor under an excluded prefix, whatever the case of the path.

    A prefix that ends with a slash stands for a path and all below it, any
    other for every path that begins so; blank ones for nothing.
    """
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    out = F.lit(False)
    for x in extensions:
        out = out | path.endswith(f".{x.lower()}")
    for p in (p.lower() for p in excluded):
        stem = p.rstrip("/")
        if p.endswith("/") and stem:
            out = out | (path == stem) | path.startswith(f"{stem}/")
        elif stem:
            out = out | path.startswith(p)
    return ~out


def page_counters(fetched: DataFrame, least_words: int = 50) -> DataFrame:
    """Kept pages and those left out by content type, emptiness and thinness. fetched: content_type, body_length, word_count."""
    reason = F.when(~F.lower("content_type").contains("html"), "content_type").when(F.col("body_length") == 0, "empty").when(F.col("word_count") < least_words, "thin").otherwise("kept")
    return fetched.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("pages"))


def listing_pages(link_rows: DataFrame, article: str = r"/[a-z0-9]+(?:-[a-z0-9]+){2,}", least: int = 5) -> DataFrame:
    """Pages with at least so many different article-shaped links."""
    out = link_rows.where(F.col("href").rlike(article)).groupBy("page_id").agg(F.countDistinct("href").alias("article_links"))
    return out.withColumn("is_listing", F.col("article_links") >= least)


def inferred_pattern(urls: DataFrame) -> DataFrame:
    """The address pattern of a sample: numbered slugs, a dominant first segment, or any page.

    urls: url. One row: samples, shares, segment, pattern (null under five samples).
    """
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    rows = urls.select(path.alias("path"), F.get(F.split(path, "/"), F.lit(1)).alias("segment"))
    top = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "segment")).alias("t"))
    shares = rows.agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("path").rlike(r"-\d{3,}\.html$").cast("int")).alias("numbered"), F.avg(F.col("path").endswith(".html").cast("int")).alias("html"))
    out = shares.join(F.broadcast(top))  # one row each
    share = F.col("t.n") / F.col("samples")
    pattern = F.when(F.col("samples") < 5, None).when(F.col("numbered") >= 0.8, r"-\d+\.html$").when(share >= 0.8, F.concat(F.lit("^/"), F.col("t.segment"), F.when(F.col("html") >= 0.8, r"/.*\.html$").otherwise("/"))).otherwise(r"\.html$")
    return out.select("samples", "numbered", "html", F.col("t.segment").alias("segment"), pattern.alias("pattern"))


def floor_seed(hits: DataFrame) -> DataFrame:
    """Greatest count of each channel and half their sum. hits: channel, observed."""
    best = hits.groupBy("channel").agg(F.max("observed").alias("observed"))
    half = F.broadcast(best.agg(F.floor(F.sum("observed") / 2).alias("floor")))  # one row
    return best.join(half)


def changed_addresses(found: DataFrame, state: DataFrame, now: str, stale_days: int = 14) -> DataFrame:
    """Addresses to fetch: new, changed since, or stale. found: url, lastmod; state: url, seen_lastmod, fetched_at."""
    old = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(stale_days))
    both = found.join(state, "url", "left")
    reason = F.when(F.col("fetched_at").isNull(), "new").when(F.col("lastmod") > F.col("seen_lastmod"), "changed").when(F.col("fetched_at") < old, "stale")
    return both.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("url", "lastmod", "reason")


def merged_state(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """State after a run: fetched values replace older ones where they are known."""
    new = fetched.select("url", F.col("lastmod").alias("n_lastmod"), F.col("etag").alias("n_etag"), F.col("fetched_at").alias("n_at"))
    return state.join(new, "url", "full").select("url", F.coalesce("n_lastmod", "seen_lastmod").alias("seen_lastmod"), F.coalesce("n_etag", "etag").alias("etag"), F.coalesce("n_at", "fetched_at").alias("fetched_at"))


def merged_channels(found: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each address under the first channel that has it, newest first, undated last. found: channel, url, lastmod."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("channel"))
    w = Window.partitionBy("url").orderBy(rank, F.desc_nulls_last("lastmod"))
    return found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").orderBy(F.desc_nulls_last("lastmod"), "url")


def channel_counts(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Discovered, and left after the merge, of each channel."""
    seen = found.groupBy("channel").agg(F.countDistinct("url").alias("discovered"))
    left = merged.groupBy("channel").agg(F.count(F.lit(1)).alias("after_dedup"))
    return seen.join(left, "channel", "left").withColumn("after_dedup", F.coalesce("after_dedup", F.lit(0)))


def underflow_states(runs: DataFrame) -> DataFrame:
    """pending at the first run under the floor, alerted from the second in a row, recovered at the first over it. runs: channel, run_at, discovered, floor."""
    w = Window.partitionBy("channel").orderBy("run_at")
    low = F.col("discovered") < F.col("floor")
    out = runs.withColumn("low", low).withColumn("l1", F.lag("low").over(w)).withColumn("l2", F.lag("low", 2).over(w))
    was = F.coalesce("l1", F.lit(False)) & F.coalesce("l2", F.lit(False))
    state = F.when(F.col("low") & F.coalesce("l1", F.lit(False)), "alerted").when(F.col("low"), "pending").when(was, "recovered").otherwise("ok")
    return out.withColumn("state", state).drop("low", "l1", "l2")


def funnel(outcomes: DataFrame) -> DataFrame:
    """Counters of each run. outcomes: run_id, outcome."""
    kinds = ("discovered", "fetched", "thin", "failed", "submitted")
    return outcomes.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def fresh_cache(cache: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """The newest row of each key that is not older than the lifetime."""
    best = cache.groupBy("key").agg(F.max(F.struct("cached_at", "payload")).alias("m")).select("key", "m.*")
    return best.where(F.col("cached_at") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours)))


def point_read(rows: DataFrame, key: str, keys: Sequence[int]) -> DataFrame:
    """The row of each key, and status: found or not_found."""
    wanted = rows.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"{key} long")
    found = rows.withColumn("status", F.lit("found"))
    return wanted.join(found, key, "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def job_status(outcomes: DataFrame) -> DataFrame:
    """Job status from upload failures alone, with all failures counted. outcomes: job_id, outcome (ok, upload_failed, status_failed)."""
    out = outcomes.groupBy("job_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("outcome") == "upload_failed").alias("upload_failed"), F.count_if(F.col("outcome") == "status_failed").alias("status_failed"))
    return out.withColumn("status", F.when(F.col("upload_failed") == 0, "completed").when(F.col("upload_failed") == F.col("documents"), "failed").otherwise("completed_with_errors"))


def expired(docs: DataFrame, jobs: DataFrame, now: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Documents that stay, and jobs that still have one."""
    stay = docs.where(F.col("ingested_at") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))
    return stay, jobs.join(stay.select("job_id"), "job_id", "left_semi")
