"""Raw documents to the clean layer: adapters, field resolvers, contracts, rejects."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import dom

#: Reasons for which a document is put aside. Consumers match on them.
REASONS = ("unknown_source_type", "extraction_failed", "harmonization_failed", "silver_validation_failed", "language_scope_violation")
#: Named character references that text cleaning knows besides numeric ones.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def document_id(source: Column, key: Column) -> Column:
    return F.sha2(F.concat(source, key), 256)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_text(markup: Column) -> Column:
    """Tags removed, references decoded, blanks collapsed."""
    out = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for ref, char in REFERENCES.items():
        out = F.replace(out, F.lit(ref), F.lit(char))
    return collapse(out)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def legacy(docs: DataFrame) -> DataFrame:
    return docs.withColumn("cleaned_text", collapse(F.col("raw_text"))).withColumn("word_count", words(F.col("cleaned_text")))


def rss(docs: DataFrame) -> DataFrame:
    return docs.withColumn("cleaned_text", plain_text(F.concat_ws(" ", "title", "raw_text"))).withColumn("word_count", words(F.col("cleaned_text")))


def web(docs: DataFrame) -> DataFrame:
    """Article body: the article or main element, else the paragraphs, else all visible text."""
    html = F.col("raw_html")
    body = F.nullif(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1), F.lit(""))
    main = F.nullif(F.regexp_extract(html, r"(?is)<main[^>]*>(.*?)</main>", 1), F.lit(""))
    paragraphs = F.nullif(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1), " "), F.lit(""))
    method = F.when(body.isNotNull(), "article").when(main.isNotNull(), "main").when(paragraphs.isNotNull(), "paragraphs").otherwise("page")
    return docs.withColumn("cleaned_text", plain_text(F.coalesce(body, main, paragraphs, html))).withColumn("extraction_method", method).withColumn("word_count", words(F.col("cleaned_text")))


ADAPTERS = {"legacy": legacy, "rss": rss, "web": web}


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by property or name, in either attribute order; null where missing or empty."""
    at = rf'(?:property|name|itemprop)="{name}"'
    one = F.regexp_extract(html, rf'(?is)<meta[^>]*{at}[^>]*content="([^"]*)"', 1)
    two = F.regexp_extract(html, rf'(?is)<meta[^>]*content="([^"]*)"[^>]*{at}', 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))


def json_ld(html: Column, path: str) -> Column:
    """Value at a JSON path of the first linked-data script; null where missing or empty."""
    return F.nullif(F.get_json_object(F.regexp_extract(html, r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), path), F.lit(""))


def first_of(**candidates: Column) -> Column:
    """(value, method) of the first candidate that is not null."""
    value = F.coalesce(*candidates.values())
    method = None
    for name, c in candidates.items():
        method = F.when(c.isNotNull(), name) if method is None else method.when(c.isNotNull(), name)
    return F.struct(value.alias("value"), method.otherwise("null").alias("method"))


def resolve_fields(docs: DataFrame) -> DataFrame:
    """Title, dates, author, description, section, image, categories, type and the access fields, each as (value, method)."""
    h = F.col("raw_html")
    element = lambda tag: F.nullif(collapse(F.regexp_replace(F.regexp_extract(h, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)<[^>]+>", "")), F.lit(""))
    time_at = F.nullif(F.regexp_extract(h, r'(?is)<time[^>]*datetime="([^"]*)"', 1), F.lit(""))
    year = F.regexp_extract(h, r"\b((?:19|20)\d\d-\d\d-\d\d)\b", 1)
    # a bare first of January is a year in disguise
    guess = F.when((year != "") & ~year.endswith("-01-01"), year)
    free = json_ld(h, "$.isAccessibleForFree")
    return docs.withColumns({
        "title": first_of(json_ld=json_ld(h, "$.headline"), og=meta(h, "og:title"), html_title=element("title"), h1=element("h1")),
        "published": first_of(json_ld=json_ld(h, "$.datePublished"), og=meta(h, "article:published_time"), microdata=meta(h, "datePublished"), time=time_at, heuristic=guess),
        "modified": first_of(json_ld=json_ld(h, "$.dateModified"), og=meta(h, "article:modified_time"), microdata=meta(h, "dateModified")),
        "author": first_of(json_ld=json_ld(h, "$.author.name"), meta=meta(h, "author")),
        "description": first_of(json_ld=json_ld(h, "$.description"), og=meta(h, "og:description"), meta=meta(h, "description")),
        "section": first_of(json_ld=json_ld(h, "$.articleSection"), og=meta(h, "article:section")),
        "image": first_of(json_ld=json_ld(h, "$.image.url"), og=meta(h, "og:image")),
        "tags": first_of(json_ld=json_ld(h, "$.keywords"), meta=meta(h, "keywords")),
        "article_type": first_of(json_ld=json_ld(h, "$['@type']"), og=meta(h, "og:type")),
        "paywall": first_of(json_ld=F.when(free.isNotNull(), (~(F.lower(free) == "true")).cast("string"))),
        "editor": first_of(json_ld=json_ld(h, "$.editor.name")), "dateline": first_of(json_ld=json_ld(h, "$.dateline")), "correction": first_of(json_ld=json_ld(h, "$.correction")),
        "comment_count": first_of(json_ld=json_ld(h, "$.commentCount")), "reading_time": first_of(json_ld=minutes(json_ld(h, "$.timeRequired")).cast("string")),
    })


def minutes(duration: Column) -> Column:
    """Minutes of an ISO 8601 duration PTnM or PTnHnM."""
    hours, mins = F.regexp_extract(duration, r"PT(?:(\d+)H)?(?:(\d+)M)?", 1), F.regexp_extract(duration, r"PT(?:(\d+)H)?(?:(\d+)M)?", 2)
    return F.when(duration.startswith("PT"), F.coalesce(F.when(hours != "", hours.cast("int")), F.lit(0)) * 60 + F.coalesce(F.when(mins != "", mins.cast("int")), F.lit(0)))


def image_identity(url: Column) -> Column:
    """Host and path of an image without rendition segments such as 640x480, lower-cased."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"(?i)[/_-]?\d{2,4}x\d{2,4}", "")
    return F.lower(F.concat(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), path))


def distinct_images(images: DataFrame) -> DataFrame:
    """The first rendition of each image of an article; images without an address stay. images: article_id, nth, url."""
    with_id = images.withColumn("_id", image_identity(F.col("url")))
    first = with_id.where(F.col("url").isNotNull() & (F.col("url") != "")).groupBy("article_id", "_id").agg(F.min(F.struct("nth", "url")).alias("i")).select("article_id", "i.*")
    return first.unionByName(images.where(F.col("url").isNull() | (F.col("url") == "")).select("article_id", "nth", "url"))


def timestamp_of(published: Column, sitemap: Column, http_modified: Column, fetched: Column) -> Column:
    """(timestamp, timestamp_source): published, upgraded by a sitemap time of the same day where it is midnight; sitemap; header; fetch."""
    midnight = published.isNotNull() & (F.date_trunc("day", published) == published) & (F.to_date(sitemap) == F.to_date(published)) & (sitemap != published)
    value = F.when(midnight, sitemap).otherwise(F.coalesce(published, sitemap, http_modified, fetched))
    source = F.when(midnight, "sitemap_time_upgrade").when(published.isNotNull(), "published").when(sitemap.isNotNull(), "sitemap_lastmod").when(http_modified.isNotNull(), "http_last_modified").otherwise("fetch_at_fallback")
    return F.struct(value.alias("timestamp"), source.alias("timestamp_source"))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, no fragment, no tracking parameters, no trailing slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)([?&])(?:utm_[a-z]+|fbclid|gclid)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?&]+$", ""), r"\?&+", "?")
    head = F.regexp_extract(bare, r"^([a-zA-Z]+://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), r"/$", "")


def capitalised(text: Column) -> Column:
    """How many words, between word boundaries, begin with a capital and go on in letters."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"(?U)\b[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+\b")))


def variety(language: Column, host: Column) -> Column:
    return F.when(language != "de", "").when(host.endswith(".at"), "de-AT").when(host.endswith(".ch"), "de-CH").otherwise("de-DE")


def split_rejects(docs: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reject_reason). docs: source_type, source, raw_text, cleaned_text, language, timestamp.

    allowed: (source, languages); unknown sources and undetermined languages pass.
    """
    if allowed is not None:
        docs = docs.join(allowed, "source", "left")
        outside = F.col("languages").isNotNull() & (F.col("language") != "und") & ~F.array_contains("languages", F.col("language"))
    else:
        outside = F.lit(False)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = F.when(~F.coalesce("source_type", F.lit("legacy")).isin(*ADAPTERS), REASONS[0]).when(F.col("cleaned_text").isNull(), REASONS[1]).when(blank("cleaned_text") | blank("raw_text") | F.col("timestamp").isNull(), REASONS[3]).when(F.coalesce(outside, F.lit(False)), REASONS[4])
    marked = docs.withColumn("reject_reason", reason)
    if allowed is not None:
        marked = marked.drop("languages")
    return marked.where(F.col("reject_reason").isNull()).drop("reject_reason"), marked.where(F.col("reject_reason").isNotNull())


def scalar_facts(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Long facts of the scalar fields that were really extracted: (value, method) structs with a method."""
    one = [F.struct(F.lit(f).alias("metric_name"), F.when(F.col(f)["value"].isin("true", "false"), (F.col(f)["value"] == "true").cast("double")).otherwise(F.col(f)["value"].try_cast("double")).alias("value"), F.col(f)["method"].alias("method")) for f in fields]
    return docs.select("article_id", F.explode(F.array(*one)).alias("m")).select("article_id", "m.metric_name", "m.value").where(F.col("value").isNotNull())


def categorical_facts(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(article_id, field, value array) of fields that are not empty; scalars become arrays of one."""
    arrays = dict(docs.dtypes)
    one = [F.struct(F.lit(f).alias("field"), (F.col(f) if arrays[f].startswith("array") else F.array(F.col(f))).alias("value")) for f in fields]
    rows = docs.select("article_id", F.explode(F.array(*one)).alias("m")).select("article_id", "m.field", F.filter("m.value", lambda v: v.isNotNull() & (v != "")).alias("value"))
    return rows.where(F.size("value") > 0)


def analytical_window(docs: DataFrame, now: str, days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Rows of the last days, and older ones, which are archived only."""
    edge = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    return docs.where(F.col("timestamp") >= edge), docs.where(F.col("timestamp") < edge)


def negative_space(docs: DataFrame) -> DataFrame:
    """What is missing or odd in a row: fetch-time dates, changed headlines, few words, long chains."""
    marks = F.array(F.when(F.col("timestamp_source") == "fetch_at_fallback", "no_real_date"), F.when(F.col("headline_changed"), "headline_changed"), F.when(F.col("word_count") < 50, "thin"), F.when(F.col("chain_length") >= 20, "long_chain"))
    return docs.withColumn("negative_space", F.filter(marks, lambda m: m.isNotNull()))


def custom_fields(docs: DataFrame, rules: dict[str, str | dict[str, str]], html: str = "raw_html") -> DataFrame:
    """A column for each rule of a source: field name to {"css": selector} or {"xpath": path}; plain text is a selector.

    The value is the text of the first match with blanks collapsed, or for a
    path that ends in an attribute or text() that; null where nothing matches,
    where it is blank, and for rules that are not understood. A page is read
    once for all rules.
    """
    paths = {}
    for name, rule in rules.items():
        try:
            paths[name] = dom.css(rule) if isinstance(rule, str) else dom.xpath(rule["xpath"]) if "xpath" in rule else dom.css(rule["css"])
        except (ValueError, KeyError):
            paths[name] = None

    @F.pandas_udf(StructType([StructField(name, StringType()) for name in rules]))
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            nodes = dom.tree(page)
            values = [None if p is None else dom.first_value(nodes, p) for p in paths.values()]
            rows.append([" ".join(v.split()) or None if v is not None else None for v in values])
        return pd.DataFrame(rows, columns=list(paths), dtype=object)

    return docs.withColumn("_fields", run(F.col(html))).select(*docs.columns, *[F.col(f"_fields.{name}").alias(name) for name in rules])


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("method", StringType())]))
def page_body(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dom.body(p) for p in pages], columns=["text", "method"], dtype=object)


def web_by_blocks(docs: DataFrame) -> DataFrame:
    """Article body from the page's tree: article, main, paragraphs, or, where these are short on a long page, the block that most text speaks for ("readability")."""
    out = docs.withColumn("_body", page_body(F.col("raw_html")))
    return out.select(*docs.columns, F.col("_body.text").alias("cleaned_text"), F.col("_body.method").alias("extraction_method")).withColumn("word_count", words(F.col("cleaned_text")))
