"""Benchmark passages in documents, by a distributed positional inverted index.

Only DataFrame operations. The index holds the postings (term, document,
position) of the benchmark's terms. A phrase is looked up from its rarest
term: the offset-adjusted postings of that term give candidate starts, those of
the next rarest are intersected with them, and survivors are compared whole.
Which items a phrase belongs to is kept in rows and looked up last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import BROADCAST_ROWS, bounded, materialize

#: Runs of these characters part words (after lower-casing A-Z): the complement of the contract's word class.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    # for ASCII texts lower() is that and quick
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lower, PARTING), lambda w: w != "")


#: Parts into which postings of one term are dealt where they are joined by a shuffle.
SALTS = 32


def benchmark_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase): windows of ``size`` words, or whole shorter items. Null texts and texts without words have none; null ids are no items."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.greatest(F.size("words") - size, F.lit(0))
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("words", i + 1, size))).alias("phrase"))


def by_term(left: DataFrame, right: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """Postings joined with ``rows`` counted rows of terms: broadcast if few, else by a shuffle that deals each term's postings into SALTS parts."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), "term", how)
    left = left.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["term", "salt"], how).drop("salt")


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index: (term, key, pos) of every occurrence of the terms (term, word). docs: (key, words)."""
    at = docs.select("key", F.posexplode("words").alias("pos", "word"))
    return at.join(bounded(terms, n_terms), "word").select("term", "key", "pos")


def phrase_hits(index: DataFrame, phrases: DataFrame, terms: DataFrame, n_phrases: int, counts: DataFrame) -> DataFrame:
    """(phrase_id, key, start) where the offset-adjusted postings of a phrase's rarest two terms meet.

    phrases: (phrase_id, phrase). A phrase of one term gives that term's postings.
    """
    parts = phrases.select("phrase_id", F.posexplode("phrase").alias("off", "word")).join(terms, "word").join(counts, "term")
    # one place for each term of a phrase, rarest first; a phrase with a term that occurs nowhere has fewer places
    once = parts.groupBy("phrase_id", "term", "n").agg(F.min("off").alias("off"))
    rank = F.row_number().over(Window.partitionBy("phrase_id").orderBy("n", "off"))
    ranked = once.withColumn("r", rank)
    want = phrases.select("phrase_id", F.size(F.array_distinct("phrase")).alias("want"))
    whole = once.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("have")).join(want, "phrase_id").where("have = want")
    first = ranked.where("r = 1").join(whole, "phrase_id").select("phrase_id", "term", "off", "want")
    second = ranked.where("r = 2").select("phrase_id", F.col("term").alias("term2"), F.col("off").alias("off2"))
    seeds = first.join(second, "phrase_id", "left")
    starts = by_term(index, seeds, n_phrases).select("phrase_id", "key", (F.col("pos") - F.col("off")).alias("start"), "term2", "off2", "want").where("start >= 0")
    single = starts.where("want = 1").select("phrase_id", "key", "start")
    again = by_term(index, second.select(F.col("term2").alias("term")).distinct(), n_phrases, "left_semi")
    pairs = starts.where("want > 1").withColumn("pos", F.col("start") + F.col("off2"))
    both = pairs.join(again.withColumnRenamed("term", "term2"), ["key", "pos", "term2"], "left_semi").select("phrase_id", "key", "start")
    return single.unionByName(both)


def proximity_matches(index: DataFrame, first: int, second: int, slop: int) -> DataFrame:
    """(key, pos, other): postings of two terms at most ``slop`` words apart, in either order."""
    a = index.where(F.col("term") == first).select("key", "pos")
    b = index.where(F.col("term") == second).select("key", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)).alias("pos"), F.col("pos").alias("other"))
    return a.join(b, ["key", "pos"]).select("key", "pos", "other")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated of each row.

    A word of a document is hit if it lies in an occurrence of a window of an
    item. Null and empty texts have no words; items without words or id match
    nothing; repeated items count once each id. carry: also ``row``, a struct of
    all columns of docs. Rows that agree in id and text
    give equal results, each its own; null ids are kept. Ids are integers. Empty
    tables give an empty result, or one without hits.
    """
    rows = [F.struct(*docs.columns).alias("row")] if carry else []
    also = ["row"] if carry else []
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rows)
    twice = own.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count()
    # the key of a row: its id, or where ids repeat or are null 128 bits of id and text
    own = own.withColumn("key", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary")) if twice else F.col("doc_id").cast("long"))
    owners = materialize(benchmark_windows(items, size, item_id, item_text).withColumn("phrase_id", F.xxhash64("phrase")).distinct(), "owners")
    phrases = materialize(owners.select("phrase_id", "phrase", F.size("phrase").alias("len")).distinct(), "phrases")
    n_phrases = phrases.count()
    terms = phrases.select(F.explode("phrase").alias("word")).distinct().withColumn("term", F.xxhash64("word"))
    terms = materialize(terms, "terms")
    n_terms = terms.count()
    index = materialize(postings(own.select("key", words_of(F.col("text")).alias("words")), terms, n_terms), "postings")
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "term-counts")
    found = phrase_hits(index, phrases.select("phrase_id", "phrase"), terms, n_phrases, counts).distinct()
    asked = found.join(bounded(phrases, n_phrases), "phrase_id").groupBy("key").agg(F.collect_list(F.struct("start", "len", "phrase")).alias("asked"))
    # survivors are compared whole with the words of their document
    read = own.select("key", "text")
    read = (read.dropDuplicates(["key"]) if twice else read).join(asked, "key", "left").select("key", words_of(F.col("text")).alias("words"), "asked")
    hits = F.filter(F.coalesce("asked", F.array().cast("array<struct<start:int,len:int,phrase:array<string>>>")), lambda a: F.slice("words", a["start"] + 1, a["len"]) == a["phrase"])
    read = read.select("key", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    read = materialize(read.select("key", "n_words", F.size(places).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["phrase"])).alias("found")), "hits")
    which = read.select("key", F.explode("found").alias("phrase")).join(owners.select("phrase", "item_id"), "phrase")
    which = which.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    read = own.select(*also, "doc_id", "key").join(read.drop("found"), "key").join(which, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return read.select(*also, "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
