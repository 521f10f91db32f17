"""Per-document extractors and batch derivations over text."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from textloom.functions.core import word_count
from textloom.functions.scratch import materialize
from textloom.operators.compounds import compounds
from textloom.session import bound_batches

#: ASCII punctuation that is stripped from words and aliases.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def document_facts(docs: DataFrame) -> DataFrame:
    """word_count, publication_hour and publication_weekday (Monday is 0) as long facts. docs: article_id, source, timestamp, text."""
    cols = {"word_count": word_count(F.col("text")), "publication_hour": F.hour("timestamp"), "publication_weekday": F.weekday("timestamp")}
    wide = docs.select("article_id", "source", "timestamp", *[c.cast("double").alias(n) for n, c in cols.items()])
    return wide.unpivot(["article_id", "source", "timestamp"], list(cols), "metric_name", "value").where(F.col("value").isNotNull())


def lexicon(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """(word, weight) from (word, weight, inflections "a,b"); inflections share the weight, overrides win, then the first by source order."""
    own = rows.select(F.explode(F.array_union(F.array(F.lower("word")), F.transform(F.filter(F.split("inflections", ","), lambda w: w != ""), lambda w: F.lower(w)))).alias("word"), "weight", F.lit(1).alias("p"))
    every = own.unionByName(overrides.select(F.lower("word").alias("word"), "weight", F.lit(0).alias("p")))
    return every.groupBy("word").agg(F.min(F.struct("p", "weight")).alias("m")).select("word", F.col("m.weight").alias("weight"))


def lexicon_hash(lex: DataFrame) -> DataFrame:
    """Sixteen hex digits that name a lexicon."""
    lines = F.sort_array(F.collect_list(F.concat_ws("=", "word", F.col("weight").cast("string"))))
    return lex.agg(F.substring(F.sha2(F.concat_ws("|", lines), 256), 1, 16).alias("hash"))


def lexicon_sentiment(docs: DataFrame, lex: DataFrame, words: int = 200_000) -> DataFrame:
    """Mean weight of the words that the lexicon has, clamped and rounded to 4 places; texts without hits have no row."""
    tokens = docs.select("article_id", F.explode(F.split(F.lower("text"), r"[ \n\t]+")).alias("t"))
    tokens = tokens.select("article_id", F.btrim("t", F.lit(PUNCTUATION)).alias("word"))
    small = F.broadcast(lex) if lex.limit(words + 1).count() <= words else lex
    hits = tokens.join(small, "word").groupBy("article_id").agg(F.avg("weight").alias("w"))
    return hits.select("article_id", F.round(F.greatest(F.least("w", F.lit(1.0)), F.lit(-1.0)), 4).alias("value"))


#: Marks that end a clause, and words that negate what follows in theirs.
CLAUSE_ENDS = r"[,.;:!?\n]+"
NEGATORS = ("not", "no", "never", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca")


def clause_words(docs: DataFrame) -> DataFrame:
    """(article_id, words) for each clause: lower-cased, without punctuation around them."""
    clauses = docs.select("article_id", F.explode(F.split(F.lower("text"), CLAUSE_ENDS)).alias("clause"))
    return clauses.select("article_id", F.transform(F.split("clause", r"[ \t]+"), lambda w: F.btrim(w, F.lit(PUNCTUATION))).alias("words"))


def clause_tokens(docs: DataFrame, negators: Sequence[str] = ()) -> DataFrame:
    """(article_id, negation, pos, word) of every word of clause_words, pos from 0; negation is the place, from 1, of the first negator of its clause, or 0.

    Words are trimmed after they are rows, and the words of a clause are searched
    only where a negator may stand in it, so that little runs element by element.
    """
    clauses = docs.select("article_id", F.explode(F.split(F.lower("text"), CLAUSE_ENDS)).alias("clause"))
    negation = F.lit(0).cast("long")
    if negators:
        edge = "[ \\t" + "".join("\\" + c for c in PUNCTUATION) + "]"
        may = F.col("clause").rlike(f"(?:^|{edge})(?:{'|'.join(map(_quoted, negators))})(?:$|{edge})")
        stands = F.transform(F.split("clause", r"[ \t]+"), lambda w: F.btrim(w, F.lit(PUNCTUATION)).isin(*negators))
        negation = F.when(may, F.array_position(stands, True)).otherwise(negation)
    # a column beside the explosion would be computed for each word; outer: else clauses are split once more to see that they have words
    rows = clauses.select("article_id", "clause", negation.alias("negation")).select("article_id", "negation", F.posexplode_outer(F.split("clause", r"[ \t]+")).alias("pos", "word"))
    return rows.select("article_id", "negation", "pos", F.btrim("word", F.lit(PUNCTUATION)).alias("word"))


def _quoted(word: str) -> str:
    """A regular expression, for Java, of the word itself."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in word)


def with_compounds(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """The lexicon and the words of docs that fall apart into its words, with the mean weight of their parts: word, weight."""
    words = clause_tokens(docs).select("word")
    return materialize(lex.select("word", "weight").unionByName(compounds(words, lex).select("word", "weight")), "lexicon")


def negated_sentiment(docs: DataFrame, lex: DataFrame, negators: Sequence[str] = NEGATORS, words: int = 200_000) -> DataFrame:
    """lexicon_sentiment, with hits inverted after a negator of the same clause; brackets and quotes around a word do not hide it.

    Clauses end at punctuation: the scope that a parse tree would give is not
    available without a parser.
    """
    tokens = clause_tokens(docs, negators)
    small = F.broadcast(lex) if lex.limit(words + 1).count() <= words else lex
    sign = F.when((F.col("negation") > 0) & (F.col("pos") + 1 > F.col("negation")), -1).otherwise(1)
    hits = tokens.join(small, "word").groupBy("article_id").agg(F.avg(F.col("weight") * sign).alias("w"))
    return hits.select("article_id", F.round(F.greatest(F.least("w", F.lit(1.0)), F.lit(-1.0)), 4).alias("value"))


#: Frequent words by which the built-in detector tells languages.
STOPWORDS = {
    "de": "der die das und ist nicht ein eine zu den mit von für auf dem des sich",
    "en": "the of and to in is that it was for on are with as by be this",
    "fr": "le la les de des et un une est que pour dans qui pas sur au du",
    "es": "el la los las de que y en un una es por con para del se no",
}


def detect(text: str | None, most: int = 3) -> list[tuple[str, float]]:
    """Languages by share of stop words; texts under ten characters have none. A stand-in where no detector library is installed."""
    if not text or len(text.strip()) < 10:
        return []
    words = Counter(text.lower().split())
    hits = {lang: sum(words[w] for w in stops.split()) for lang, stops in STOPWORDS.items()}
    total = sum(hits.values())
    if not total:
        return [("und", 0.0)]
    return [(lang, round(n / total, 4)) for lang, n in sorted(hits.items(), key=lambda x: (-x[1], x[0])) if n][:most]


DETECTIONS = ArrayType(StructType([StructField("language", StringType()), StructField("confidence", DoubleType())]))


#: Texts under this length are left to the second detector where two disagree.
SHORT = 100


def arbitrated(text: str | None, second: Callable[[str], tuple[str, float] | None] | None = None) -> list[tuple[str, float]]:
    """Ranked languages of a text. With a second detector: the winner, then the candidates of the first, then the second's choice.

    The first wins where both agree or the text is not short, the second where
    they differ on a short text, and either where the other finds nothing.
    """
    first = detect(text)
    if second is None or not text or len(text.strip()) < 10:
        return first
    known, other = [d for d in first if d[0] != "und"], second(text)
    if other is None:
        return known[:1] + known if known else first
    take_other = not known or (known[0][0] != other[0] and len(text) < SHORT)
    return [other if take_other else known[0], *known, other]


def detections(docs: DataFrame, second: Callable[[str], tuple[str, float] | None] | None = None) -> DataFrame:
    """Ranked languages of each text. second: the language and confidence of another detector, or None."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(DETECTIONS)
    def detected(text: pd.Series) -> pd.Series:
        return pd.Series([[{"language": a, "confidence": round(c, 4)} for a, c in arbitrated(t, second)] for t in text])

    rows = docs.select("article_id", F.posexplode(detected("text")).alias("i", "d"))
    return rows.select("article_id", F.col("d.language").alias("detected_language"), "d.confidence", (F.col("i") + 1).alias("rank"))


def entity_spans(docs: DataFrame) -> DataFrame:
    """Runs of capitalised words as entity candidates: the slot of a recogniser, with its span filter."""
    words = F.filter(F.regexp_extract_all("text", F.lit(r"((?:\p{Lu}\p{L}+ ?)+)"), 1), lambda s: F.trim(s) != "")
    rows = docs.select("article_id", F.posexplode(F.transform(words, lambda s: F.trim(s))).alias("nth", "entity_text"))
    return rows.where(valid_span(F.col("entity_text")))


def valid_span(span: Column) -> Column:
    """Not blank, at most 80 characters and six words."""
    return (F.trim(span) != "") & (F.length(span) <= 80) & (F.size(F.split(F.trim(span), r"\s+")) <= 6)


def normal_alias(text: Column) -> Column:
    return F.lower(F.trim(F.translate(text, PUNCTUATION, "")))


@F.pandas_udf(StringType())
def accent_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


#: Confidence of a link by how its alias matched.
CONFIDENCE = {"label": 1.0, "altLabel": 0.85, "fold": 0.7}


def entity_links(entities: DataFrame, aliases: DataFrame, fold: bool = False) -> DataFrame:
    """The best alias of each entity text: by match, then sitelinks, then source and qid. aliases: alias, qid, source, sitelinks.

    fold: texts without an alias are tried again with accents folded on both sides, as is due for French.
    """
    wanted = entities.select("entity_text", normal_alias(F.col("entity_text")).alias("alias")).distinct()
    rank = F.row_number().over(Window.partitionBy("entity_text").orderBy(F.desc("confidence"), F.desc("sitelinks"), F.desc("source"), "qid"))
    confidence = F.element_at(F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    best = wanted.join(aliases, "alias").withColumn("confidence", confidence).withColumn("r", rank).where("r = 1")
    links = best.select("entity_text", F.col("qid").alias("wikidata_qid"), F.col("confidence").alias("link_confidence"), F.col("source").alias("link_method"))
    if not fold:
        return links
    left = wanted.join(aliases.select("alias").distinct(), "alias", "left_anti").withColumn("folded", accent_fold("alias")).where("folded <> ''")
    index = folded_index(aliases).select("folded", "qid")
    return links.unionByName(left.join(index, "folded").select("entity_text", F.col("qid").alias("wikidata_qid"), F.lit(CONFIDENCE["fold"]).alias("link_confidence"), F.lit("accent_fold").alias("link_method")))


def alias_index(labels: DataFrame) -> DataFrame:
    """One row for each alias and qid: most sitelinks, a label before an alternative one. labels: qid, text, source, sitelinks."""
    rows = labels.select("qid", normal_alias(F.col("text")).alias("alias"), "source", "sitelinks").where("alias <> ''")
    best = rows.groupBy("alias", "qid").agg(F.max(F.struct(F.when(F.col("source") == "label", 1).otherwise(0).alias("p"), "sitelinks", "source")).alias("b"))
    return best.select("alias", "qid", F.col("b.source").alias("source"), F.col("b.sitelinks").alias("sitelinks"))


def display_labels(labels: DataFrame) -> DataFrame:
    """The smallest display label of each qid and language."""
    return labels.groupBy("qid", "language").agg(F.min("text").alias("label"))


def folded_index(aliases: DataFrame) -> DataFrame:
    """The alias of the most sitelinks for each accent-folded form, the first of equals."""
    w = Window.partitionBy("folded").orderBy(F.desc("sitelinks"), "alias", "qid")
    return aliases.withColumn("folded", accent_fold("alias")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def subjects(triples: DataFrame, rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """Subjects with the buckets whose rule holds. triples: subject, predicate, object; rules see columns p31, p106, sitelinks, population."""
    pick = lambda p: F.collect_set(F.when(F.col("predicate") == p, F.col("object")))
    num = lambda p: F.max(F.when(F.col("predicate") == p, F.col("object").cast("long")))
    wide = triples.groupBy("subject").agg(pick("P31").alias("p31"), pick("P106").alias("p106"), num("sitelinks").alias("sitelinks"), num("P1082").alias("population"))
    return wide.withColumn("buckets", F.filter(F.array(*[F.when(r(), F.lit(n)) for n, r in rules.items()]), lambda b: b.isNotNull())).where(F.size("buckets") > 0)


#: Languages that topics are fitted for; each is a job of its own.
LANGUAGES = 200


def topics(docs: DataFrame, least: int = 10, k: int = 8, features: int = 1 << 12, words: int = 5, far: float = 3.0) -> DataFrame:
    """Topic of each document within its language, by hashed tf-idf and k-means with a fixed seed, fitted for each language alone.

    A deterministic stand-in for density clustering of embeddings. Languages
    with fewer than ``least`` documents, blank or undetermined are left out;
    more than ``LANGUAGES`` others are a ValueError. topic_id counts within a
    language. A document is an outlier (-1, confidence 0) if it has no word of
    any weight, if its topic has fewer than ``least`` documents, or if it lies
    further from its centre than ``far`` standard deviations above the mean
    of its language. topic_label names the ``words`` words of most weight.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    docs = docs.where(~F.coalesce("language", F.lit("")).isin("", "und"))
    sizes = docs.groupBy("language").count().where(F.col("count") >= least).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    known = docs.where(F.col("language").isin(*[r["language"] for r in sizes]))
    split = known.withColumn("words", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \n\t]+"), lambda w: w != ""))
    # texts are read and hashed once for all languages; the blocks keep their rows in place, on which the seeded choice of first centres depends
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=features).transform(split).select("article_id", "language", F.array_distinct("words").alias("terms"), "tf").persist(StorageLevel.DISK_ONLY)
    empty = docs.limit(0).select("article_id", "language", F.lit(0).alias("topic"), F.lit(0.0).alias("distance"), F.array().cast("array<string>").alias("terms"))
    parts = [empty]
    try:
        for language in sorted(r["language"] for r in sizes):
            own = tf.where(F.col("language") == language)
            weighed = IDF(inputCol="tf", outputCol="weighed").fit(own).transform(own)
            vectors = Normalizer(inputCol="weighed", outputCol="features").transform(weighed)
            model = KMeans(k=k, seed=7, maxIter=10).fit(vectors)
            out = model.transform(vectors).withColumn("distance", _distance(model.clusterCenters())("features", "prediction"))
            parts.append(out.select("article_id", "language", F.col("prediction").alias("topic"), "distance", "terms"))
        rows = materialize(reduce(DataFrame.unionByName, parts), "topics")
    finally:
        tf.unpersist()
    near = rows.groupBy("language").agg((F.avg("distance") + far * F.stddev_pop("distance")).alias("most"), F.count(F.lit(1)).alias("docs"))
    members = rows.groupBy("language", "topic").agg(F.count("distance").alias("members"))
    inside = (F.col("members") >= least) & (F.col("distance") <= F.col("most") + 1e-9)
    rows = rows.join(F.broadcast(near), "language").join(F.broadcast(members), ["language", "topic"]).withColumn("topic_id", F.when(inside, F.col("topic")).otherwise(-1))
    terms = rows.select("language", "topic_id", "docs", F.explode("terms").alias("word")).groupBy("language", "topic_id", "docs", "word").agg(F.count(F.lit(1)).alias("n"))
    every = terms.groupBy("language", "word").agg(F.sum("n").alias("df"))
    weight = F.col("n") * F.log(F.col("docs") / F.col("df"))
    best = Window.partitionBy("language", "topic_id").orderBy(F.desc("weight"), "word")
    first = terms.where("topic_id <> -1").join(every, ["language", "word"]).withColumn("weight", weight).withColumn("r", F.row_number().over(best)).where(F.col("r") <= words)
    labels = first.groupBy("language", "topic_id").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("w")).select("language", "topic_id", F.array_join("w.word", "_").alias("names"))
    label = F.when(F.col("topic_id") == -1, "outlier").otherwise(F.concat_ws("_", F.col("topic_id").cast("string"), "names"))
    model_hash = F.sha2(F.concat(F.lit(f"tfidf-kmeans:{features}:{k}:7:10:{least}:{far}:"), "language"), 256)
    return rows.join(F.broadcast(labels), ["language", "topic_id"], "left").select("article_id", "language", "topic_id", label.alias("topic_label"), F.when(F.col("topic_id") == -1, 0.0).otherwise(1.0).alias("topic_confidence"), model_hash.alias("model_hash"))


def _distance(centres: list):
    """Distance of a vector to its centre; null for a vector without any weight."""
    squares = [float(c @ c) for c in centres]

    @F.udf("double")
    def run(v, topic):
        own = float(v.values @ v.values)
        return max(0.0, own - 2 * float(centres[topic][v.indices] @ v.values) + squares[topic]) ** 0.5 if own else None

    return run


def topic_evolution(assignments: DataFrame, start: str, end: str, top: int = 8) -> DataFrame:
    """Articles of each topic in 3 to 14 equal buckets of [start, end): the first topics, the outlier and the rest as "other", zeros filled."""
    a, b = F.unix_timestamp(F.lit(start).cast("timestamp")), F.unix_timestamp(F.lit(end).cast("timestamp"))
    n = F.greatest(F.lit(3), F.least(F.lit(14), F.round((b - a) / 43200).cast("int")))
    rows = assignments.withColumn("_s", F.unix_timestamp(F.col("timestamp").cast("timestamp"))).where((F.col("_s") >= a) & (F.col("_s") < b))
    rows = rows.withColumn("bucket", F.floor((F.col("_s") - a) * n / (b - a)).cast("int"))
    first = rows.where("topic_id <> -1").groupBy("topic_id").agg(F.countDistinct("article_id").alias("c")).orderBy(F.desc("c"), "topic_id").limit(top)
    named = rows.join(F.broadcast(first.select("topic_id", F.lit(1).alias("r"))), "topic_id", "left")
    named = named.withColumn("topic", F.when(F.col("topic_id") == -1, "outlier").when(F.col("r").isNotNull(), F.col("topic_id").cast("string")).otherwise("other"))
    counts = named.groupBy("topic", "bucket").agg(F.countDistinct("article_id").alias("articles"))
    frame = named.select("topic").distinct().select("topic", F.explode(F.sequence(F.lit(0), n - 1)).alias("bucket"))
    return frame.join(counts, ["topic", "bucket"], "left").select("topic", "bucket", F.coalesce("articles", F.lit(0)).alias("articles"))


def guarded_udf(f: Callable[[str], float | None]):
    """A UDF of (value, error): a failing extractor must not fail the document."""
    @F.pandas_udf(StructType([StructField("value", DoubleType()), StructField("error", StringType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        got = []
        for t in texts:
            try:
                got.append((f(t), None))
            except Exception as e:
                got.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(got, columns=["value", "error"])

    return run


def isolated(docs: DataFrame, extractors: dict[str, Callable[[str], float | None]], text: str = "text") -> DataFrame:
    """Values of each extractor and, where one fails on a text, its error; the other extractors go on."""
    return docs.withColumns({name: guarded_udf(f)(F.col(text)) for name, f in extractors.items()})


def provenance(versions: dict[str, str]) -> Column:
    """Map of extractor names to version hashes."""
    return F.create_map(*[F.lit(x) for kv in sorted(versions.items()) for x in kv])


def model_sentiment(docs: DataFrame, classify: Callable[[list[str]], list[tuple[float, float]]], languages: Sequence[str], batch: int = 64) -> DataFrame:
    """P(positive) - P(negative) of a classifier on texts of the languages it knows, clamped and rounded to 4 places.

    classify: (positive, negative) of each text; it is loaded once a worker.
    """
    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got: list[float] = []
            for k in range(0, len(texts), batch):
                got += [max(-1.0, min(1.0, p - n)) for p, n in classify(texts.iloc[k : k + batch].fillna("").tolist())]
            yield pd.Series(got, dtype=float)

    return docs.where(F.col("language").isin(*languages)).select("article_id", F.round(run(F.col("text")), 4).alias("value"))
