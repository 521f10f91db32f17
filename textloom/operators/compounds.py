"""Compound words: where a word that a lexicon lacks falls apart into words that it has.

Letters at the beginning, at the end and inside of words differ. A model of
three-letter groups, fitted on the lexicon's own words, scores every place of a
word as a boundary; of all ways to cut the word into lexicon words the one of
the greatest sum of scores is taken, by dynamic programming over its places.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from textloom.functions.scratch import materialize

#: Letters of a group, and so of the shortest part; letters of the longest word that can be a compound.
GROUP, LONGEST = 3, 64
#: Scores are whole numbers in this unit, so that their sums have no rounding.
UNIT = 1_000_000
CUT = StructType([StructField("weight", DoubleType()), StructField("score", LongType()), StructField("cuts", ArrayType(IntegerType()))])


def groups(word: Column) -> Column:
    """The three-letter groups of a word of three letters at least, in order."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - GROUP + 1), lambda i: F.substring(word, i, F.lit(GROUP)))


def position_model(lexicon: DataFrame) -> DataFrame:
    """(gram, starts, ends, inside): shares of a group's occurrences in lexicon words that begin a word, end one, lie within; a word of one group does both."""
    words = lexicon.where(F.length("word") >= GROUP).select("word").distinct().select(F.posexplode(groups(F.col("word"))).alias("i", "gram"), (F.length("word") - GROUP).alias("last"))
    marks = words.groupBy("gram").agg(F.count_if(F.col("i") == 0).alias("a"), F.count_if(F.col("i") == F.col("last")).alias("b"), F.count_if((F.col("i") > 0) & (F.col("i") < F.col("last"))).alias("c"))
    whole = F.col("a") + F.col("b") + F.col("c")
    return marks.select("gram", (F.col("a") / whole).alias("starts"), (F.col("b") / whole).alias("ends"), (F.col("c") / whole).alias("inside"))


def boundary_scores(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word, scores): for each place of a word, from GROUP letters on, how much it looks like a boundary.

    The share of ends of the group before, plus the share of beginnings of the
    group after, less the greater of the shares within of the two groups across.
    """
    places = words.select("word", F.posexplode(groups(F.col("word"))).alias("i", "gram")).join(model, "gram", "left")
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce(c, F.lit(0.0)).alias("s")))), lambda x: x["s"])
    rows = places.groupBy("word").agg(*[of(c).alias(c) for c in ("starts", "ends", "inside")])
    at = F.sequence(F.lit(GROUP), F.length("word") - GROUP)
    score = lambda i: F.floor((F.get("ends", i - GROUP) + F.get("starts", i) - F.greatest(F.get("inside", i - GROUP + 1), F.get("inside", i - 1))) * UNIT)
    return rows.select("word", F.transform(at, score).alias("scores"))


def best_cut(length: int, scores: list[int], parts: list[tuple[int, int, float]]) -> tuple[float, int, list[int]] | None:
    """(mean weight of the parts, score, places of the cuts) of the best way to cover a word with two parts (start, letters, weight) or more.

    The greatest sum of scores, then the fewest parts, then the earliest cuts;
    none below zero.
    """
    best: dict[int, tuple[int, int, tuple[int, ...], tuple[float, ...]]] = {0: (0, 0, (), ())}
    better = lambda a, b: b is None or (-a[0], a[1], a[2]) < (-b[0], b[1], b[2])
    for start, letters, weight in sorted(parts):
        if (before := best.get(start)) is None or letters == length:
            continue
        end = start + letters
        cut = () if start == 0 else (start,)
        new = (before[0] + (scores[start - GROUP] if start else 0), before[1] + 1, before[2] + cut, (*before[3], weight))
        if better(new, best.get(end)):
            best[end] = new
    got = best.get(length)
    return None if got is None or got[0] < 0 else (sum(got[3]) / len(got[3]), got[0], list(got[2]))


@F.pandas_udf(CUT)
def _best_cuts(length: pd.Series, scores: pd.Series, parts: pd.Series) -> pd.DataFrame:
    got = [best_cut(n, list(s), [(p["start"], p["letters"], p["weight"]) for p in ps]) for n, s, ps in zip(length, scores, parts, strict=True)]
    return pd.DataFrame([g or (None, None, None) for g in got], columns=["weight", "score", "cuts"])


def compounds(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, weight, cuts) of the words that fall apart into words of lexicon(word, weight); weight is the mean of the parts'.

    Words of the lexicon, null words, and words under six or over LONGEST
    letters are none. A word must begin with a lexicon word and end with one
    before its other pieces are looked up, so that most words cost a few rows.
    Repeated words give one row; an empty lexicon gives none.
    """
    lex = materialize(lexicon.where(F.length("word") >= GROUP).groupBy("word").agg(F.min("weight").alias("weight")), "lexicon")
    most = lex.agg(F.max(F.length("word"))).first()[0] or 0
    wanted = words.select("word").where((F.length("word") >= 2 * GROUP) & (F.length("word") <= LONGEST)).distinct().join(lex.select("word"), "word", "left_anti")
    letters = F.sequence(F.lit(GROUP), F.least(F.lit(max(most, GROUP)), F.length("word") - GROUP))
    for end in (lambda n: F.substring("word", F.lit(1), n), lambda n: F.substring("word", F.length("word") - n + 1, n)):
        pieces = wanted.select("word", F.explode(F.transform(letters, end)).alias("part"))
        wanted = pieces.join(lex.select(F.col("word").alias("part")), "part", "left_semi").select("word").distinct()
    wanted = materialize(wanted, "candidates")
    starts = wanted.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - GROUP)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(GROUP), F.greatest(F.lit(GROUP), F.least(F.lit(most), F.length("word") - F.col("start"))))).alias("letters"))
    pieces = spans.where(F.col("start") + F.col("letters") <= F.length("word")).select("*", F.substring("word", F.col("start") + 1, F.col("letters")).alias("part"))
    known = pieces.join(lex.select(F.col("word").alias("part"), "weight"), "part").groupBy("word").agg(F.collect_list(F.struct("start", "letters", "weight")).alias("parts"))
    cut = known.join(boundary_scores(wanted, position_model(lex)), "word").select("word", _best_cuts(F.length("word"), "scores", "parts").alias("c"))
    return cut.where(F.col("c.cuts").isNotNull()).select("word", "c.weight", "c.cuts")
