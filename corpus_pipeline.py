"""Corpus pipeline: quality, near duplicates, repeated strings, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, neardup, repeats, rules
from textloom.llm.common import materialize
from textloom.llm.queries import fold, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble does not reject (score below 0.3)."""
    model = rules.fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return rules.quality_scores(row, model).where(F.col("score") >= 0.3).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur twice; n_chars, where there is one, follows the text."""
    out = repeats.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    seen = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return seen.where(~F.col("contaminated")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot in a mix of tempered source weights."""
    return mixing.interleave(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("benchmark_passages", drop_benchmark),
    ("source_mix", mix_sources),
]

#: SQL cannot express the fitted rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
