"""Readers and sinks of the formats that documents, indexes and exports come in."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file, with the file as its key."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("object_key", F.input_file_name())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files such as sitemaps, feeds and pages."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, compressed ones too; bz2 is split among tasks."""
    return spark.read.text(path)


def envelopes(docs: DataFrame) -> DataFrame:
    """Clean documents as nested envelopes (core, meta, provenance), without the raw text."""
    core = [c for c in ("article_id", "source", "timestamp", "language", "cleaned_text", "word_count") if c in docs.columns]
    meta = [c for c in docs.columns if c not in (*core, "raw_text", "raw_html", "provenance")]
    return docs.select(F.struct(*core).alias("core"), F.struct(*meta or [F.lit(None).cast("string").alias("none")]).alias("meta"), *(["provenance"] if "provenance" in docs.columns else []))


def write_envelopes(docs: DataFrame, path: str) -> None:
    """Envelopes by source; sources that docs do not have keep theirs."""
    envelopes(docs).withColumn("source", F.col("core.source")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_envelope(spark: SparkSession, path: str, article_id: str) -> DataFrame:
    """One envelope by key."""
    return spark.read.parquet(path).where(F.col("core.article_id") == article_id)


def projection(docs: DataFrame) -> DataFrame:
    """One row of measures for each clean document."""
    return docs.select("timestamp", "source", "article_id", "language", F.length("cleaned_text").alias("cleaned_text_length"), "word_count")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated values, tabs and line ends in texts made blanks."""
    clean = df.select(*[F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").csv(path, sep="\t", header=False, quote="", emptyValue="", nullValue="")


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated values as RFC 4180 quotes them, with a header."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def replay(spark: SparkSession, path: str, prefix: str, event_at: str) -> DataFrame:
    """Stored objects under a prefix as new events."""
    names = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("stored_at"))
    return names.where(F.col("path").contains(prefix)).select(F.col("path").alias("object_key"), "stored_at", F.lit(event_at).cast("timestamp").alias("event_at"))


class Cached:
    """A small dimension that is reloaded after its lifetime; if that fails the old rows stay in use."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.rows: DataFrame | None = None
        self.at = 0.0

    def get(self) -> DataFrame:
        if self.rows is None or self.clock() - self.at > self.seconds:
            try:
                fresh = self.load().cache()
                fresh.count()
            except Exception:
                if self.rows is None:
                    raise
            else:
                if self.rows is not None:
                    self.rows.unpersist()
                self.rows, self.at = fresh, self.clock()
        return self.rows
