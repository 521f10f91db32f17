"""Streaming counterparts of the batch layer.

Delivery is at least once; the effect is exactly once, as every sink writes a
batch under its id (a repeated batch replaces itself) and rows have versions of
which the newest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textloom.functions.core import latest
from textloom.operators.harmonise import ADAPTERS, document_id, split_rejects

RAW = "source string, source_type string, object_key string, title string, raw_text string, raw_html string, url string, timestamp timestamp, language string, event_at timestamp"


def raw_stream(spark: SparkSession, path: str, files: int = 100, schema: str = RAW) -> DataFrame:
    """Raw objects as they arrive; the number of files a batch bounds the backlog in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch under its own partition, replacing an earlier attempt."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def harmonised(docs: DataFrame) -> DataFrame:
    """Each document through the adapter of its type; unknown types stay without a cleaned text."""
    typed = docs.withColumn("source_type", F.coalesce("source_type", F.lit("legacy")))
    parts = [f(typed.where(F.col("source_type") == t)).select(*typed.columns, "cleaned_text", "word_count") for t, f in ADAPTERS.items()]
    rest = typed.where(~F.col("source_type").isin(*ADAPTERS)).withColumns({"cleaned_text": F.lit(None).cast("string"), "word_count": F.lit(None).cast("int")})
    out = rest
    for p in parts:
        out = out.unionByName(p)
    return out.withColumn("article_id", document_id(F.col("source"), F.col("object_key"))).withColumn("version", F.unix_micros("event_at"))


def ingest(spark: SparkSession, raw: str, silver: str, rejects: str, checkpoint: str, allowed: DataFrame | None = None) -> StreamingQuery:
    """Raw objects to the clean layer and the rejects, all that is there, then stop."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = harmonised(batch)
        kept, put_aside = split_rejects(batch, allowed)
        write_batch(latest(kept, ["article_id"], "version"), silver, batch_id)
        write_batch(put_aside, rejects, batch_id)

    return raw_stream(spark, raw).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour", time: str = "timestamp") -> DataFrame:
    """The first row of each key within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rolling(stream: DataFrame, width: str = "1 hour", delay: str = "365 days", time: str = "timestamp") -> DataFrame:
    """(bucket, source, metric_name, sum, count) of a stream of metric rows; late rows correct their bucket until the delay has passed."""
    at = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "source", "metric_name").agg(F.sum("value").alias("sum"), F.count("value").alias("count"))
    return at.select(F.col("w.start").alias("bucket"), "source", "metric_name", "sum", "count")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", time: str = "timestamp", key: str = "article_id") -> DataFrame:
    """Sessions of each key; an extension beyond tumbling buckets."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def upsert(spark: SparkSession, state: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the newest version of each key under ``state``, one folder a batch, and a pointer by name."""
    def each(batch: DataFrame, batch_id: int) -> None:
        here = f"{state}/v={batch_id}"
        before = [f"{state}/v={k}" for k in range(batch_id - 1, -1, -1)]
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        old = next((p for p in before if (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)), None)
        rows = batch if old is None else spark.read.parquet(old).unionByName(batch)
        latest(rows, keys, version).write.mode("overwrite").parquet(here)

    return each


def claims(state: DataFrame, arrived: DataFrame, now: str, stale_seconds: int = 900, most: int = 5) -> DataFrame:
    """What a worker does with each arrived object: process, skip (done or held), reclaim (stale), quarantine (too many attempts).

    state: object_key, status (pending, processing, processed, quarantined), claimed_at, attempts.
    """
    old = F.lit(now).cast("timestamp_ntz") - F.make_interval(secs=F.lit(stale_seconds))
    s = arrived.join(state, "object_key", "left")
    action = F.when(F.col("status").isin("processed", "quarantined"), "skip").when(F.coalesce("attempts", F.lit(0)) >= most, "quarantine").when((F.col("status") == "processing") & (F.col("claimed_at") < old), "reclaim").when(F.col("status") == "processing", "skip").otherwise("process")
    return s.select("object_key", action.alias("action"))


def backlog(state: DataFrame, limit: int = 1000) -> DataFrame:
    """Objects that wait or were put aside, and whether the backlog is over its limit."""
    out = state.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "quarantined").alias("quarantined"))
    return out.withColumn("alert", F.col("pending") > limit)


class Lag(StreamingQueryListener):
    """Rows and seconds of the last batch of every query, and what ended it."""

    def __init__(self) -> None:
        self.last: dict[str, tuple[int, float]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = (0, 0.0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.last[str(p.id)] = (p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception


def attempts(outcomes: DataFrame, most: int = 5) -> DataFrame:
    """Objects by attempts: retry while under the bound, then quarantine; what was processed never changes. outcomes: object_key, ok."""
    out = outcomes.groupBy("object_key").agg(F.count_if(~F.col("ok")).alias("failures"), F.max("ok").alias("processed"))
    return out.withColumn("status", F.when(F.col("processed"), "processed").when(F.col("failures") >= most, "quarantined").otherwise("pending"))
