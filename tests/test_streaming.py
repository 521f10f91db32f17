"""Streaming jobs give what the batch layer gives, also when a batch is repeated."""

import json

from pyspark.sql import functions as F

from textloom.sources import files
from textloom.streaming import jobs


def test_ingest(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    docs = [{"source": "s", "source_type": "rss", "object_key": f"k{i % 3}", "title": "T", "raw_text": f"<p>text {i}</p>", "timestamp": "2024-01-01T00:00:00Z", "language": "de", "event_at": f"2024-01-01T00:00:0{i}Z"} for i in range(5)]
    docs.append(docs[0] | {"source_type": "odd", "object_key": "bad"})
    (raw / "one.json").write_text("\n".join(map(json.dumps, docs)))
    out = [f"file://{tmp_path}/{x}" for x in ("raw", "silver", "rejects", "check")]
    jobs.ingest(spark, *out).awaitTermination()
    first = sorted((r.object_key, r.cleaned_text) for r in spark.read.parquet(out[1]).collect())
    assert first == [("k0", "T text 3"), ("k1", "T text 4"), ("k2", "T text 2")]
    assert [r.reject_reason for r in spark.read.parquet(out[2]).collect()] == ["unknown_source_type"]
    jobs.ingest(spark, *out).awaitTermination()  # nothing new
    assert spark.read.parquet(out[1]).count() == 3


def test_rolling_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"), "value", F.col("event_type").alias("metric_name"), F.concat(F.lit("s"), F.col("user_id") % 7).alias("source"))
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.rolling(stream).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = batch.groupBy(F.date_trunc("hour", "timestamp").alias("bucket"), "source", "metric_name").agg(F.round(F.sum("value"), 6).alias("sum"), F.count("value").alias("count"))
    got = spark.table("rolled").withColumn("sum", F.round("sum", 6))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_upsert_and_claims(spark, tmp_path):
    each = jobs.upsert(spark, f"file://{tmp_path}/state", ["k"], "v")
    one, two = (spark.createDataFrame(r, "k string, v long") for r in ([("a", 1), ("b", 5)], [("a", 2), ("b", 4)]))
    each(one, 0)
    each(two, 1)
    each(two, 1)  # a repeated delivery
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/state/v=1").collect())) == [("a", 2), ("b", 5)]
    state = spark.sql("SELECT * FROM VALUES ('a', 'processed', TIMESTAMP_NTZ '2024-01-01', 1), ('b', 'processing', TIMESTAMP_NTZ '2024-01-01', 1), ('c', 'processing', TIMESTAMP_NTZ '2024-01-02', 1), ('d', 'pending', NULL, 5) t(object_key, status, claimed_at, attempts)")
    got = jobs.claims(state, spark.createDataFrame([(x,) for x in "abcde"], "object_key string"), "2024-01-02 00:01:00")
    assert dict(map(tuple, got.collect())) == {"a": "skip", "b": "reclaim", "c": "skip", "d": "quarantine", "e": "process"}
    assert jobs.backlog(state, 0).first()[:] == (1, 0, True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y\tz', None)], "k string, t string, n string")
    files.write_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True, quote='"', escape='"').first().t == 'x "q", y\tz'
    files.write_tsv(df, f"file://{tmp_path}/tsv")
    assert spark.read.text(f"file://{tmp_path}/tsv").first()[0] == 'a\tx "q", y z\t'
    docs = spark.createDataFrame([("a1", "s", "de", "text", "raw")], "article_id string, source string, language string, cleaned_text string, raw_text string")
    files.write_envelopes(docs, f"file://{tmp_path}/env")
    got = files.read_envelope(spark, f"file://{tmp_path}/env", "a1").first()
    assert got.core.cleaned_text == "text" and "raw" not in str(got)
    (tmp_path / "o.txt").write_text("x")
    assert files.replay(spark, f"file://{tmp_path}/o.txt", "o.txt", "2024-01-01").count() == 1 and files.whole_texts(spark, f"file://{tmp_path}/o.txt").first().content == "x"


def test_cached_dimension(spark):
    now, loads = [0.0], [0]

    def load():
        loads[0] += 1
        if loads[0] == 3:
            raise OSError("gone")
        return spark.range(loads[0])

    c = files.Cached(load, 60, lambda: now[0])
    assert [c.get().count(), c.get().count()] == [1, 1]
    now[0] = 61
    assert c.get().count() == 2
    now[0] = 200
    assert c.get().count() == 2 and loads[0] == 3


def test_lag_listener(spark, tmp_path):
    lag = jobs.Lag()
    spark.streams.addListener(lag)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in/a.json").write_text('{"x": 1}')
        q = spark.readStream.schema("x int").json(f"file://{tmp_path}/in").writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
        q.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert str(q.id) in lag.last
    finally:
        spark.streams.removeListener(lag)


def test_claims_go_on_and_stale_ones_are_reclaimed(spark, tmp_path):
    """State outlives the query; a worker that fell silent loses its claim when time has passed."""
    import datetime as dt

    from textloom.streaming import claims

    spark.conf.set(*next(iter(claims.STORE.items())))
    zero = dt.datetime(2024, 1, 1)
    schema = "object_key string, kind string, at timestamp"
    parts = [
        [("a", "arrived", 0), ("a", "arrived", 10), ("b", "arrived", 0), ("b", "done", 5), ("c", "arrived", 1), (None, "arrived", 1), ("a", "odd", 1), ("a", None, 2)],
        [("a", "arrived", 20), ("b", "arrived", 21), ("d", "arrived", 2000)],
        [("e", "arrived", 4000), ("c", "done", 4000)],
    ]
    for rows in parts:
        made = spark.createDataFrame([(k, kind, zero + dt.timedelta(seconds=s)) for k, kind, s in rows], schema)
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = claims.claimed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), delay="60 seconds")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    start = int(zero.replace(tzinfo=dt.UTC).timestamp())
    got = [(r.object_key, r.action, r.at_ms // 1000 - start, r.attempts) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(x for x in got if x[1] == "process") == [("a", "process", 0, 1), ("b", "process", 0, 1), ("c", "process", 1, 1), ("d", "process", 2000, 1), ("e", "process", 4000, 1)]
    assert sorted(x for x in got if x[1] == "skip") == [("a", "skip", 10, 1), ("a", "skip", 20, 1), ("b", "skip", 21, 1)]
    reclaimed = {x for x in got if x[1] == "reclaim"}
    assert ("a", "reclaim", 900, 2) in reclaimed and {x[0] for x in reclaimed} <= {"a", "c", "d"} and not any(x[1] == "quarantine" and x[0] == "b" for x in got)
    quiet = [x for x in got if x[0] == "a" and x[1] != "skip"]
    assert [x[3] for x in sorted(quiet, key=lambda x: x[2])] == list(range(1, len(quiet) + 1))


def test_buckets_rewrite_what_a_batch_touches(spark, tmp_path):
    from textloom.streaming import buckets

    rows = spark.range(2000).selectExpr("concat('k', id) AS k", "id AS n", "1L AS v").unionByName(spark.createDataFrame([(None, 7, 1)], "k string, n long, v long"))
    table = buckets.BucketTable(spark, f"file://{tmp_path}/t", rows.schema, ["k"], "v", 100)
    assert table.apply(rows, 0) == 100 and table.rows().count() == 2001
    few = spark.createDataFrame([("k5", 50, 2), ("k5", 49, 1), ("k6", 60, 0), (None, 8, 2), ("new", 1, 1)], "k string, n long, v long")
    seen = []
    written = table.apply(few, 1, lambda changes: seen.extend((r.new.k, r.new.n, r.old and r.old.n) for r in changes.collect()))
    assert written <= 4 and sorted(seen, key=repr) == sorted([("k5", 50, 5), (None, 8, 7), ("new", 1, None)], key=repr)
    assert table.apply(few, 1) == 0  # the same batch again
    got = {r.k: r.n for r in table.rows().collect()}
    assert len(got) == 2002 and (got["k5"], got["k6"], got[None], got["new"], got["k7"]) == (50, 6, 8, 1, 7)
    # a batch that failed before its commit leaves the table as it was, and may come again
    def fails(changes):
        raise RuntimeError("stopped")

    try:
        table.apply(few.limit(1).selectExpr("k", "n + 1000 AS n", "9L AS v"), 2, fails)
    except RuntimeError:
        pass
    assert table.manifests() == [0, 1] and {r.k: r.n for r in table.rows().collect()} == got
    for k in range(2, 6):
        table.apply(spark.createDataFrame([("k5", k, 10 + k)], "k string, n long, v long"), k)
    folders = sorted(p.parent.name for p in (tmp_path / "t/data").glob("*/_bucket=*"))
    assert {r.k: r.n for r in table.rows().collect()}["k5"] == 5 and table.manifests() == [4, 5]
    assert len(folders) == len(set(table.manifest().items()) | set(table.manifest(4).items()))  # nothing older is left


def test_sqlite_index(spark, tmp_path):
    from textloom.sources import sqlite_index

    path, schema = f"file://{tmp_path}/index", "alias string, n long, ok boolean, x double"
    rows = [("a", 1, True, 0.5), ("b", None, False, None), (None, 3, None, 1.0), ('q"t', 4, True, 2.0), ("a", 1, True, 0.5)]
    sqlite_index.write_index(spark.createDataFrame(rows, schema).repartition(3), path, metadata={"language": "de"})
    read = lambda: sorted(map(tuple, sqlite_index.read_index(spark, path, schema).collect()), key=repr)
    assert read() == sorted(rows, key=repr)
    about = sqlite_index.read_metadata(path)
    assert (about["rows"], about["key"], about["language"]) == ("5", "alias", "de") and sqlite_index.lookup(path, "a") == [("a", 1, 1, 0.5)] * 2
    # a task that fails aborts the job: what was there stays, nothing else does
    before = sorted(p.name for p in (tmp_path / "index").iterdir())
    broken = spark.range(40).repartition(4).selectExpr("cast(id as string) AS alias", "id AS n", "id > 1 AS ok", "if(id = 7, cast(raise_error('stopped') as double), 1.0D) AS x")
    try:
        sqlite_index.write_index(broken, path)
        raise AssertionError("the job should have failed")
    except Exception as e:
        assert "stopped" in str(e)
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == before and read() == sorted(rows, key=repr)
    sqlite_index.write_index(spark.createDataFrame(rows[:1], schema), path, mode="append")
    assert len(read()) == 6 and sqlite_index.read_metadata(path)["rows"] == "6"
    sqlite_index.write_index(spark.createDataFrame([], schema), path)
    assert read() == [] and [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("_staging")] == []
    try:
        sqlite_index.SqliteWriter(spark.createDataFrame([], "a array<int>").schema, {"path": path}, True)
        raise AssertionError("arrays are no index columns")
    except ValueError as e:
        assert "'a'" in str(e)
