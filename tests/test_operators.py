"""Goldens and edge cases of the analytical operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import core
from textloom.operators import catalogue, crawl, distribution, extract, harmonise, metadata, network, revisions, timeseries
from textloom.plans import gates

AT = dt.datetime(2024, 1, 1, 10, 0)


def metric_rows(spark, rows):
    """rows: (minutes after AT, value, source, metric, article)."""
    return spark.createDataFrame([(AT + dt.timedelta(minutes=m), float(v), s, n, a, i) for i, (m, v, s, n, a) in enumerate(rows)], "timestamp timestamp_ntz, value double, source string, metric_name string, article_id string, version long")


def languages(spark, rows):
    return spark.createDataFrame([(a, lang, r) for a, lang, r in rows], "article_id string, detected_language string, rank int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_zscore_golden(spark):
    m = metric_rows(spark, [(0, 180, "s", "w", "a")])
    base = spark.createDataFrame([("w", "s", "de", 150.0, 30.0), ("x", "s", "de", 1.0, 0.0)], "metric_name string, source string, language string, baseline_value double, baseline_std double")
    z = timeseries.zscore_series(m, languages(spark, [("a", "de", 1), ("a", "en", 2)]), base, "hourly")
    assert [r.value for r in z.collect()] == [1.0]
    assert timeseries.zscore_series(m, languages(spark, []), base).count() == 0
    assert rows(timeseries.excluded_count(m, languages(spark, []))) == [(1,)]
    assert timeseries.zscore_series(m.withColumn("metric_name", F.lit("x")), languages(spark, [("a", "de", 1)]), base).count() == 0


def test_percentile_golden(spark):
    m = metric_rows(spark, [(k, k + 1, "s", "w", str(k)) for k in range(5)] + [(9, 9, "s", "w", "none")])
    lang = languages(spark, [(str(k), "de", 1) for k in range(5)])
    assert [(r.value, r["count"]) for r in timeseries.percentile_series(m, lang, "hourly").collect()] == [(0.5, 5)]


def test_weekly_from_daily_rollup(spark):
    m = metric_rows(spark, [(0, 4, "s", "w", "a"), (5, 6, "s", "w", "b"), (1440, 4, "s", "w", "c"), (1441, 6, "s", "w", "d")])
    daily = timeseries.rollup(m, "daily")
    assert [(r.value, r["count"]) for r in timeseries.from_rollup(daily, "weekly").collect()] == [(5.0, 4)]
    assert rows(timeseries.routed("weekly", m, {"daily": daily}).select("bucket")) == [(dt.datetime(2023, 12, 31),)]
    shown, more = timeseries.capped(timeseries.series(m, "5min"), "5min", 2)
    assert more and shown.count() == 2


def test_scope_and_buckets(spark):
    m = metric_rows(spark, [(0, 1, "s", "w", "a"), (60, 1, "t", "w", "a")])
    assert core.in_scope(m, ["s"]).count() == 1
    assert core.in_scope(m, start="2024-01-01 10:00:00", end="2024-01-01 11:00:00").count() == 1
    assert core.in_scope(m, start="2024-01-01 10:00:00", end="2024-01-01 11:00:00", closed=True).count() == 2
    with pytest.raises(ValueError, match="after start"):
        core.in_scope(m, start="2024", end="2023")
    with pytest.raises(ValueError, match="resolution"):
        core.bucket("timestamp", "yearly")
    with pytest.raises(ValueError, match="empty"):
        core.in_scope(m, [])


def test_distribution_goldens(spark):
    v = metric_rows(spark, [(k, k, "s", "w", "a") for k in range(1, 11)])
    h = distribution.histogram(v, "value", 5)
    assert h.agg(F.sum("count"), F.count("*")).first()[:] == (10, 5)
    one = distribution.histogram(v.withColumn("value", F.lit(3.0)), "value", 5).collect()
    assert [(r.lower, r.upper, r["count"]) for r in one] == [(3.0, 3.0, 10)]
    assert distribution.summary(v.limit(0), "value").first()[:] == (0, 0, 0, 0, 0, 0, 0, 0, 0)
    wild = metric_rows(spark, [(k, k % 5, "s", "w", "a") for k in range(40)] + [(1, 500, "s", "w", "a")])
    assert {r.overflow for r in distribution.histogram(wild, "value", 4).collect()} == {1}
    assert distribution.clamp_bins(0) == 1 and distribution.clamp_bins(999) == 200


def test_correlation_and_lag(spark):
    rows_ = [(5 * k, k * k, "s", "a", "x") for k in range(6)] + [(5 * k, 2 * k * k, "s", "b", "x") for k in range(6)] + [(5 * k, 7, "s", "c", "x") for k in range(6)]
    r = {(x.a, x.b): x.r for x in distribution.correlation_matrix(metric_rows(spark, rows_), ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "c"] is None
    shape = [3, 9, 1, 7, 2, 8, 4, 6, 5, 0, 11, 10]
    x = spark.createDataFrame([(AT + dt.timedelta(hours=k), float(v)) for k, v in enumerate(shape)], "bucket timestamp_ntz, value double")
    y = spark.createDataFrame([(AT + dt.timedelta(hours=k + 2), float(v)) for k, v in enumerate(shape)], "bucket timestamp_ntz, value double")
    lags = distribution.lead_lag(x, y, 6)
    assert lags.count() == 13 and distribution.peak_lag(lags).first()[0] == 2


def test_parallel_and_scatter(spark):
    m = metric_rows(spark, [(0, 100, "s", "w", "a1"), (0, 0.5, "s", "p", "a1"), (0, 4, "s", "q", "a1"), (0, 1, "s", "w", "a2"), (0, 1, "s", "p", "a2")])
    assert rows(distribution.parallel_coordinates(m, ["w", "p", "q"])) == [("a1", 100.0, 0.5, 4.0)]
    assert distribution.scatter(m, "w", "q").count() == 1


def facts(spark):
    data = [("a", ["Politik"]), ("b", ["Politik"]), ("c", ["Politik", "Kultur"]), ("d", ["Politik"]), ("e", ["Wirtschaft"]), ("f", ["Wirtschaft"]), ("g", ["Sport"])]
    return spark.createDataFrame([(a, "s", "section", v, AT) for a, v in data], "article_id string, source string, field string, value array<string>, timestamp timestamp_ntz")


def test_metadata_goldens(spark):
    top = metadata.categorical(facts(spark), "section", 2).orderBy(F.desc("articles")).collect()
    assert [(r.value, r.articles, r.total_articles, r.distinct_values, r.other_value_articles) for r in top] == [("Politik", 4, 7, 4, 2), ("Wirtschaft", 2, 7, 4, 2)]
    m = metric_rows(spark, [(0, 0.2, "s", "x", "a"), (0, 0.4, "s", "x", "b"), (0, -0.6, "s", "x", "g")])
    tab = {r.value: (r.articles, round(r["mean"], 6), r["std"]) for r in metadata.cross_tab(facts(spark), m, "section", "x").collect()}
    assert tab["Sport"] == (1, -0.6, 0.0) and tab["Politik"][:2] == (2, 0.3)
    cells = spark.createDataFrame([("s", "author", "null", 60), ("t", "author", "json_ld", 200), ("u", "author", "null", 30)], "source string, field string, method string, articles long")
    assert {r.source: r.structurally_absent for r in metadata.coverage(cells).collect()} == {"s": True, "t": False, "u": False}
    low = metric_rows(spark, [(0, 99, "s", "image_count", str(k)) for k in range(3)] + [(0, 1, "s", "image_count", "z")] + [(0, k, "s", "word_count", str(k)) for k in range(4)])
    got = {r.metric_name: r for r in metadata.available_metrics(low, 1).collect()}
    assert got["image_count"]["class"] == "low_signal" and got["image_count"].distinct_values == 2 and got["word_count"]["class"] == "usable"
    seen = spark.createDataFrame([("a", "s", AT, {"title": "og", "author": "magic"})], "article_id string, source string, seen_at timestamp_ntz, methods map<string,string>")
    assert {r.field: r.method for r in metadata.coverage_rows(seen, ["title", "author", "tags"], ["og", "json_ld"]).collect()} == {"title": "og", "author": "null", "tags": "null"}


def test_network_goldens(spark):
    e = spark.createDataFrame([("a", "s", AT, t, "X") for t in ("Merkel", "Berlin", "SPD", "Merkel")], "article_id string, source string, timestamp timestamp_ntz, entity_text string, entity_label string")
    p = network.pairs(e)
    assert sorted((r.a_text, r.b_text, r.weight) for r in p.collect()) == [("Berlin", "Merkel", 1), ("Berlin", "SPD", 1), ("Merkel", "SPD", 1)]
    c = spark.createDataFrame([("Berlin", "Merkel", 5, "a1", "s"), ("Berlin", "Scholz", 1, "a2", "s"), ("Paris", "Macron", 1, "a3", "t")], "a_text string, b_text string, weight long, article_id string, source string")
    nodes, shown = network.node_first(c, 2, 10)
    assert [tuple(r)[0] for r in nodes.collect()] == ["Berlin", "Merkel"] and shown.count() == 1 and nodes.first().total == 6
    assert network.edge_first(c).count() == 3 and network.gap_articles(e, p).count() == 0
    assert network.scope_union({"x": ["a", "b"], "y": ["b"]}, {"a": "de", "b": "de"}) == ["a", "b"]
    with pytest.raises(PermissionError):
        network.scope_union({"x": ["a", "b"]}, {"a": "de", "b": "en"})


def test_revision_chain(spark):
    snaps = [("a", "s", AT + dt.timedelta(hours=h), c, t) for h, c, t in [(0, "h1", "sweep"), (2, "h2", "sweep"), (5, "h1", "republication"), (9, "h3", "sweep")]]
    out = revisions.chain(spark.createDataFrame(snaps, "article_id string, source string, snapshot_at timestamp_ntz, content_hash string, revision_trigger string")).orderBy("revision_index").collect()
    assert [(r.content_hash, r.prev_content_hash, r.time_since_prev_hours) for r in out] == [("h2", "", 0.0), ("h1", "h2", 3.0), ("h3", "h1", 4.0)]
    many = spark.createDataFrame([("b", "s", AT + dt.timedelta(hours=h), f"h{h}", "sweep") for h in range(30)], "article_id string, source string, snapshot_at timestamp_ntz, content_hash string, revision_trigger string")
    assert revisions.chain(many).agg(F.count("*"), F.max("revision_index")).first()[:] == (20, 19)


def test_paragraph_diff():
    ops = revisions.paragraph_ops("one two three\nsame\ngone", "one two four\nsame\nnew words here")
    assert len(ops) == 3 and '"mod"' in ops[0] and '"del"' in ops[1] and '"add"' in ops[2]
    assert revisions.paragraph_ops("a", "a") == ['{"op": "identical"}'] and revisions.paragraph_ops("a", "a", True) == [] and len(revisions.paragraph_ops(None, "x")) == 1


def test_discourse_delta_and_headline(spark):
    df = spark.createDataFrame([(0.1, 0.35, ["a", "b"], ["b", "c"], [1.0, 0.0], [0.0, 1.0], '<meta content="O &amp; x" property="og:title"><h1>H <b>1</b></h1>')], "s1 double, s2 double, e1 array<string>, e2 array<string>, v1 array<double>, v2 array<double>, html string")
    r = df.select(*revisions.discourse_delta(*[F.col(c) for c in ("s1", "s2", "e1", "e2", "v1", "v2")]), revisions.headline(F.col("html")).alias("h")).first()
    assert (r.sentiment_delta, r.entities_added, r.entities_removed, r.topic_shift_score, r.deltas_computed, r.h) == (0.25, ["c"], ["a"], 1.0, True, "O &amp; x")


def test_lexicon_and_languages(spark):
    lex = extract.lexicon(spark.createDataFrame([("Gut", 0.4, "gute,guter")], "word string, weight double, inflections string"), spark.createDataFrame([("guter", 1.0)], "word string, weight double"))
    assert {r.word: r.weight for r in lex.collect()} == {"gut": 0.4, "gute": 0.4, "guter": 1.0}
    docs = spark.createDataFrame([("a", "Gut, guter Tag!"), ("b", "nothing")], "article_id string, text string")
    assert rows(extract.lexicon_sentiment(docs, lex)) == [("a", 0.7)] and len(extract.lexicon_hash(lex).first()[0]) == 16
    assert extract.detect("the cat is on the mat and it is fat")[0][0] == "en" and extract.detect("der Hund ist nicht in dem Haus und")[0][0] == "de" and extract.detect("hi") == []
    bad = extract.isolated(docs, {"ok": lambda t: float(len(t)), "fails": lambda t: 1 / 0}).collect()
    assert all(r.ok.error is None and r.fails.value is None and "ZeroDivisionError" in r.fails.error for r in bad)


def test_whole_tables(spark, tmp_path):
    """No key, page or count is left out: keys of 200 and more, titles with entities, every source's lines."""
    from textloom import layers

    at = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    at("events", [(1, 250, "click", AT, 1.0)], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
    at("pages", [(k, f"u{k}", f"<title>a &amp; b &lt;{k}&gt;</title>") for k in (0, 4)], "page_id long, url string, html string")
    at("supplier", [(k, f"s{k}") for k in (1, 3)], "s_suppkey long, s_name string")
    at("orders", [(1, "p", AT)], "o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz")
    at("lineitem", [(1,), (1,), (3,)], "l_suppkey long")
    claims = {r.object_key: r.action for r in layers.m3_claims(spark, str(tmp_path)).collect()}
    assert len(claims) == 201 and claims["k250"] == "skip" and claims["k0"] == "process"
    assert sorted(rows(layers.c13_custom_fields(spark, str(tmp_path)))) == [(0, "a & b <0>"), (4, "a & b <4>")]
    assert {r.id: r.total for r in layers.h42_dossier_sources(spark, str(tmp_path)).collect()} == {1: 2, 3: 1}
    assert {r.page_id: (r.url, r.status) for r in layers.a16_point_reads(spark, str(tmp_path), [4, 5]).collect()} == {4: ("u4", "found"), 5: (None, "not_found")}


def test_second_detector(spark):
    short, long = "the cat is on the mat", "the cat is on the mat and it is fat " * 4
    docs = spark.createDataFrame([("s", short), ("l", long), ("n", "xyzzy plugh xyzzy"), ("t", "hi")], "article_id string, text string")
    ranked = lambda second: {i: [r.detected_language for r in sorted(extract.detections(docs, second).collect(), key=lambda r: r.rank) if r.article_id == i] for i in "slnt"}
    assert ranked(None) == {"s": ["en"], "l": ["en"], "n": ["und"], "t": []}
    assert ranked(lambda t: ("de", 0.9)) == {"s": ["de", "en", "de"], "l": ["en", "en", "de"], "n": ["de", "de"], "t": []}
    assert ranked(lambda t: ("en", 0.9))["s"] == ["en", "en", "en"] and ranked(lambda t: None)["n"] == ["und"]


def test_folded_links(spark):
    index = spark.createDataFrame([("orleans", "Q1", "label", 5), ("orléans", "Q2", "altLabel", 9), ("lyon", "Q3", "label", 1)], "alias string, qid string, source string, sitelinks int")
    texts = spark.createDataFrame([("Lyôn",), ("Orléans",), ("Órleans",), ("none",)], "entity_text string")
    got = {r.entity_text: (r.wikidata_qid, r.link_confidence, r.link_method) for r in extract.entity_links(texts, index, fold=True).collect()}
    assert got == {"Lyôn": ("Q3", 0.7, "accent_fold"), "Orléans": ("Q2", 0.85, "altLabel"), "Órleans": ("Q2", 0.7, "accent_fold")}
    assert [r.entity_text for r in extract.entity_links(texts, index).collect()] == ["Orléans"]


def test_open_pairs(spark):
    rev = [("a", 4, 1, "u4", "cdx_snapshot"), ("a", 5, 2, "u5", "cdx_snapshot"), ("a", 6, 3, "", "cdx_snapshot"), ("b", 0, 9, "v0", "cdx_snapshot"), ("c", 0, 9, "w0", "sweep")]
    rev = spark.createDataFrame(rev, "article_id string, revision_index int, snapshot_at int, archive_url string, revision_trigger string")
    docs = spark.createDataFrame([("a", "en", 1), ("a", "de", 2)], "article_id string, language string, version int")
    pairs = lambda n: [(r.kind, r.article_id, r.revision_index, r.prev_archive_url, r.compare_archive_url, r.language) for r in revisions.open_pairs(rev, docs, F.lit(False), n).collect()]
    want = [("mid_chain", "a", 5, "u4", None, "de"), ("chain_head", "b", 0, "", "v0", None), ("chain_head", "a", 4, "", "u5", "de")]
    assert pairs(9) == want and pairs(2) == want[:2]


def test_topics_within_a_language(spark):
    """A small language keeps topics of its own beside a large one; odd documents are outliers."""
    both = {"de": ("hund katze maus", "zug bahn gleis"), "en": ("dog cat mouse", "train rail track")}
    docs = [(f"{lang}{k}", lang, both[lang][k % 2] + f" {lang}") for lang, n in (("en", 400), ("de", 24)) for k in range(n)]
    docs += [("blank", "de", " "), ("null", "de", None), ("none", None, "a b"), ("und", "und", "a b"), ("few", "fr", "un deux")]
    out = {r.article_id: r for r in extract.topics(spark.createDataFrame(docs, "article_id string, language string, text string"), k=2).collect()}
    assert set(out) == {d[0] for d in docs} - {"none", "und", "few"}
    for lang, n in (("en", 400), ("de", 24)):
        got = [{out[f"{lang}{k}"].topic_id for k in range(n) if k % 2 == side} for side in (0, 1)]
        assert len(got[0]) == len(got[1]) == 1 and got[0] | got[1] == {0, 1}
        for side in (0, 1):
            r = out[f"{lang}{side}"]
            assert r.topic_label == "_".join([str(r.topic_id), *sorted(both[lang][side].split()), lang]) and r.topic_confidence == 1.0
    assert {(out[i].topic_id, out[i].topic_label, out[i].topic_confidence) for i in ("blank", "null")} == {(-1, "outlier", 0.0)}
    assert len({out[i].model_hash for i in ("en0", "en1", "de0")}) == 2


def test_topics_read_texts_once(spark, monkeypatch):
    """However many languages, texts are split and hashed in one table, which goes when the topics are written."""
    from pyspark.ml.feature import HashingTF

    made, real = [], HashingTF.transform
    monkeypatch.setattr(HashingTF, "transform", lambda self, df, *more: made.append(df.columns) or real(self, df, *more))
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    docs = [(f"{lang}{k}", lang, f"{lang} {'ab' if k % 2 else 'cd'}") for lang in ("de", "en", "fr") for k in range(20)]
    out = extract.topics(spark.createDataFrame(docs, "article_id string, language string, text string"), k=2).collect()
    assert len(out) == 60 and len({(r.language, r.topic_id) for r in out}) == 6 and len(made) == 1
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_alias_linking(spark):
    labels = spark.createDataFrame([("Q1", "Berlin!", "label", 5), ("Q2", "berlin", "altLabel", 99), ("Q3", "É", "label", 1)], "qid string, text string, source string, sitelinks int")
    index = extract.alias_index(labels)
    got = extract.entity_links(spark.createDataFrame([("BERLIN",), ("none",)], "entity_text string"), index).collect()
    assert [(r.entity_text, r.wikidata_qid, r.link_confidence) for r in got] == [("BERLIN", "Q1", 1.0)]
    assert "e" in {r.folded for r in extract.folded_index(index).collect()}
    t = spark.createDataFrame([("s1", "P31", "Q5"), ("s1", "sitelinks", "30"), ("s2", "P31", "Q5"), ("s2", "sitelinks", "1")], "subject string, predicate string, object string")
    assert [r.subject for r in extract.subjects(t, {"people": lambda: F.array_contains("p31", "Q5") & (F.col("sitelinks") >= 10)}).collect()] == ["s1"]


def test_harmonise(spark):
    raw = spark.createDataFrame([("s", "rss", "k1", "T", "<p>A &amp; b</p> c", "de", AT), ("s", "odd", "k2", "T", "x", "de", AT), ("s", "legacy", "k3", "T", "  ", "de", AT), ("s", None, "k4", "T", "x  y", "xx", AT)], "source string, source_type string, object_key string, title string, raw_text string, language string, timestamp timestamp_ntz")
    from textloom.streaming.jobs import harmonised

    full = harmonised(raw.withColumns({"raw_html": F.lit(None).cast("string"), "url": F.lit(""), "event_at": F.col("timestamp").cast("timestamp")}))
    kept, out = harmonise.split_rejects(full, spark.createDataFrame([("s", ["de"])], "source string, languages array<string>"))
    assert [(r.object_key, r.cleaned_text, r.word_count) for r in kept.collect()] == [("k1", "T A & b c", 5)]
    assert {r.object_key: r.reject_reason for r in out.collect()} == {"k2": "unknown_source_type", "k3": "silver_validation_failed", "k4": "language_scope_violation"}
    assert len(kept.first().article_id) == 64


def test_fields(spark):
    html = '<title>T</title><script type="application/ld+json">{"headline": "H", "datePublished": "2024-01-02", "isAccessibleForFree": "False", "timeRequired": "PT1H5M"}</script><meta name="author" content="N">'
    r = harmonise.resolve_fields(spark.createDataFrame([("a", html), ("b", "<h1>x</h1> on 2024-01-01 and")], "article_id string, raw_html string")).orderBy("article_id").collect()
    assert (r[0].title[:], r[0].published[:], r[0].author[:], r[0].paywall.value, r[0].reading_time.value) == (("H", "json_ld"), ("2024-01-02", "json_ld"), ("N", "meta"), "true", "65")
    assert r[1].title[:] == ("x", "h1") and r[1].published[:] == (None, "null")
    facts_ = harmonise.scalar_facts(harmonise.resolve_fields(spark.createDataFrame([("a", html)], "article_id string, raw_html string")), ["paywall", "reading_time", "comment_count"])
    assert sorted(rows(facts_)) == [("a", "paywall", 1.0), ("a", "reading_time", 65.0)]
    cat = harmonise.categorical_facts(spark.createDataFrame([("a", "x", ["y", ""]), ("b", "", [])], "article_id string, section string, tags array<string>"), ["section", "tags"])
    assert sorted(rows(cat)) == [("a", "section", ["x"]), ("a", "tags", ["y"])]


def test_addresses_and_times(spark):
    urls = spark.createDataFrame([("HTTPS://Ex.org/A/?utm_source=x&b=1#f",), ("https://ex.org/a-640x480.jpg",)], "url string")
    assert [r[0] for r in urls.select(harmonise.canonical_url(F.col("url"))).collect()] == ["https://ex.org/A/?b=1", "https://ex.org/a-640x480.jpg"]
    assert urls.select(harmonise.image_identity(F.col("url"))).collect()[1][0] == "ex.org/a.jpg"
    day = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([(day, AT, None, AT), (None, None, None, AT)], "p timestamp_ntz, s timestamp_ntz, h timestamp_ntz, f timestamp_ntz").select(harmonise.timestamp_of(*[F.col(c) for c in "pshf"]).alias("t"))
    assert [r.t.timestamp_source for r in t.collect()] == ["sitemap_time_upgrade", "fetch_at_fallback"]


def test_crawl(spark):
    xml = spark.createDataFrame([("<urlset><url><loc> https://e.org/a </loc><lastmod>2024-01-01T00:00:00Z</lastmod></url><url><loc>https://e.org/b</loc></url></urlset>",)], "content string")
    assert [r.loc for r in crawl.sitemap_entries(xml).collect()] == ["https://e.org/a", "https://e.org/b"]
    feed = spark.createDataFrame([("<rss><item><link>https://e.org/c</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></rss>",)], "content string")
    assert crawl.feed_entries(feed).first().published is not None
    nt = spark.createDataFrame([('<s> <P1> "a \\"b\\""@de .',), ("<s> <P2> <o> .",), ("<s> <P3> <o> .",)], "value string")
    assert rows(crawl.triples(nt, ["P1", "P2"])) == [("s", "P1", 'a \\"b\\"', "de"), ("s", "P2", "o", "")]
    u = spark.createDataFrame([("https://e.org/news/a",), ("https://e.org/newsroom",), ("https://e.org/news/a.pdf",)], "url string")
    assert [r[0] for r in u.select(crawl.allowed_address(F.col("url"), ["/news/"])).collect()] == [False, True, False]
    paths = {"/suche": False, "/Suche/": False, "/suche/x": False, "/suchergebnis/": True, "/link-kopieren-2205244": False, "/a/link-kopieren-1": True, "/x.PDF": False, "/x.pdf.html": True, "": True}
    at = spark.createDataFrame([(p, f"https://e.org{p}") for p in paths], "path string, url string")
    assert {r[0]: r[1] for r in at.select("path", crawl.allowed_address(F.col("url"), ["/suche/", "/link-kopieren-", "", "/"])).collect()} == paths
    assert crawl.archive_addresses("https://e.org/{yyyy}/{MM}/{dd}", "2024-01-01", "2024-01-03", spark=spark).first().url == "https://e.org/2024/01/03"
    pat = crawl.inferred_pattern(spark.createDataFrame([(f"https://e.org/x/slug-{k}00.html",) for k in range(1, 7)], "url string")).first()
    assert pat.samples == 6 and pat.pattern == r"-\d+\.html$"
    jobs = crawl.job_status(spark.createDataFrame([(1, "ok"), (1, "status_failed"), (2, "upload_failed"), (2, "ok"), (3, "upload_failed")], "job_id int, outcome string"))
    assert {r.job_id: r.status for r in jobs.collect()} == {1: "completed", 2: "completed_with_errors", 3: "failed"}


def test_completeness_golden(spark):
    ch = spark.createDataFrame([("a", 262, False), ("b", 72, False), ("c", 44, True)], "channel string, declared long, indeterminate boolean")
    r = catalogue.completeness(ch, 277).first()
    assert (r.declared, r.indeterminate, round(r.ratio, 4)) == (334, ["c"], round(277 / 334, 4))
    assert catalogue.completeness(ch.where("indeterminate"), 1).first().ratio is None


def test_gates(spark):
    base = spark.createDataFrame([("w",)], "metric_name string")
    eq = spark.createDataFrame([("w", "de", "deviation"), ("publication_hour", "de", "temporal")], "metric_name string, language string, equivalence_level string")
    assert gates.normalisation_gate("w", base, eq) == gates.Allowed()
    assert gates.normalisation_gate(None, base, eq).gate == "metric_required" and gates.normalisation_gate("v", base, eq).gate == "no_baseline"
    spoken = languages(spark, [("a", "de", 1), ("b", "en", 1)])
    assert gates.cross_frame_gate("w", spoken, eq).gate == "cross_frame" and gates.cross_frame_gate("w", spoken.limit(1), eq) == gates.Allowed()
    assert gates.lead_lag_gate(eq, ["de", "fr"]).gate == "lead_lag" and gates.lead_lag_gate(eq, ["de"]) == gates.Allowed()
    assert gates.k_anonymity_gate(3, True) == gates.Allowed() and gates.k_anonymity_gate(3, False).gate == "k_anonymity"
    src = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, name string, silver_eligible boolean")
    assert gates.eligibility_gate("1", src) == gates.Allowed() and gates.eligibility_gate("b", src).gate == "not_eligible" and gates.eligibility_gate("z", src).gate == "not_found"
    assert gates.resolve_scope({"p": ["a", "b"]}, None, ["p"], ["b", "c"])[0] == ["a", "b", "c"]
    with pytest.raises(KeyError):
        gates.resolve_scope({}, None, ["p"])
    assert gates.resolve_window(None, None, "2024") == ("1970-01-01T00:00:00", "2024") and gates.edge_cap(1) == 5


def test_quantiles_and_ranks_without_one_task(spark, monkeypatch):
    import random

    rng = random.Random(1)
    data = [(rng.choice("ab"), float(rng.choice([rng.randint(0, 5), rng.random() * 1e6, 7])), k) for k in range(500)] + [("c", 3.0, 900), ("a", None, 901), (None, 1.0, 902)]
    df = spark.createDataFrame(data, "k string, v double, i long")
    for most in (core.ONE_TASK, 10):
        monkeypatch.setattr(core, "ONE_TASK", most)
        got = {r.k: r for r in core.exact_quantiles(df.where("k IS NOT NULL"), ["k"], "v", [0.05, 0.5, 0.95]).collect()}
        for k in "abc":
            own = sorted(v for x, v, _ in data if x == k and v is not None)
            assert [got[k].p05, got[k].p50, got[k].p95] == [own[min(int(p * len(own)), len(own) - 1)] for p in (0.05, 0.5, 0.95)]
        assert core.exact_quantiles(df, [], "v", [0.5]).first()[0] == sorted(v for _, v, _ in data if v is not None)[251]
    monkeypatch.setattr(core, "ONE_TASK", 1000)
    assert core.exact_quantiles(df.limit(0), [], "v", [0.5]).first()[0] is None
    want = sorted(map(tuple, core.ranked(df, ["k"], ["v", "i"]).select("i", "r", "n").collect()))
    monkeypatch.setattr(core, "ONE_TASK", 10)
    assert sorted(map(tuple, core.ranked(df, ["k"], ["v", "i"]).select("i", "r", "n").collect())) == want


def test_gate_columns_and_cursor(spark):
    rows_ = [(9, False), (10, False), (1, True), (0, True)]
    got = spark.createDataFrame(rows_, "n long, p boolean").select("n", "p", gates.enough_articles(F.col("n"), F.col("p")).alias("ok")).collect()
    assert all(r.ok == isinstance(gates.k_anonymity_gate(r.n, r.p), gates.Allowed) for r in got)
    pages = spark.createDataFrame([(d, k) for d in (1, 1, 2, 2, 3) for k in ("a", "b")], "day int, key string").distinct()
    seen, at = [], {"day": F.lit(0), "key": F.lit("")}
    while page := core.page_after(pages, at, 2).collect():
        seen += [(r.day, r.key) for r in page]
        at = {"day": F.lit(page[-1].day), "key": F.lit(page[-1].key)}
    assert seen == sorted((r.day, r.key) for r in pages.collect())


def test_softmax_and_states(spark):
    p = spark.createDataFrame([([1000.0, 1000.0],), ([0.0],)], "v array<double>").select(core.softmax(F.col("v")).alias("p")).collect()
    assert [r.p for r in p] == [[0.5, 0.5], [1.0]]
    m = spark.sql("SELECT timestamp_ntz '2024-01-01 10:00:00' AS timestamp, 's' AS source, 'm' AS metric_name, 'a' AS article_id, 1.0D AS value UNION ALL SELECT timestamp_ntz '2024-01-02', 's', 'm', 'a', 3.0D UNION ALL SELECT timestamp_ntz '2024-01-02', 's', 'm', 'b', 2.0D")
    got = timeseries.merged_states(timeseries.distinct_states(m, "daily"), "monthly").collect()
    assert [(r.articles, r.largest) for r in got] == [(2, 3.0)]


@pytest.mark.parametrize("length", [60, 199, 200, 201, 500, 2000])
def test_long_paragraphs_are_modified_not_replaced(length):
    """From 200 letters on frequent letters must still count: seven tenths of the words are the same."""
    import random

    from tests.test_queries import similarity

    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    for _ in range(4):
        old = []
        while len(" ".join(old)) < length:
            old.append(rng.choice(words))
        new = [rng.choice(words) if rng.random() < 0.3 else w for w in old]
        a, b = " ".join(old), " ".join(new)
        if a != b:
            assert similarity(a, b) >= 0.4
            assert [json.loads(o) for o in revisions.paragraph_ops(f"same\n{a}", f"same\n{b}")] == [{"op": "mod", "before": a, "after": b}]


def test_equal_similarities_take_the_later_paragraph():
    ops = [json.loads(o) for o in revisions.paragraph_ops("abcd", "abcx\nabcy")]
    assert ops == [{"op": "mod", "before": "abcd", "after": "abcy"}, {"op": "add", "after": "abcx"}]


def ring_of_cliques(n, size):
    rows = [(f"c{c:02d}n{i}", f"c{c:02d}n{j}", 1) for c in range(n) for i in range(size) for j in range(i)]
    return rows + [(f"c{c:02d}n0", f"c{(c + 1) % n:02d}n1", 1) for c in range(n)]


@pytest.mark.parametrize("kind", ["cliques", "random", "odd", "empty"])
def test_louvain_against_plain(spark, kind):
    import random

    from tests.test_queries import plain_louvain

    rng = random.Random(3)
    made = {
        "cliques": ring_of_cliques(6, 5),
        "random": [(f"n{a}", f"n{b}", rng.randint(1, 9)) for a in range(40) for b in range(a) if rng.random() < (0.5 if a % 4 == b % 4 else 0.05)],
        "odd": [("a", "b", 2), ("c", "c", 5), (None, "d", 1), ("e", "f", 0), ("g", "h", 10**9), ("g", "i", 10**9)],
        "empty": [],
    }[kind]
    edges = spark.createDataFrame(made, "a_text string, b_text string, weight long")
    got = network.louvain(edges)
    want = plain_louvain([(a, b, w) for a, b, w in made if a and b and a != b and w > 0])
    assert sorted(map(tuple, got.collect())) == want
    if kind in ("cliques", "random"):
        assert network.modularity(edges, got) >= network.modularity(edges, network.communities(edges)) - 1e-12
    if kind == "cliques":
        assert len({r[1] for r in want}) == 6 and sum(r[3] for r in want) == 6


def test_compounds_against_all_cuts(spark):
    import random

    from tests.test_queries import plain_compound, plain_marks
    from textloom.operators import compounds

    rng = random.Random(11)
    lexicon = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))): rng.randint(-8, 8) / 8 for _ in range(60)} | {"eis": 1.0, "bahn": 0.5, "hof": -0.5, "ab": 1.0}
    words = ["".join(rng.choices(list(lexicon), k=rng.randint(1, 4))) for _ in range(200)] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(200)]
    words += ["eisbahnhof", "eisbahnhofx", "", None, "eis", "abab", "eisbahn", "eisbahn", "eis" * 30]
    got = {r["word"]: (r["weight"], r["cuts"]) for r in compounds.compounds(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(lexicon.items()), "word string, weight double")).collect()}
    known = {w: v for w, v in lexicon.items() if len(w) >= 3}
    marks = plain_marks(known)
    want = {w: c for w in set(words) - {None} - set(known) if 6 <= len(w) <= 64 and (c := plain_compound(w, known, marks))}
    assert got == want and got["eisbahnhof"] == ((1.0 + 0.5 - 0.5) / 3, [3, 7]) and len(got) > 100
    empty = spark.createDataFrame([], "word string, weight double")
    assert compounds.compounds(spark.createDataFrame([("eisbahn",)], "word string"), empty).count() == 0


def random_page(rng):
    tags, out, open_ = ["div", "p", "ul", "li", "span", "a", "b"], [], []
    for _ in range(rng.randint(5, 60)):
        kind = rng.random()
        if kind < 0.5:
            tag = rng.choice(tags)
            out.append(f'<{tag}' + (f' class="{" ".join(rng.sample(["x", "y", "xy"], rng.randint(1, 2)))}"' if rng.random() < 0.5 else "") + (f' id={rng.choice("abc")}' if rng.random() < 0.2 else "") + (f' href="/{rng.choice(["one", "two"])}"' if tag == "a" else "") + ">")
            open_.append(tag)
        elif kind < 0.75 and open_:
            out.append(f"</{open_.pop() if rng.random() < 0.8 else rng.choice(tags)}>")
        else:
            out.append(rng.choice(["one ", "two", "<br>", "<img>"]))
    return "".join(out)


def matches_upwards(nodes, i, steps):
    """Whether a node is where the steps lead, read from the last step up; every way is tried."""
    from textloom.functions import dom

    def holds(i, k):
        if not dom.fits(nodes, i, steps[k]):
            return False
        if k == 0:
            return True
        axis, parent = steps[k].axis, nodes[i].parent
        elements = [c for c in nodes[parent].children if nodes[c].tag] if parent >= 0 else []
        before = [c for c in elements if c < i]
        near = {"child": [parent], "next": before[-1:], "after": before}.get(axis)
        if near is None:
            near = []
            while parent > 0:
                near.append(parent)
                parent = nodes[parent].parent
        return any(holds(j, k - 1) for j in near if j > 0)

    return holds(i, len(steps) - 1)


def test_selectors_against_all_nodes():
    import random

    from textloom.functions import dom

    rng = random.Random(17)
    parts = ["p", "*", "li", ".x", "a.y", "#b", "div.x", "[href]", "a[href^='/o']", "[class~=xy]", "li:nth-child(2)", "span:first-child", ":last-child", "p[class$=y]", "[class*=x]"]
    found = 0
    for _ in range(400):
        nodes = dom.tree(random_page(rng))
        selector = rng.choice(parts)
        for _ in range(rng.randint(0, 3)):
            selector += rng.choice([" ", " > ", " + ", " ~ "]) + rng.choice(parts)
        paths = dom.css(selector + rng.choice(["", ", b.y"]))
        want = [i for i in range(len(nodes)) if any(matches_upwards(nodes, i, p.steps) for p in paths)]
        assert dom.select(nodes, paths) == want
        found += len(want)
        for i, n in enumerate(nodes):  # the tree itself: stretches nest, places count
            assert n.end > i and all(nodes[c].parent == i and nodes[c].end <= n.end for c in n.children)
            assert [c for c in range(i + 1, n.end) if nodes[c].parent == i] == n.children
            assert [nodes[c].place for c in n.children if nodes[c].tag] == list(range(1, n.elements + 1))
    assert found > 500


@pytest.mark.parametrize(
    ("rule", "value"),
    [
        ({"xpath": "//meta[@name='dossier']/@content"}, "D 1"), ({"xpath": "/html/body/div[2]/p"}, "c"), ({"xpath": "//div[last()]/p/text()"}, "c"), ({"xpath": "//p[2]"}, "b c"), ({"xpath": "//*[contains(@class,'live')]"}, "b c"),
        ({"xpath": "//p[starts-with(@class,'big')]/b"}, "c"), ({"css": ".live"}, "b c"), ({"css": "div > p + p b"}, "c"), ("#last", "c"), ("title", "T & t"), ({"xpath": "//a/@href"}, None), ({"xpath": "//p["}, None), ({"css": "p:hover"}, None), ({}, None), ({"css": ""}, None),
    ],
)
def test_custom_rules_golden(spark, rule, value):
    page = '<html><head><title>T &amp;\n t</title><meta name="dossier" content="D 1"></head><body><div><p>a<p class="big live">b <b>c</b></div><div id=last><p>c</p></div></body></html>'
    got = harmonise.custom_fields(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, raw_html string"), {"f": rule})
    assert sorted(rows(got.select("page_id", "f"))) == [(1, value), (2, None), (3, None)]


def long_page(body, extra=""):
    links = "".join(f'<li><a href="/{i}">a link to somewhere, else {i}</a></li>' for i in range(90))
    return f"<html><body {extra}><div class='menu'><ul>{links}</ul></div>{body}<div class='footer'>imprint, contact, and more of the same kind, over and over</div></body></html>"


def test_block_scoring_golden():
    from textloom.functions import dom

    text = "".join(f"<p>Sentence {i} of the story, with commas, and with some <a href=#>linked</a> words in it that make it long.</p>" for i in range(8))
    story = f'<div class="x1"><div class="x2">{text}</div><div class="comments"><p>{"a comment, of many words, that nobody needs here " * 5}</p></div></div>'
    shape = "itemtype='http://schema.org/Article'"
    got, method = dom.body(long_page(f"<article></article>{story.replace('<p>', '<div>').replace('</p>', '</div>')}"))
    assert method == "readability" and got.startswith("Sentence 0 of the story") and got.endswith("make it long.") and "comment" not in got and "imprint" not in got and "link to" not in got
    # the shape of an article, by address of its schema; none without it
    spans = story.replace("<p>", "<div>").replace("</p>", "</div>")
    assert dom.body(long_page(spans, shape))[1] == "readability" and dom.body(long_page(spans))[1] == "page"
    # short pages and pages with a long article are left alone
    assert dom.body(f"<article></article>{spans}")[1] == "page"
    assert dom.body(long_page(f"<article>{text}</article>")) == (dom.readable(t := dom.tree(f"<article>{text}</article>"), 0), "article") and t
    assert dom.body(long_page(f"<main>{text}</main>"))[1] == "main" and dom.body(long_page(text))[1] == "paragraphs"
    # nested articles end with the outer one; scripts and navigation are no text
    assert dom.body(f"<article>{text}<article>inner</article> tail <script>x</script><nav>n</nav></article>")[0].endswith("inner tail")
    for odd in (None, "", "<", "<p", "</p></p>", "<div>" * 3000):
        assert dom.body(odd) in (("", "page"), ("<", "page"), ("<p", "page"))


def test_automaton_against_naive_search():
    import random

    from textloom.operators import gazetteer

    rng = random.Random(23)
    for _ in range(60):
        names = {"".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))): "L" for _ in range(rng.randint(0, 30))}
        text = "".join(rng.choice("aab ") for _ in range(rng.randint(0, 80)))
        want = sorted((i, i + len(n), "L") for n in names for i in range(len(text)) if text.startswith(n, i))
        assert sorted(gazetteer.Automaton(names).finds(text)) == want


@pytest.mark.parametrize("shard", [2, 200_000])
def test_gazetteer_golden(spark, shard):
    from textloom.operators import gazetteer

    aliases = spark.createDataFrame([("New York", "LOC", 5), ("new york", "ORG", 1), ("York", "LOC", 9), ("U.S.", "LOC", 1), ("New York Times", "ORG", 3), ("!?", "PER", 1), (None, "PER", 1), ("x", None, 1)], "alias string, label string, sitelinks long")
    docs = spark.createDataFrame([("a", "In New York, the (New  York) U.S. and us; Yorkshire. NEW YORK TIMES"), ("a", "york"), ("b", None), ("c", ""), (None, "Ümit in York!")], "article_id string, text string")
    got = sorted(rows(gazetteer.gazetteer_spans(docs, aliases, shard)), key=repr)
    want = [("a", "New York", "LOC", 3, 11), ("a", "York", "LOC", 23, 27), ("a", "U.S", "LOC", 29, 32), ("a", "us", "LOC", 38, 40), ("a", "NEW YORK TIMES", "ORG", 53, 67), ("a", "york", "LOC", 0, 4), (None, "York", "LOC", 8, 12)]
    assert got == sorted(want, key=repr)
    assert gazetteer.gazetteer_spans(docs, aliases.limit(0)).count() == 0


@pytest.mark.parametrize("lane", [1, 5, 64])
def test_automaton_from_many_places(lane):
    """Reading from many places finds what one pass does, whatever lies across their bounds; symbols may be words."""
    import random

    from textloom.operators import gazetteer

    rng = random.Random(lane)
    for _ in range(100):
        names = {tuple(rng.choice(("new", " ", "york")) for _ in range(rng.randint(1, 7))): "L" for _ in range(rng.randint(0, 20))}
        text = [rng.choice(("new", "new", " ", "york", "?")) for _ in range(rng.randint(0, 90))]
        want = sorted((i, i + len(n), "L") for n in names for i in range(len(text)) if tuple(text[i : i + len(n)]) == n)
        assert sorted(gazetteer.Automaton(names).finds(text, lane)) == want


@pytest.mark.parametrize("shards", [1, 3])
def test_gazetteer_by_definition(shards, monkeypatch):
    """Odd letters, pieces of a batch and shards, against every name at every place."""
    import random

    import pyarrow as pa

    from textloom.operators import gazetteer

    monkeypatch.setattr(gazetteer, "PIECE", 60)
    rng = random.Random(shards)
    spans = 0
    for _ in range(150):
        letters = rng.choice(("ab ", "aab  .", "aabbAB  .,-\u2013\u0130\u0131\u03a3\u03c3\u03c2\u00dfE\u0301\u00e9\t\n\0\u540d\U0001f600_\u00b2\u01c5"))
        some = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        lower = lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t if c not in extract.PUNCTUATION)
        names = {n: rng.choice(("PER", "LOC")) for n in (lower(some(rng.randint(1, 7))).strip(" ") for _ in range(25)) if n}
        texts = [rng.choice((None, "", some(rng.randint(1, 60)), some(150))) for _ in range(9)]
        want = set()
        for k, t in enumerate(texts):
            at = [i for i, c in enumerate(t or "") if c not in extract.PUNCTUATION]
            form = lower(t or "")
            finds = [(at[a] - at[a + len(n) - 1], at[a], label) for n, label in names.items() for a in range(len(form)) if form.startswith(n, a) and not form[:a][-1:].isalnum() and not form[a + len(n) :][:1].isalnum()]
            taken = set()
            for length, a, label in sorted(finds):
                b = a - length + 1
                if not taken & set(range(a, b)):
                    taken |= set(range(a, b))
                    want.add((k, t[a:b], label, a, b))
        rows = iter([pa.RecordBatch.from_pydict({"article_id": pa.array(range(9), pa.int64()), "text": pa.array(texts, pa.string())})])
        for k in range(shards):
            part = [n for i, n in enumerate(names) if i % shards == k]
            automaton = gazetteer.Automaton(dict(zip(gazetteer.Words(part).each(), (names[n] for n in part), strict=True)))
            rows = gazetteer._shard(automaton, k == shards - 1)(rows)
        got = [tuple(r.values()) for batch in rows for r in batch.to_pylist()]
        assert len(got) == len(want) and set(got) == want
        spans += len(want)
    assert spans > 1000


def test_gazetteer_reads_a_text_once(spark):
    """A text with a name at every word is not copied for each of them, and goes to Python once."""
    from textloom.operators import gazetteer

    aliases = spark.createDataFrame([("York", "LOC", 1), ("New York", "LOC", 1)], "alias string, label string, sitelinks long")
    docs = spark.range(4).select(F.col("id").alias("article_id"), F.repeat(F.lit("\u00dc york, NEW York! "), 20_000).alias("text"))
    spans = gazetteer.gazetteer_spans(docs, aliases)
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "EvalPython" not in plan
    got = {tuple(r) for r in spans.agg(F.count(F.lit(1)), F.count_distinct("article_id", "start_char"), F.min("end_char"), F.max("end_char")).collect()}
    assert got == {(160_000, 160_000, 6, 20_000 * 18 - 2)}


@pytest.mark.parametrize("seed", range(8))
def test_density_clusters_by_definition(seed):
    import numpy as np

    from tests.test_queries import plain_clusters
    from textloom.operators import density

    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, size=(4, 2))
    x = np.vstack([c + rng.normal(scale=s, size=(m, 2)) for c, s, m in zip(centres, (0.3, 0.6, 1.0, 0.1), (15, 20, 12, 9), strict=True)] + [rng.uniform(-12, 12, size=(10, 2)), np.repeat(centres[:1], 6, axis=0)])
    x = np.round(x[rng.permutation(len(x))], 1 if seed % 2 else 6)  # ties, copies
    got, core = density.clusters(x, 5)
    want, plain_core = plain_clusters(x.tolist(), 5)
    assert got.tolist() == want and np.allclose(core, plain_core) and len(set(want)) > 2


def test_density_topics_on_odd_rows(spark):
    from textloom.operators import density

    texts = [f"apple pear plum {w}" for w in "abcdabcdabcd"] + [f"engine wheel brake {w}" for w in "efghefghefgh"] + ["lone words here now"]
    docs = [(f"d{i}", "en", t) for i, t in enumerate(texts)] + [("e", "en", ""), ("n", "en", None), ("u", "und", "apple pear"), ("b", "", "apple"), ("x", None, "apple"), ("f", "fr", "une seule")]
    made = spark.createDataFrame(docs, "article_id string, language string, text string")
    out = {r.article_id: r for r in density.density_topics(made, least=8).collect()}
    assert sorted(out) == sorted(f"d{i}" for i in range(25)) and out["d24"].topic_id == -1 and out["d24"].topic_label == "outlier"
    fruit, parts = ([out[f"d{i}"].topic_id for i in span if out[f"d{i}"].topic_id >= 0] for span in (range(12), range(12, 24)))
    assert len(fruit) >= 8 and len(parts) >= 8 and len(set(fruit)) == len(set(parts)) == 1 and {*fruit, *parts} == {0, 1}
    assert {r.topic_label.split("_")[1] for r in out.values() if r.topic_id == fruit[0]} == {"apple"}
    assert density.density_topics(made.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 4, 50])
def test_sitemap_walk_against_a_queue(spark, most):
    import random

    from tests.test_queries import plain_walk

    rng = random.Random(most)
    for _ in range(3):
        names = [f"u{i}" for i in range(14)]
        docs = {}
        for n in names:
            kids = rng.choices(names, k=rng.randint(0, 4))
            docs[n] = rng.choice([None, "<sitemapindex><sitemap>", "", "<urlset/>", "<urlset>" + "".join(f"<url><loc>{n}/{k}?a&amp;b</loc><lastmod>2024-01-01</lastmod></url>" for k in kids) + "</urlset>"] + ["<sitemapindex>" + "".join(f"<sitemap><loc>{k}</loc></sitemap>" for k in kids) + "</sitemapindex>"] * 6)
        del docs["u13"]
        entries, stats = crawl.walked_sitemaps(spark.createDataFrame([("u0",), ("u1",), ("u13",), ("u0",), (None,)], "root string"), spark.createDataFrame([*docs.items(), (None, "x")], "url string, content string"), most)
        found = {}
        for r in entries.collect():
            found.setdefault(r.root, []).append((r["loc"], str(r.lastmod.date())))
        got = {r.root: (r.documents, r.indeterminate, sorted(found.get(r.root, []))) for r in stats.collect()}
        assert got == plain_walk(["u0", "u1", "u13"], docs, most)


def test_softmax_of_long_vectors(spark):
    """The largest is looked for once for a vector, not once for each of its elements."""
    import time

    n = 60_000
    began = time.monotonic()
    got = spark.range(1).select(core.softmax(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i % 2 * 0.0)).alias("p")).select(F.size("p"), F.get("p", F.lit(7)), F.aggregate("p", F.lit(0.0), lambda s, v: s + v)).first()
    assert time.monotonic() - began < 15
    assert got[0] == n and abs(got[1] - 1 / n) < 1e-12 and abs(got[2] - 1) < 1e-9


def test_similarity_equals_difflib():
    import difflib
    import random

    rng = random.Random(6)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert revisions.similarity(a, b) == want
        bound = rng.random()
        assert (revisions.similarity(a, b, bound) >= bound) == (want >= bound) == (revisions.similarity(a, b, bound, bound) >= bound)


def test_similarity_of_long_texts_is_fast():
    """Two letters in turn: each letter of one text stands at half the places of the other."""
    import time

    began = time.monotonic()
    assert revisions.similarity("ab" * 4000, "ba" * 4000) == 15_998 / 16_000
    assert time.monotonic() - began < 2


def test_negation_is_found_once_for_a_clause(spark):
    """Negators are looked for below the explosion into words, not again for each word."""
    docs = spark.createDataFrame([("a", "good (not) good, good\nnever! good"), ("b", "nothing good"), ("c", None), ("d", "\"no\" bad bad")], "article_id string, text string")
    lex = spark.createDataFrame([("good", 1.0), ("bad", -0.5)], "word string, weight double")
    out = extract.negated_sentiment(docs, lex)
    assert sorted(rows(out)) == [("a", 0.5), ("b", 1.0), ("d", 0.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("array_position")


def test_small_arrow_batches(spark):
    """A batch of texts, and of what is found in them, is bounded by bytes."""
    from textloom.operators import gazetteer

    docs = spark.createDataFrame([("a", "York")], "article_id string, text string")
    aliases = spark.createDataFrame([("York", "LOC", 1)], "alias string, label string, sitelinks long")
    for make in (lambda: gazetteer.gazetteer_spans(docs, aliases), lambda: extract.detections(docs)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
        make()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
