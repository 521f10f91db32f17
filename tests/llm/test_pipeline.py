"""The pipeline: each stage's decisions, against plain versions on its own input."""

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_hits, brute_repeats, empty_docs, odd_docs
from textloom.llm.queries import table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, items = docs.columns, [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, small).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and (k == 4 or docs.columns == columns)
        if name == "quality_rules":
            labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
            assert sum(labels[i] == 1 for i in before.keys() - after.keys() if i in labels) <= 2
        elif name == "near_duplicates":
            assert sorted(after) == sorted({c for _, n, c in brute_components([(i, r.text) for i, r in before.items()]) if n} | {i for i, r in before.items() if not r.text.strip()})
        elif name == "repeated_strings":
            kept = dict(zip(before, brute_repeats([r.text.encode() for r in before.values()], 200), strict=True))
            assert {i: r.text for i, r in after.items()} == {i: t for i, x in kept.items() if (t := x.decode("utf-8", "ignore")).strip() or not before[i].text.strip()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "benchmark_passages":
            assert sorted(after) == sorted(d for d, _, hit, _ in brute_hits([(i, r.text) for i, r in before.items()], items) if not hit)
        else:
            assert set(after) == set(before) and docs.columns[: len(columns)] == columns
    assert corpus_pipeline.run(spark, small).count() == len(after)


def test_stages_on_odd_rows(spark, small):
    """Nulls, empty and long texts, repeated rows, clashing columns: every stage keeps the columns and clean rows."""
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.columns[: len(docs.columns)] == docs.columns
        n = out.count()
        if name == "near_duplicates":
            assert n == 8  # one of the two long texts, one of the repeated rows
        elif name == "repeated_strings":
            assert {r.doc_id for r in out.collect()} == {1, 2, None, 5, 6, 7, 8}  # the long copies are all repeats
        elif name in ("benchmark_passages", "source_mix"):
            assert n == 10
        assert stage(spark, empty_docs(spark), small).count() == 0
