"""Operators on corpora: against brute force, and on odd input."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, plain
from textloom.llm import bpe, decontaminate, html_text, mixing, neardup, queries, repeats, rules, substrings, topk, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, tag int, h long, key string, row string, words string, spans string, score double"
OTHER = ("en", "s", 1, 7, 8, "k", "r", "w", "sp", 0.5)


def odd_docs(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "", *OTHER), (2, None, *OTHER), (None, "a b c d e f g", *OTHER), (3, long, *OTHER), (4, long, *OTHER), (5, "one two three", *OTHER), (5, "one two three", *OTHER), (6, "ein zwei", *[None] * len(OTHER)), (7, "\n \t ", *OTHER), (8, "é" * 300 + " x", *OTHER), *extra]
    return spark.createDataFrame(rows, ODD)


def empty_docs(spark):
    return spark.createDataFrame([], ODD)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert plain(got).equals(plain(connect(small).execute(queries.ORACLES[name]).df()))


# token counts -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_tokens_equal_the_library(model_path):
    import sentencepiece

    known, rng = sentencepiece.SentencePieceProcessor(model_file=model_path), random.Random(5)
    texts = ["", " ", "  ", "a", " a", "a ", "▁", "the▁ the", "<s> </s> <0x0A>", "\0a \0", "x" * 700, "日本語" * 200, "\n\n a\tb", "a  b   c", "🙂🙂 é"]
    texts += ["".join(rng.choice("ab cde  \n▁\t<s>é中文字 the of 🙂") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert bpe.PieceCounter(model_path).count(texts) == [len(x) for x in known.encode(texts)]


def test_token_query(spark, model_path):
    got = {r.doc_id: r for r in bpe.token_counts(odd_docs(spark), model_path, limit=4).collect()}
    assert (got[1].n_tokens, got[1].n_bytes, got[2].n_tokens) == (0, 0, 0)
    assert got[3].over_limit and not got[1].over_limit
    assert bpe.token_counts(empty_docs(spark), model_path).count() == 0


# repeated strings --------------------------------------------------------------------------


def brute_repeats(texts, least):
    where = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - least + 1):
            if where[t[i : i + least]] > 1:
                gone.update(range(i, i + least))
        out.append(bytes(b for k, b in enumerate(t) if k not in gone))
    return out


def test_block_engine():
    rng = random.Random(3)
    for least in (4, 9):
        for _ in range(25):
            base = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 50))).encode() for _ in range(5)]
            parts = base + [b[rng.randint(0, 9) :] + rng.choice(base) for b in base]
            where = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
            want = [[i for i in range(len(p) - least + 1) if where[p[i : i + least]] > 1] for p in parts]
            assert [x.tolist() for x in repeats.repeated_starts(parts, least)] == want


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_repeats_against_brute_force(spark, monkeypatch, crowd):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8)))
    shared = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) + shared[rng.randint(0, 60) : rng.randint(150, 400)] + word() for _ in range(30)] + ["", "x" * 600, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = repeats.keyed(docs, "doc_id", "text")
    spans = defaultdict(list)
    for r in repeats.repeat_spans(own, 40, 12, crowd).collect():
        spans[r.doc_id] += [(x.start, x.stop) for x in r.spans]
    raw = [(t or "").encode() for t in texts]
    for k, want in enumerate(brute_repeats(raw, 40)):
        gone = {i for a, b in spans[k] for i in range(a, b)}
        assert bytes(b for i, b in enumerate(raw[k]) if i not in gone) == want


def test_repeats_on_odd_rows(spark):
    got = {(r.doc_id, r.n_bytes): r for r in repeats.without_repeats(odd_docs(spark)).collect()}
    assert got[1, 0].n_removed == 0 and got[2, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    three = next(r for k, r in got.items() if k[0] == 3)
    assert three.n_removed == three.n_bytes and three.n_spans == 1
    assert next(r for k, r in got.items() if k[0] == 8).n_removed == 600  # one letter repeated repeats every window of it
    assert repeats.without_repeats(odd_docs(spark)).count() == 10 and repeats.without_repeats(empty_docs(spark)).count() == 0
    assert repeats.cleaned(odd_docs(spark)).columns == odd_docs(spark).columns
    assert repeats.cleaned(empty_docs(spark)).count() == 0


# near duplicates ----------------------------------------------------------------------------


def brute_components(rows, percent=85, size=5):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("limits", [(neardup.CROWD, neardup.SHARE), (2, 3)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(neardup, "CROWD", limits[0])
    monkeypatch.setattr(neardup, "SHARE", limits[1])
    rng, rows = random.Random(4), []
    for g in range(12):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"E{rng.randint(0, 99)}"
            rows.append((len(rows) * 3 % 101 + 101 * g, " ".join(copy)))
    rows += [(5000, ""), (5001, None), (5002, "  ")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute_components(rows), key=repr)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


@pytest.mark.parametrize("crowd", [neardup.CROWD, 2])
def test_less_similar_duplicates(spark, monkeypatch, crowd):
    """The slots that may differ follow from the least similarity."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rng, rows = random.Random(6), []
    for g in range(30):
        base = [f"g{g}w{k}" for k in range(120)]
        copy = list(base)
        for at in (20, 50, 80, 100)[: rng.randint(2, 4)]:
            copy[at] = f"E{g}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 65):
        got = neardup.near_duplicates(docs, percent)
        assert collected(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute_components(rows, percent), key=repr)
    assert [neardup.errors_of(p) for p in (85, 80, 65)] == [0, 0, 1] and neardup.reach_of(85) > neardup.REACH
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, 5)


def missed_pair(words: int = 2000, edits: int = 32) -> tuple[str, str]:
    """Two texts over 85 percent alike whose signatures agree in no piece: the words under its least values are replaced."""
    base = [f"w{k}" for k in range(words)]
    values, offs = neardup.word_values(np.frombuffer(" ".join(base).encode(), np.uint8), np.array([0, len(" ".join(base).encode())]), lower=True)
    grams, _ = neardup.shingles(values, offs)
    least = [int(np.argmin(grams * neardup._MUL[k] + neardup._ADD[k])) for k in range(neardup.SLOTS)]
    width = neardup.SLOTS // neardup.CHUNKS
    at = [least[k] for k in range(0, neardup.SLOTS, width)]
    at += [k for k in least if k not in at][: edits - len(set(at))]
    other = list(base)
    for k in at:
        other[k + 2] = f"other{k}"
    return " ".join(base), " ".join(other)


@pytest.mark.parametrize("limits", [(neardup.CROWD, neardup.SHARE), (2, 3)])
def test_pairs_that_signatures_miss(spark, monkeypatch, limits):
    """Similar texts are linked even if their signatures agree in no piece, also where parts are crowded."""
    monkeypatch.setattr(neardup, "CROWD", limits[0])
    monkeypatch.setattr(neardup, "SHARE", limits[1])
    one, two = missed_pair()
    a, b = (neardup.signatures(neardup.text_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5))[0] for t in (one, two))
    assert not (a == b).any()
    rows = [(7, one), (3, two), (9, two + " more"), (4, " ".join(one.split()[:1000] + [f"z{k}" for k in range(1000)]))]
    rows += [(20 + g, " ".join(one.split()[: 1200] + [f"g{g}z{k}" for k in range(800)])) for g in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {d: c for d, _, c in want}[7] == 3
    assert collected(neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")) == sorted(want, key=repr)
    assert 7 not in {r.doc_id for r in neardup.deduplicated(docs).collect()}


@pytest.mark.parametrize("percent", [85, 65])
def test_similar_sets_share_parts(percent):
    """Pairs of least similarity agree in more parts than the spare ones of a band, and parities bound their differences."""
    rng = np.random.default_rng(percent)
    for n in [*range(2, 40), *rng.integers(40, 3000, 60).tolist()]:
        both = -(-n * percent // 100)
        union = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = int(rng.integers(both, n + 1))
        sets = [union[:cut], np.r_[union[:both], union[cut:]]]
        apart = n - both
        assert apart <= neardup.apart(len(sets[0]) + len(sets[1]), percent)
        rows, keys = neardup.part_keys(sets, percent)
        same = set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
        spare = neardup.bands(percent)[2]
        assert not apart or any(sum(k & 0xFF == band for k in same) > spare[band] for band in {k & 0xFF for k in same})
        bits = [neardup.parities(s) for s in sets]
        words = min(map(len, bits))
        x, y = neardup._folded(bits, words)
        assert np.bitwise_count(x ^ y).sum() <= apart


def test_near_duplicates_on_odd_rows(spark):
    got = neardup.near_duplicates(odd_docs(spark))
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert got.count() == 10 and by[4][0].component_id == 3 and len(by[5]) == 2 and by[1][0].n_shingles == 0
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0
    one = neardup.deduplicated(odd_docs(spark))
    assert one.columns == odd_docs(spark).columns
    ids = [r.doc_id for r in one.collect()]
    assert 4 not in ids and ids.count(5) == 1 and {1, 2, 3, 6, 7, 8} <= set(ids) and None in ids


@pytest.mark.parametrize("find", [neardup.components, neardup._hooked])
def test_components(spark, monkeypatch, find):
    monkeypatch.setattr(neardup, "LINKS", 4)
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randint(0, 80), 100 + rng.randint(0, 80)) for _ in range(70)] + [(300, 301), (301, 300)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    got = dict(map(tuple, find(spark.createDataFrame(edges, "a long, b long").repartition(40)).select("u", "comp").collect()))
    top = {x: x for e in edges for x in e}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    assert got == {x: root(x) for x in top}


def test_pairs_within_reach_meet():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, neardup.SLOTS)
    for _ in range(200):
        other = base.copy()
        other[rng.choice(neardup.SLOTS, neardup.REACH, replace=False)] += 1
        a, b = (x.reshape(neardup.CHUNKS, -1) for x in (base, other))
        assert (a == b).all(axis=1).any()


def planted_signatures(pairs, rng, percent):
    """Signatures of pairs of sets of 200 values or so with a similarity of percent at least, hardly more."""
    out = []
    for _ in range(pairs):
        n = int(rng.integers(60, 260))
        both = -(-n * percent // 100)  # of n different values so many are common
        union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        left = both + (n - both) // 2
        out += [union[:left], np.r_[union[:both], union[left:]]]
    return neardup.signatures(out).view(np.uint16).reshape(pairs, 2, neardup.CHUNKS, 4)[..., :3]


@pytest.mark.parametrize("percent", [85, 90])
def test_recall_of_the_index(percent):
    """Planted pairs at the least similarity meet in a piece and are within reach."""
    sig = planted_signatures(20_000, np.random.default_rng(percent), percent)
    same = sig[:, 0] == sig[:, 1]
    assert (same.all(axis=2).any(axis=1) & ((~same).sum(axis=(1, 2)) <= neardup.reach_of(85))).all()


def test_forest():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        first = rng.integers(0, n, n)
        forest = neardup.Forest(first)
        made, edges = [], []
        for _ in range(3):
            p, q = rng.integers(0, n, (2, 15))
            edges += zip(p.tolist(), q.tolist(), strict=True)
            made += [(int(p[k]), int(q[k])) for k in forest.join(p, q)]
        for links in (edges, made):  # what was made is enough, and no more than trees
            label = first.copy()
            for a, b in links:
                label[label == label[a]] = label[b]
            assert len(np.unique(label)) == len(np.unique(forest.label)) == len({(a, b) for a, b in zip(label, forest.label, strict=True)})
        assert len(made) == len(np.unique(first)) - len(np.unique(forest.label))


def test_crowded_keys_are_split(spark, monkeypatch):
    """One key of 900 nodes: no task holds much more than two blocks, and a cluster does not meet itself again."""
    monkeypatch.setattr(neardup, "CROWD", 20)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, 4 * neardup.CHUNKS)
    rows = []
    for u in range(900):
        sig = base.copy() if u < 700 else rng.integers(0, 1 << 16, len(base))
        if u < 700:
            sig[rng.choice(len(sig), 3)] = u
        elif u >= 890:  # these are near some others only
            sig = np.array(rows[-10][1], np.int64).view(np.uint16).astype(int)
            sig[rng.choice(len(sig), 3)] = u
        rows.append((u, sig.astype(np.uint16).view(np.int64).tolist()))
    sigs = spark.createDataFrame(rows, "u long, sig array<long>").cache()
    dealt = []

    def attach(part):
        dealt.append(part)
        return part.join(sigs, "u")

    links = neardup._links(sigs.select(F.lit(1).cast("long").alias("key"), "u", F.lit(1 / 20).alias("cost")), attach, neardup._forest(21), "test")
    got = dict(map(tuple, neardup.components(links).select("u", "comp").collect()))
    slots = [np.array(s, np.int64).view(np.uint16).reshape(-1, 4)[:, :3] for _, s in rows]
    want = list(range(900))
    for a, b in combinations(range(900), 2):
        if want[a] != want[b] and (slots[a] != slots[b]).sum() <= 21:
            low, high = sorted((want[a], want[b]))
            want = [low if x == high else x for x in want]
    assert {u: got.get(u, u) for u in range(900)} == dict(enumerate(want))
    for part in dealt:
        assert part.groupBy(*neardup.MEET).count().agg(F.max("count")).first()[0] <= 80
    # 700 nodes of the cluster once for each of ten blocks of the others, not for each of its own 35
    assert dealt[-1].where("u < 700").groupBy("u").count().agg(F.max("count")).first()[0] <= 11
    assert dealt[0].count() == 1800 and dealt[-1].count() <= 700 * 11 + 210 * (35 + 11)


# benchmark passages ---------------------------------------------------------------------------


def brute_hits(docs, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, which = cut(t), set(), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    which |= ids
        out.append((d, len(w), len(hit), ",".join(sorted(which))))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("a b c d Ee f".split()) + rng.choice(["", ".", "1"]) for _ in range(n))
    items = [(k, text(rng.randint(0, 16))) for k in range(12)] + [(20, "a a a"), (21, None), (22, "!!"), (22, "É e")]
    docs = [(k, text(rng.randint(0, 60)) + (" " + rng.choice(items)[1] + " " if rng.random() < 0.7 and (items := [i for i in items if i[1]] or items) else "")) for k in range(60)] + [(90, None), (91, "é É e")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_hits(docs, items)
    assert collected(got.select("doc_id", "n_words", "n_hit", F.array_join("items", ","))) == want
    assert {r.items_sha256 for r in got.where("n_hit = 0").collect()} <= {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_shared_windows_and_null_ids(spark, monkeypatch, rows):
    """A window of 10,000 items, and rows without an id, by broadcast and by shuffle; a window of one frequent word."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr("textloom.llm.common.BROADCAST_ROWS", rows)
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit("to be or not to be").alias("text")).unionByName(spark.createDataFrame([(20_000, "the the the"), (20_001, "rare"), (None, "null id")], "item_id long, text string"))
    docs = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("the the the the x"), F.col("id").cast("string"), F.lit(" y")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "so to be or not to be it is"), (2, "rare null id"), (2, "to be or"), (3, None)], "doc_id long, text string"))
    got = decontaminate.contamination(docs, items)
    some = {r.doc_id: r for r in got.where("doc_id IS NOT NULL AND n_words > 3 OR doc_id = 2 AND contaminated").collect()}
    assert (some[1].n_hit, some[1].n_items, some[1].items[0], some[2].items, some[2].n_hit) == (6, 10_000, "0", ["20001"], 1)
    assert got.count() == 3_004 and got.where("doc_id IS NULL AND n_hit = 4 AND n_items = 1").count() == 3_000
    assert got.where("NOT contaminated").count() == 2


def test_contamination_on_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three", "x"), (2, None, "y"), (4, "ein zwei", "z"), (None, "a b c", "z")], "item_id long, text string, words string")
    got = decontaminate.contamination(odd_docs(spark), items)
    assert got.count() == 10 and {r.doc_id for r in got.where("contaminated").collect()} == {5, 6}
    assert decontaminate.contamination(empty_docs(spark), items).count() == 0
    assert decontaminate.contamination(odd_docs(spark), items.limit(0)).where("contaminated").count() == 0
    assert "row" in decontaminate.contamination(odd_docs(spark), items, carry=True).columns


def test_proximity(spark):
    index = spark.createDataFrame([(1, 7, 3), (2, 7, 5), (2, 7, 30), (1, 8, 0)], "term long, key long, pos int")
    assert collected(decontaminate.proximity_matches(index, 1, 2, 3)) == [(7, 3, 5)]


# duplicate word runs -----------------------------------------------------------------------------


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
def test_runs_against_brute_force(spark, crowd):
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    docs = []
    for k in range(40):
        a = rng.randint(0, 30)
        docs.append((k * 7 % 41, [f"u{rng.randint(0, 60)}" for _ in range(rng.randint(0, 20))] + shared[a : a + rng.randint(0, 30)] + ["z"] * rng.randint(0, 20)))
    own = substrings.keyed(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), "doc_id", "text")
    spans = defaultdict(set)
    for r in substrings.duplicate_spans(own, 13, 4, crowd).collect():
        spans[r.doc_id].update(p for x in r.spans for p in range(x.start, x.stop))
    first = {}
    for i, w in docs:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    for i, w in docs:
        want = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        assert spans[i] == want


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
def test_runs_repeated_within_a_document(spark, crowd):
    """Passages that recur with their context in one text, or in other rows of the same id, all go."""
    w = [f"w{k}" for k in range(1, 14)]
    docs = [(1, w), (2, ["x", *w, "y", "x", *w, "y"]), (3, [f"p{k}" for k in range(13)])]
    docs += [(4, [*end, "q", *(f"p{k}" for k in range(13)), "r"]) for end in (["a"], ["b", "c"])]
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(60)]
    for k in range(30):
        a = rng.randint(0, 30)
        part = [rng.choice("ab"), *shared[a : a + rng.randint(12, 30)], rng.choice("ab")]
        docs.append((10 + k % 17, [f"u{k}", *part, f"v{k}", *part * rng.randint(0, 2)]))
    own = substrings.keyed(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), "doc_id", "text").cache()
    spans = defaultdict(set)
    for r in substrings.duplicate_spans(own, 13, 4, crowd).collect():
        spans[r.doc_id, r.tag].update(p for x in r.spans for p in range(x.start, x.stop))
    first = {}
    for i, w in docs:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    for r in own.collect():
        w = r.text.split()
        assert spans[r.doc_id, r.tag] == {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for p in range(k, k + 13)}


def test_runs_on_odd_rows(spark):
    got = {r.doc_id: r for r in substrings.without_duplicate_runs(odd_docs(spark)).collect()}
    assert got[4].n_removed == got[4].n_words == 30_000 and got[3].n_removed == 0 and got[2].n_words == 0
    assert got[7].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_removed == 0
    assert substrings.without_duplicate_runs(empty_docs(spark)).count() == 0


# mixing ---------------------------------------------------------------------------------------------


def ideal_counts(sizes, weights, t):
    """Exact shares at slot t, by following the ideal mix from one exhausted source to the next."""
    given, left = [Fraction(0)] * len(sizes), Fraction(t)
    while left > 0:
        live = [k for k in range(len(sizes)) if given[k] < sizes[k]]
        total = sum(weights[k] for k in live)
        step = min(left, min((sizes[k] - given[k]) * total / weights[k] for k in live))
        for k in live:
            given[k] += step * weights[k] / total
        left -= step
    return given


def scheduled(ideal, stretch, slots=None):
    """Source and block of every slot, stretch by stretch."""
    cuts = ideal.cuts([(a, b, ideal.free(a, b)) for a, b in ideal.stretches(stretch, slots)])
    return [x for cut in cuts for x in ideal.schedule(*cut)]


def assert_fair(sizes, weights, stretch):
    ideal = mixing.Ideal(sizes, weights)
    given, total = [0] * len(sizes), sum(weights)
    first = min(Fraction(n * total, w) for n, w in zip(sizes, weights, strict=True))  # the first source has run out
    for slot, (s, b) in enumerate(scheduled(ideal, stretch), 1):
        assert b == given[s]
        given[s] += 1
        if slot <= first:
            assert all(abs(g * total - slot * w) < total for g, w in zip(given, weights, strict=True))
        elif slot % 7 == 0:
            assert all(abs(g - x) < 1 for g, x in zip(given, ideal_counts(sizes, weights, slot), strict=True))
    assert given == list(sizes)


def test_schedule_is_fair():
    """No source is a block off its exact share, whatever the weights and wherever the slots are cut."""
    rng = random.Random(12)
    for stretch in (1, 3, 10, 10**6):
        assert_fair([40, 40], [1, 1], stretch)
        assert_fair([33, 50, 17, 1], [333, 500, 166, 1], stretch)
        assert_fair([30] * 9, [900, *[100] * 5, 37, 1, 2], stretch)
        for _ in range(30):
            n = rng.randint(1, 9)
            assert_fair([rng.randint(1, 25) for _ in range(n)], [rng.choice([1, 2, 7, 97, 1009]) for _ in range(n)], stretch)
    tied = mixing.whole_weights({"a": 0.1, "b": 1e-5, None: 2.0})
    assert Fraction(tied["a"], tied[None]) == Fraction(0.1) / 2


@pytest.mark.parametrize("targets", [(2.0, 1.0), (1.0, 1e-5, 1.0), (3**0.5, 2**0.5, 0.1, 1.0)])
def test_long_schedules_are_fair(targets):
    """Weights that no short period divides, 120,000 slots and many cuts."""
    weights = list(mixing.whole_weights(dict(enumerate(targets))).values())
    total, slots, stretch = sum(weights), 120_000, 997
    ideal = mixing.Ideal([10**9] * len(weights), weights)
    given = [0] * len(weights)
    for slot, (s, _) in enumerate(scheduled(ideal, stretch, slots), 1):
        given[s] += 1
        assert all(abs(g * total - slot * w) < total for g, w in zip(given, weights, strict=True))


def test_earliest_deadline_first_over_all_slots():
    """Cut or not, every block lies between its release and its deadline, as in a plain run over all blocks."""
    sizes, weights = [200, 90, 40, 300, 7], [5, 3, 3, 11, 1]
    ideal = mixing.Ideal(sizes, weights)
    place = {k: s for s, k in enumerate(ideal.order)}
    blocks = [(ideal.release(place[k], i), ideal.deadline(place[k], i), k, i) for k, n in enumerate(sizes) for i in range(n)]
    todo = set(blocks)
    for slot in range(ideal.slots):
        one = min((b for b in todo if b[0] <= slot), key=lambda b: (b[1], b[2]))
        assert slot < one[1]
        todo.remove(one)
    window = {(k, i): (r, d) for r, d, k, i in blocks}
    for stretch in (5, 50, 1000):
        done = scheduled(ideal, stretch)
        assert len(set(done)) == ideal.slots and all(window[x][0] <= slot < window[x][1] for slot, x in enumerate(done))


def test_many_sources():
    """Ten thousand sources of different weights: each stretch takes seconds."""
    rng = random.Random(3)
    weights = [rng.random() + 1e-3 for _ in range(10_000)]
    ideal = mixing.Ideal([rng.randint(1, 500) for _ in weights], list(mixing.whole_weights(dict(enumerate(weights))).values()))
    began = time.process_time()
    done = scheduled(ideal, 640_000, 1_280_000)
    assert len(set(done)) == 1_280_000 and time.process_time() - began < 60


def test_mix_gives_every_row_once(spark):
    rows = [(k, "big") for k in range(2000)] + [(k, "mid") for k in range(500)] + [(k, None) for k in range(70)] + [(k, "last") for k in range(20)] + [(1, "big"), (1, "big"), (None, "mid")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, mix_slot string")
    out = mixing.interleave(docs, {"big": 2.0, "mid": 1.0, None: 0.7}, block=8, stretch=50).toPandas()
    assert Counter(zip(out.doc_id.astype("Int64").astype(str), out.source.astype(str))) == Counter((str(a) if a is not None else "<NA>", str(b)) for a, b in rows)
    slots = out.groupby("mix_slot").source.agg(lambda s: s.fillna("?").iloc[0]).sort_index()
    assert list(slots.index) == list(range(len(slots)))  # no slot is empty, none has two blocks
    assert out.groupby("mix_slot").size().max() <= 8 and not out.duplicated(["mix_slot", "mix_offset"]).any()
    names, sizes, weights = ["big", "mid", "?"], [251, 63, 9], [20, 10, 7]
    given = Counter()
    for t, s in enumerate(slots, 1):
        given[s] += 1
        if t <= sum(sizes):
            assert all(abs(given[x] - y) < 1 + 1e-9 for x, y in zip(names, ideal_counts(sizes, weights, t), strict=True))
    assert set(slots.iloc[-3:]) == {"last"}
    assert out.groupby("mix_slot").mix_block.nunique().max() == 1
    assert mixing.interleave(docs.limit(0)).count() == 0
    assert mixing.interleave(odd_docs(spark)).count() == 10


def test_mix_query(spark, small):
    """The registered query: every document once, blocks of one source, shares within a block of the ideal mix."""
    docs = queries.table(spark, small, "documents").select("doc_id", "source").toPandas()
    out = queries.op8_pfair_mix(spark, small).toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    counts = docs.source.value_counts()
    names = sorted(counts.index)
    sizes, weights = [-(-counts[s] // mixing.BLOCK) for s in names], [mixing.tempered(counts.to_dict(), 0.5)[s] for s in names]
    given = Counter()
    for t, (_, part) in enumerate(sorted(out.groupby("mix_slot")), 1):
        assert part.source.nunique() == 1 and sorted(part.mix_offset) == list(range(len(part)))
        given[part.source.iloc[0]] += 1
        assert all(abs(given[s] - x) < 1 for s, x in zip(names, ideal_counts(sizes, weights, t), strict=True))


# pages -----------------------------------------------------------------------------------------------


def test_long_rowspan():
    """Columns stay aligned beside a cell of more than 200 rows."""
    table = "<table><tr><td rowspan=300>a<td>b<td>c</tr>" + "<tr><td>d<td>e</tr>" * 299 + "<tr><td>f<td>g<td>h</tr></table>"
    assert html_text.render(table).split("\n") == ["a  b  c", *["   d  e"] * 299, "f  g  h"]


def test_rendering():
    page = "<html><head><title>no</title><style>p{}</style><body><nav hidden>no</nav><h1>Head</h1><p>a<b>b</b> c<p>d<br>e<div style='display: none'>no</div><ul><li>x<li>y<ol><li>k<li>l</ol></ul><table><tr><th>col<th>b<tr><td>1<td>long cell</table><pre>  a\n b</pre>t &lt; &amp;"
    want = "Head\n\nab c\n\nd\ne\n\n- x\n- y\n  1. k\n  2. l\n\ncol  b\n1    long cell\n\n  a\n b\n\nt < &"
    assert html_text.render(page) == want
    assert html_text.render(None) == html_text.render("") == html_text.render("<p>") == ""
    for broken in ("<", "</", "a <b", "<div" * 50, "<p><table><td>x</p></table></td>", "<script>x", "<!-- x", "<td>a</td>" * 3, "<li>" * 300, "</p></div>x", "<div>" * 5000 + "x", "<table>" * 200 + "x"):
        assert isinstance(html_text.render(broken), str)
    assert html_text.render("<div>" * 3000 + "deep") == "deep"
    assert html_text.render("x<td colspan=99999999 rowspan=0>y</td>") == "xy"


def test_rendering_of_fragments():
    """Character references, formulas, graphics, selects, unclosed markup, tables that cannot be aligned or are too deep."""
    cases = {
        "a<select><option>x<option selected>y</select>b": "a y b", "<select multiple><option>x<option>y</select>": "x y", "<select><option>x<select><option>z</select>": "x z",
        "<math><mi>z</mi><annotation>q</annotation></math>": "z", "<svg><title>t</title><text>one</text><text>two</text></svg>": "one\ntwo",
        "&#" + "9" * 6000 + ";&#0000000065;&#x41;": "\ufffdAA", 'x <a href="y>z</a> t': "x z t", 'x <a href="y>z</a> "t': "x", "a <b": "a", "a < b > c": "a < b > c", "a <!-- b": "a", "a <!--> b": "a b", "a</>b</ >c": "abc",
        "<p title='>'>x": "x", "<table>" * 90 + "<td>x<td>y" + "</table>" * 90 + "z": "x\ny\n\nz",
    }
    for page, want in cases.items():
        assert html_text.render(page) == want, page
    wide = "<table><tr>" + ("<td rowspan=60000>" + "x" * 80) * 150 + "<tr><td>y" * 20_000
    assert html_text.render(wide).split() == ["x" * 80] * 150 + ["y"] * 20_000


@pytest.mark.parametrize("unit", ["<a ", '<a href="', "<a href='x\" ", '<a ">" ', "<!-- ", "<![", "<b x=", "</", "&#1", "<p><span>", "<li>", "<ul><li>", "<select><option>a", "<table><td>x", "<td rowspan=9>", "<script>"])
def test_rendering_is_linear(unit):
    """Pages of broken markup: eight times the length takes no more than some eight times the time."""
    seconds = []
    for size in (40_000, 320_000):
        began = time.process_time()
        html_text.render(unit * (size // len(unit)))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * seconds[0] + 0.5


def test_long_pages():
    for unit in ("<a ", '<a href="', "<!-- "):
        assert html_text.render("x" + unit * (10_000_000 // len(unit))) == "x"


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "<p>x<p>y", "b"), (2, "<p>x<p>y", "b"), (None, "", "c")], "page_id long, html string, text string")
    assert collected(html_text.extract_pages(pages).select("page_id", "text", "n_lines")) == sorted([(1, "", 0), (2, "x\n\ny", 3), (2, "x\n\ny", 3), (None, "", 0)], key=repr)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# top-k --------------------------------------------------------------------------------------------------


def test_topk_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = random.Random(2)
    rows = [(k, [float(rng.randint(-2, 2)) / 1024 for _ in range(3)]) for k in range(0, 420)] + [(500, None), (600, [float("nan"), 0.0, 0.0]), (700, [None, 0.0, 0.0]), (800, [1.0]), (None, [1.0, 1.0, 1.0]), (100, [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collected(topk.exact_topk(vectors, lambda i: i % 100 == 0, 10))
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ints:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert got == sorted(want, key=repr)
    assert topk.exact_topk(vectors.limit(0), lambda i: i % 100 == 0).count() == 0


def test_topk_never_broadcasts_the_blocks(spark):
    """Few queries look small to the planner, but each of their blocks goes to every lane."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((600, 8)).tolist())], "vec_id long, embedding array<double>")
    out = topk.exact_topk(df, lambda i: i % 100 == 0, 3, lanes=64)
    assert len(out.collect()) == 18
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


# classifiers ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_rules", "quality", 0.95), ("op5_toxic_segments", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).toPandas().merge(queries.table(spark, folder, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    fold = (5, 0) if label == "quality" else (3, 1)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % fold[0] == fold[1] for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (held.predicted == held[label]).mean() >= least


def plain_statistics(text):
    """The statistics of a text, each by its definition."""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    marks = [sum(text.count(x) for x in y) / w for y in "|!.,"]
    odd = [b for b in raw if 0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]
    return [len(text), len(words), sum(len(x) for x in words) / w, max([len(x) for x in words], default=0), len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
            len(set(lines)) / len(lines), len(words) / len(lines), *[sum(f(x) for x in words) / w for f in (str.isupper, str.istitle, str.isalpha)], len(odd) / n, sum(chr(b) in "0123456789" for b in raw) / n, *marks]


def test_quality_query_against_plain_rules(spark, small):
    """The registered query equals the rules of its model, applied one by one to plain statistics."""
    docs, labels = (queries.table(spark, small, t) for t in ("documents", "labels"))
    model = rules.fit_quality(docs, labels, queries.fold("doc_id", 5) != 0)
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, small).collect()}
    assert len(got) == docs.count() and model.rules
    for r in docs.collect():
        x = plain_statistics(r.text)
        assert np.allclose(x, rules.text_stats(r.text)[:-1])
        x.append(rules.compressed_size(r.text.encode()) / max(1, len(r.text.encode())))
        total = model.bias + sum(w for rule, w in model.rules if all((x[f] > cut) == up for f, up, cut in rule))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
    assert len(zlib.decompress(b"".join(zlib.compress(b"ab" * 9).split()))) == 18 and rules.compressed_size(b"ab" * 3_000_000) < 60_000


@pytest.mark.parametrize("clean,toxic,noise", [(6040, 707, 120), (6040, 707, 0), (12206, 1444, 150), (50, 3, 0), (3, 50, 1), (18000, 2000, 900), (1, 1, 0)])
def test_toxicity_calibration_holds_where_classes_are_apart(clean, toxic, noise):
    """The shift and slope are the least of the loss, also where Newton steps without a check run away."""
    draw = np.random.default_rng(clean + noise)
    x = np.concatenate([np.full(clean, 0.78), draw.uniform(0.78, 12, noise), np.full(toxic, 12.0)])
    y = np.concatenate([np.zeros(clean + noise), np.ones(toxic)])
    w, b = toxicity._logistic(x, y)

    def loss(w, b):
        z = w * x + b
        return (np.logaddexp(0, z) - y * z).sum() + 0.05 * w * w

    around = [(w + dw, b + db) for dw in (-0.05, 0, 0.05) for db in (-0.2, 0, 0.2)]
    assert w > 0 and all(loss(w, b) <= loss(*a) + 1e-6 for a in around)
    assert w * 0.78 + b < 0 < w * 12 + b
    if not noise and min(clean, toxic) > 1:  # as far apart as these, toxic texts pass the threshold of 0.7
        assert 1 / (1 + np.exp(-(w * 12 + b))) >= 0.7
    assert toxicity._logistic(-x, y)[0] == 0.0


def test_toxicity_query_against_plain_scan(spark):
    """The registered query equals a plain run of its model, word by word."""
    small = "/root/testdata/sf0.01"
    docs, labels = (queries.table(spark, small, t) for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, queries.fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in queries.op5_toxic_segments(spark, small).collect()}
    assert len(got) == docs.count() and model.weights
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        weights = [max((model.weights[u] for u in ["=" + w, *(w[:n] for n in toxicity.STARTS if n <= len(w))] if u in model.weights), default=model.other) for w in words]
        total = sum(s * model.unit - np.log(len(words) + 1) for _, _, s in toxicity.segments(weights) if s * model.unit > np.log(len(words) + 1))
        rare = min(12.0, -np.log(max(1e-300, -np.expm1(-np.exp(-np.clip((total - model.place) / model.width, -700, 700))))))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(model.slope * rare + model.shift, -30, 30)))) < 1e-6


def test_a_class_of_one_word(spark):
    """A unit that is all of its class, beside a class of long texts, is in the lexicon, and odds are finite."""
    docs = spark.createDataFrame([(k, f"vile vile vile vile x{k}" if k % 2 else "fine words of a longer kind " * 40 + f"y{k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True), prior=100.0)
    assert "=vile" in model.weights and all(np.isfinite(w) for w in model.weights.values())
    assert model.score("this is vile vile") > 0.5 > model.score("fine words")


def test_samples_of_repeated_ids(spark):
    """Ids that repeat in documents give one row each to a fit, always the same."""
    docs = spark.createDataFrame([(k % 40, f"{'good' if k % 2 else 'BAD || '} text {k} " * 5) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    models = [rules.fit_quality(x, labels, F.lit(True)) for x in (docs, docs.orderBy(F.rand(3)))]
    assert models[0] == models[1]


def test_rules_column_equals_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(rules.STATS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = rules.fit_rules(x, y)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in rules.STATS)).select(F.struct(*rules.STATS).alias("stats"))
    got = np.array([r[0] for r in rows.select(model.column()).collect()])
    total = model.bias + sum(w * np.all([(x[:, f] > c) == up for f, up, c in rule], axis=0) for rule, w in model.rules)
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-np.clip(total, -30, 30))))) and ((total > 0) == y).mean() > 0.97


def test_classifiers_on_odd_rows(spark):
    docs = odd_docs(spark)
    for labels in (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")):
        quality = rules.quality_scores(docs, rules.fit_quality(docs, labels, F.lit(True)))
        toxic = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels, F.lit(True)))
        assert quality.count() == toxic.count() == 10 and quality.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert toxic.where("score IS NULL").count() == 0
    assert rules.quality_scores(empty_docs(spark), rules.RuleModel()).count() == 0
    assert toxicity.toxicity_scores(empty_docs(spark), toxicity.ToxicModel()).count() == 0


def test_maximal_segments():
    rng = random.Random(1)

    def brute(x):
        best = max(((sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[2], best[3]
        return [(p, q) for p, q in brute(x[:a])] + [(a, b)] + [(p + b, q + b) for p, q in brute(x[b:])]

    for _ in range(200):
        x = [rng.choice([-3, -1, 2, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == brute(x)


def test_parts_of_the_same_nodes_meet_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 3)
    at = [(k, u, u) for k in (5, 4, 9) for u in (1, 2, 2**40)] + [(6, u, u) for u in (1, 2)] + [(k, u, u) for k in (7, 8) for u in range(4)] + [(k, u, 1) for k in (2, 3) for u in (1, 2)]
    got = neardup._once(spark.createDataFrame(at, "key long, u long, comp long")).collect()
    assert sorted(map(tuple, got)) == [(4, 0), (6, 0), (7, 1), (8, 1)]


def test_near_duplicates_leave_no_shuffles_and_few_tables(spark, small):
    """Shuffled bytes go with each action, tables with the last that reads them; the setting is as before."""
    from textloom.functions import scratch

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name), []
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    with scratch.scratch(spark) as paths:
        real = neardup.components
        neardup.components = lambda links: seen.append(spark.conf.get(name)) or real(links)
        try:
            rows = neardup.near_duplicates(docs).count()
        finally:
            neardup.components = real
        assert [p.split("textloom-")[-1].split("-")[0] for p in paths] == ["signed", "classes"]
    assert rows == docs.count() and set(seen) == {"true"} and spark.conf.get(name) == before
