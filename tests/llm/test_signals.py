"""Fingerprints, tokenizer alignment and whitening: against brute force, and on odd input."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import empty_docs, odd_docs
from textloom.llm import crosstoken, fingerprints, queries, whiten

# fingerprints ------------------------------------------------------------------------------


def words(text):
    return Counter(w for w in text.lower().replace("\n", " ").replace("\t", " ").split(" ") if w)


def jaccard(a, b):
    a, b = words(a), words(b)
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def edits(rows):
    """(text, edited, next) of each row, by id; nulls first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in rows]
    follows = texts[1:] + texts[:1]
    return {i: (t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n) for (i, _), t, n in zip(rows, texts, follows, strict=True)}


def plain_fingerprint(text, slots=fingerprints.SLOTS):
    """Consistent weighted sampling slot by slot, over all terms, without bounds."""
    import xxhash

    M = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def hash_long(value, seed):  # eight bytes, as xxHash64 has it
        return xxhash.xxh64((value & M).to_bytes(8, "little"), seed=seed).intdigest()

    def hash_int(value, seed):
        return xxhash.xxh64((value & 0xFFFFFFFF).to_bytes(4, "little"), seed=seed).intdigest()

    out = []
    share = lambda bits, start, width: ((bits >> start & ((1 << width) - 1)) + 0.5) * 2.0**-width
    terms = [(xxhash.xxh64(w.encode(), seed=42).intdigest(), n) for w, n in words(text).items()]
    for k in range(slots):
        best = None
        for h, n in terms:
            one, two = (hash_int(2 * k + j, hash_long(h, 42)) for j in (0, 1))
            r, c, b = -math.log(share(one, 0, 24) * share(one, 24, 24)), -math.log(share(two, 0, 32) * share(two, 32, 32)), share(one, 48, 16)
            t = math.floor(math.log(n) / r + b)
            key = (math.floor((max(math.log(c) - r * (t - b + 1), -64.0) + 64.0) * (1 << 24)), hash_long(t, hash_long(h, 42)) >> 32)
            best = key if best is None else min(best, key)
        out.append("0000" if best is None else f"{best[1] % 65535 + 1:04X}")
    assert signed(M) == -1
    return "".join(out)


def test_fingerprints_against_plain_sampling(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["a", "b", "the", "of", f"w{rng.randint(0, 30)}"]) for _ in range(rng.choice([0, 1, 2, 5, 60, 300]))) for i in range(40)}
    texts |= {100: None, 101: "A  a\n\nB\tb a", 102: "é日本 é", 103: texts[7], 104: "x"}
    want = edits(list(texts.items()))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got) == set(texts)
    share = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / fingerprints.SLOTS
    for i, (text, edited, following) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(text), plain_fingerprint(edited))
        assert r["near_edited"] == share(plain_fingerprint(text), plain_fingerprint(edited)) and r["near_next"] == share(plain_fingerprint(text), plain_fingerprint(following))
    assert got[7]["fingerprint"] == got[103]["fingerprint"] and got[104]["near_edited"] == 1


def test_likeness_estimates_generalised_jaccard(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = edits([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in queries.op11_weighted_sampling(spark, small).collect()}
    errors = [(got[i]["near_edited"] - jaccard(t, e), got[i]["near_next"] - jaccard(t, n)) for i, (t, e, n) in want.items()]
    assert len(got) == len(want) == docs.count()
    for side in zip(*errors, strict=True):  # an unbiased estimate of 64 draws
        assert abs(np.mean(side)) < 0.015 and np.sqrt(np.mean(np.square(side))) < 0.075


def test_tables_of_fingerprints_hold_bytes(spark, monkeypatch):
    """Tables on disk hold hex digits as bytes; the result spells them."""
    tables = {}

    def noted(df, label, plain=fingerprints.materialize):
        tables[label] = dict(df.dtypes)
        return plain(df, label)

    monkeypatch.setattr(fingerprints, "materialize", noted)
    got = fingerprints.fingerprints(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"))
    hexed = ("edited_sha256", "fingerprint", "edited_fingerprint")
    assert all(tables["signatures"][c] == "binary" and dict(got.dtypes)[c] == "string" for c in hexed)
    assert all(len(r[c]) == n for r in got.collect() for c, n in zip(hexed, (64, 256, 256), strict=True))


def test_fingerprints_on_odd_rows(spark):
    rows = fingerprints.fingerprints(odd_docs(spark)).collect()
    assert len(rows) == 10 and sum(r["doc_id"] is None for r in rows) == 1
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == by[7][0]["fingerprint"] == "0000" * fingerprints.SLOTS and by[1][0]["near_next"] == 1
    assert len(by[5]) == 2 and by[5][0] == by[5][1] and by[3][0]["fingerprint"] == by[4][0]["fingerprint"] and by[3][0]["near_next"] == 1
    assert fingerprints.fingerprints(empty_docs(spark)).count() == 0
    one = fingerprints.fingerprints(odd_docs(spark).where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"ein ein ").hexdigest()


# tokenizer alignment -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    p = pytest.importorskip("public_tokenizers")
    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def plain_alignment(rows, paths):
    """Both token lists walked with two pointers, all links of all groups counted."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_side.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for i, text in rows:
        got = a_side.encode(" " + (text or ""), add_special_tokens=False)
        a = [(t, len(bytes(chars[c] for c in s))) for t, s in zip(got.ids, got.tokens, strict=True)]
        b = [(t, len(piece(t))) for t in b_side.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes(chars[c] for c in s) for s in got.tokens) != want or b"".join(piece(t) for t, _ in b) != want:
            out.append((i, 0, 0, [], Counter()))
            continue
        groups, own_a, own_b, at_a, at_b, x, y = [], [], [], 0, 0, 0, 0
        while x < len(a) or y < len(b):
            if at_a <= at_b and x < len(a):
                own_a.append(a[x][0])
                at_a, x = at_a + a[x][1], x + 1
            else:
                own_b.append(b[y][0])
                at_b, y = at_b + b[y][1], y + 1
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        out.append((i, len(a), len(b), groups, Counter((p, q) for u, v in groups for p in u for q in v)))
    held = Counter(p for *_, links in out for p in links)
    best, best_b = defaultdict(int), defaultdict(int)
    for (p, q), n in held.items():
        best[p], best_b[q] = max(best[p], n), max(best_b[q], n)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g).encode()).hexdigest() if g else ""
    return sorted(((i, n, m, len(g), sum(c.values()), sum(k for p, k in c.items() if held[p] == best[p[0]]), sum(k for p, k in c.items() if held[p] == best_b[p[1]]), sum(k * held[p] for p, k in c.items()), digest(g)) for i, n, m, g, c in out), key=repr)


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_alignment_against_two_pointers(spark, paths, block):
    rng = random.Random(9)
    texts = ["", " ", "  ", "a", "▁", "the▁ the", "<s> </s> <0x0A> <|endoftext|>", "\0a \0", "x" * 700, "日本語" * 60, "\n\n a\tb", "🙂🙂 é", "á", None, " " * 80 + "x" + " " * 33]
    texts += ["".join(rng.choice("ab cde  \n\t<s>é中文字 the of 🙂ñ") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows = [(2**60 + i if i % 40 else None, t) for i, t in enumerate(texts)] + [(5, "same row"), (5, "same row")]
    got = crosstoken.alignment(spark.createDataFrame(rows, "doc_id long, text string"), *paths, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_alignment(rows, paths)


def test_alignment_query(spark, small, paths):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_token_alignment(spark, small).collect()), key=repr) == plain_alignment(rows, paths)


def test_alignment_on_odd_rows(spark, paths):
    rows = odd_docs(spark)
    got = crosstoken.alignment(rows, *paths)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_alignment([(r["doc_id"], r["text"]) for r in rows.collect()], paths)
    assert crosstoken.alignment(empty_docs(spark), *paths).count() == 0


def test_alignment_encodes_a_word_once(paths, monkeypatch):
    """Texts of known words are put together from these; places where words touch oddly change nothing."""
    rng, words = random.Random(4), crosstoken.Words(crosstoken.Tokens(*paths))
    seen, real = [], crosstoken.Tokens.encode
    monkeypatch.setattr(crosstoken.Tokens, "encode", lambda self, texts: seen.extend(texts) or real(self, texts))
    texts = [" ".join(rng.choice(["the", "of", "it's", "naïve", "a\nb", "x.", "(1)"]) for _ in range(60)) for _ in range(50)]
    assert words.tokens.by_words and len(words.split(texts)) == 50
    assert sum(map(len, seen)) < 100 < sum(map(len, texts)) / 50
    bits = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "▁", "中", "\u0301", "\u00a0", "\u3000", "\x85", "'s", "<s>", "\0", "…"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["\na", " \na", "a \nb", "a\t", "a\t b", "a b\n"]
    split = words.split(texts)
    got = ["".join(words.parts.spelled[k] for k in own) for own in split]
    plain = crosstoken.Words(words.tokens)
    words.tokens.by_words = False
    alone = plain.split(texts)
    assert got == ["".join(plain.parts.spelled[k] for k in own) for own in alone] and sum(map(bool, got)) > 1000


# whitening ---------------------------------------------------------------------------------


def check_whitening(got, vectors, most=8):
    """Sums as Python integers; components as eigenvectors of the covariance."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(vectors, x, strict=True)}
    y = np.array([[float(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    whole = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == n * min(most, d)
    w = y @ basis[:, :most]
    for k in range(min(most, d)):
        apart = min(abs(values[k] - values[j]) for j in range(d) if j != k) / values[0] if d > 1 else 1
        mine = np.array([whole[i, k + 1]["whitened"] for i, _ in vectors])
        if apart > 1e-6:
            want = w[:, k] / np.sqrt(values[k])
            assert np.abs(mine - want).max() < 1e-6 or np.abs(mine + want).max() < 1e-6
        assert all(int(whole[i, k + 1]["deviation"]) == exact[i] and whole[i, k + 1]["n"] == n for i, _ in vectors)
        assert abs(whole[vectors[0][0], k + 1]["explained"] - values[k] / values.sum()) <= 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_query(spark, small):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, small).collect(), vectors)


def test_whitening_of_correlated_vectors(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 5)) @ np.diag([100, 30, 3, 1, 0.05]) @ rng.normal(size=(5, 5))
    vectors = [(int(i), [float(c) for c in v]) for i, v in enumerate(data)]
    check_whitening(whiten.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(40)).collect(), vectors)


@pytest.mark.parametrize("rows", [1, 3, 7, 40])
def test_jacobi_rotations(rows):
    rng = np.random.default_rng(rows)
    r = rng.normal(size=(rows, 7)) * 10.0 ** -np.arange(7)
    lengths, v = whiten.jacobi_svd(r)
    assert np.abs(v.T @ v - np.eye(7)).max() < 1e-13 and (np.diff(lengths) <= 0).all()
    want = np.concatenate([np.linalg.svd(r, compute_uv=False), np.zeros(max(0, 7 - rows))])
    assert np.allclose(lengths, want, rtol=1e-10, atol=1e-14)
    pairs = [(int(a), int(b)) for p, q in whiten.rounds_of_pairs(7) for a, b in zip(p, q, strict=True)]
    assert len(pairs) == len({frozenset(p) for p in pairs}) == 21


def test_whitening_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [4.0, 4.0]), (10, [1e300, 0.0])]
    wide = spark.createDataFrame([(i, v, 1, 2, "x", "r") for i, v in rows], "vec_id long, embedding array<double>, n int, id long, x string, r string")
    got = whiten.whitened(wide).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 0, 1, 1, 1, 1, 2, 2, 9, 9] and {r["n"] for r in got} == {5}
    assert got[0]["identity_error"] < 1e-12
    assert whiten.whitened(wide.limit(0)).count() == 0 and whiten.whitened(wide.where("vec_id = 3")).count() == 0
    same = whiten.whitened(wide.where("vec_id = 1")).collect()  # no variance at all
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = whiten.whitened(wide.where("vec_id in (1, 2)")).collect()  # one direction only
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-12


def test_whitening_far_from_zero_and_beyond_64_bits(spark):
    """Squares of n * x - sum that 64 bits cannot hold are exact too."""
    rng = random.Random(4)
    vectors = [(i, [float(rng.randint(-(10**11), 10**11)) for _ in range(3)]) for i in range(50)]
    got = whiten.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert max(int(r["deviation"]) for r in got) > 1 << 63
    check_whitening(got, vectors)
