"""Alignment of two tokenizers: common token ends cut a text into groups, whose tokens are linked.

A task cuts texts where neither tokenizer's tokens cross, encodes each different
part twice and merges the cumulative ends of both token lists; texts are put
together from their parts. It writes each block of documents as one row: its
links as indices into the block's list of different id pairs. Spark counts in how
many documents a pair is linked from the blocks' own counts, so that a pair
travels once a block and not once a document, finds each id's highest count, and
sends both back to the blocks, where the documents' figures are summed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bound_batches, materialize, settled, trim

#: UTF-8 bytes of texts after which a block is closed.
BLOCK_BYTES = 2 << 20
#: Texts that are encoded at once.
AT_ONCE = 32
#: Pairs of the words that a worker knows before it begins anew, words that are encoded as one text, and the word before them.
KNOWN, JOINED, ANCHOR = 1_000_000, 256, "a"
#: Words of texts cut at blanks and before line feeds, places between such words at blanks, and what lies between those.
WORD, CUT, CLEAN = re.compile(r"\n?[\w!-~](?:.*[\w!-~])?\Z", re.S), re.compile(r"(?<=[\w!-~]) (?=[\w!-~])"), re.compile(r"[\w!-~](?:[^▁]*[\w!-~])?\Z")
#: Bits of a pair that hold the second id.
SHIFT = 32
BLOCK = "block string, ids binary, nulls binary, figures binary, hashes binary, pairs binary, held binary, starts binary, at binary, times binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The byte of each character of byte-level tokens: printable Latin-1 stands for itself, the rest from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        chars = byte_characters()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.spelling = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.by_words = self._by_words(path_a, path_b)

    def _by_words(self, path_a: str, path_b: str) -> bool:
        """Whether both sides encode words apart: A's pattern begins anew at a blank or line feed between other characters, and no piece of B goes on there."""
        from sentencepiece import sentencepiece_model_pb2

        with open(path_a, encoding="utf-8") as f:
            a = json.load(f)
        rule, added = a.get("pre_tokenizer") or {}, a.get("added_tokens") or []
        plain = a["model"].get("type") == "BPE" and not a.get("normalizer") and not a["model"].get("dropout") and all(t["special"] for t in added)
        pattern = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        b = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            b.ParseFromString(f.read())
        norm, kinds = b.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        same = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        bpe = b.trainer_spec.model_type == b.trainer_spec.BPE and b.trainer_spec.byte_fallback and not b.trainer_spec.treat_whitespace_as_suffix
        whole = all(x.type != kinds.USER_DEFINED and (x.type != kinds.NORMAL or ("\n" not in x.piece and ("▁" not in x.piece[1:] or not x.piece.strip("▁")))) for x in b.pieces)
        return bool(plain and pattern and same and bpe and whole)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; two empty lists where a side does not give back blank + text byte by byte."""
        out = []
        for k in range(0, len(texts), AT_ONCE):
            part = texts[k : k + AT_ONCE]
            for text, a, b in zip(part, self.a.encode_batch_fast([" " + t for t in part], add_special_tokens=False), self.b.encode(part, num_threads=1), strict=True):
                want, ids = (" " + text).encode(errors="replace"), a.ids
                same = bool(text) and b"".join(map(self.bytes_a.__getitem__, ids)) == want == b"".join(map(self.bytes_b.__getitem__, b))
                out.append((ids, b) if same else ([], []))
        return out


def merged_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each common value of two ascending lists its place in either."""
    at = np.searchsorted(b, a)
    hit = at < len(b)
    hit[hit] = b[at[hit]] == a[hit]
    return np.flatnonzero(hit), at[hit]


def spelled(tokens: Tokens, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """Groups as ``a1,a2|b1;a3|b2,b3;``, by token. cut_a, cut_b: places of the groups' last tokens; group_a, group_b: each token's group."""
    n = len(tokens.spelling) // 3  # "id,", "id|" and "id;" of every id
    a, b = a.copy(), b.copy()
    a[cut_a] += n
    b[cut_b] += 2 * n
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + (cut_b - np.diff(cut_b, prepend=-1) + 1)[group_a]] = a
    codes[np.arange(len(b)) + (cut_a + 1)[group_b]] = b
    return list(map(tokens.spelling.__getitem__, codes.tolist()))


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of the different ids of each group, by group."""
    key, times = np.unique(group << SHIFT | ids, return_counts=True)
    return key >> SHIFT, key & ((1 << SHIFT) - 1), times


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _summed_by(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sums of their times."""
    if not len(key):
        return key, times
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[fresh], np.add.reduceat(times[order], fresh)


class Parts:
    """Parts of texts that are aligned once: figures (n_a, n_b, n_groups, n_links), spelled groups, and the linked pairs with their times, part by part."""

    def __init__(self):
        self.figures, self.spelled = np.zeros((0, 4), np.int64), []
        self.first, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, tokens: Tokens, a: np.ndarray, b: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> None:
        """Align ids of both sides. ends: bytes after which each part ends, where tokens of both sides end too; kept: the parts to be added.

        Two tokens are linked if their byte ranges share a group. A group with
        many tokens is multiplied out over its different ids only.
        """
        if not len(ends):
            return
        end_a, end_b = np.cumsum(tokens.len_a[a]), np.cumsum(tokens.len_b[b])
        cut_a, cut_b = merged_ends(end_a, end_b)
        size_a, size_b = (np.diff(c, prepend=-1) for c in (cut_a, cut_b))
        group_a, group_b = (np.repeat(np.arange(len(size)), size) for size in (size_a, size_b))
        if not np.isin(ends, end_a[cut_a]).all():
            raise ValueError("a token goes on beyond its part")
        owner = np.searchsorted(ends, end_a[cut_a])  # of each group
        to_a, to_b, to = (np.concatenate([[0], np.searchsorted(e, ends, "right")]) for e in (end_a, end_b, end_a[cut_a]))
        links = np.concatenate([[0], np.cumsum(size_a * size_b)])[to]
        text, at = spelled(tokens, a, b, cut_a, cut_b, group_a, group_b), (to_a + to_b).tolist()
        (ga, ia, ta), (gb, ib, tb) = _counted(group_a, a), _counted(group_b, b)
        many = np.bincount(gb, minlength=len(cut_a))
        rep = many[ga]
        right = _ranges((np.cumsum(many) - many)[ga], rep)
        pairs, place = np.unique(np.repeat(ia, rep) << SHIFT | ib[right], return_inverse=True)
        key, times = _summed_by(np.repeat(owner[ga], rep) * len(pairs) + place, np.repeat(ta, rep) * tb[right])
        part, place = np.divmod(key, len(pairs))
        use, count = kept[part], np.bincount(part, minlength=len(ends))[kept]
        self.figures = np.concatenate([self.figures, np.stack([np.diff(x) for x in (to_a, to_b, to, links)], axis=1)[kept]])
        self.spelled += ["".join(text[at[k] : at[k + 1]]) for k in np.flatnonzero(kept).tolist()]
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])
        self.pair, self.times = np.concatenate([self.pair, pairs[place[use]]]), np.concatenate([self.times, times[use]])


class Words:
    """The parts that texts consist of, with what is known of them, until they have over KNOWN pairs.

    A part is a blank or line feed between characters of EDGE with what follows
    up to the next such place. Neither side's tokens cross these places or
    depend on what lies beyond, so that a part is aligned once for all texts.
    """

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.parts, self.known = Parts(), {}

    def split(self, texts: list[str]) -> list[list[int]]:
        """The places in ``parts`` of each text's parts; none where a side does not give back the text."""
        if len(self.parts.pair) > KNOWN:
            self.forget()
        words: list[list[str] | None] = [None] * len(texts)
        if self.tokens.by_words:
            words = [None if "▁" in t else t.replace("\n", " \n").split(" ") for t in texts]
            # what is not known and no word between two edges makes the text one that is cut at blanks only
            new = set().union(*(w for w in words if w)).difference(self.known)
            fit = set(filter(WORD.match, new))
            odd = new - fit
            for k, w in enumerate(words):
                if w is not None and not odd.isdisjoint(w):
                    words[k] = None
            cut = {k: CUT.split(t) if "▁" not in t else [t] for k, t in enumerate(texts) if words[k] is None}
            fit |= {c for parts in cut.values() for c in parts if c not in self.known and CLEAN.match(c)}
            self._learn_words(sorted(fit))
        else:
            cut = {k: [t] for k, t in enumerate(texts)}
        alone = {c for parts in cut.values() for c in parts if not (self.tokens.by_words and CLEAN.match(c))}
        own = self._learn(sorted(alone))
        out, whole = [], []
        for k, w in enumerate(words):
            at = list(map(self.known.get, w)) if w is not None else [own[c] if c in own else self.known.get(c) for c in cut[k]]
            if None in at:
                whole.append(k)
            out.append(at)
        # a part is not given back alone, though the whole text might be
        own = self._learn(sorted({texts[k] for k in whole}))
        for k in whole:
            out[k] = [own[texts[k]]] if own[texts[k]] is not None else []
        return out

    def _learn(self, texts: list[str]) -> dict[str, int | None]:
        """Places of texts, each encoded as it is, None where a side does not give it back."""
        ids = self.tokens.encode(texts)
        good = [k for k, (a, _) in enumerate(ids) if a]
        start = len(self.parts.spelled)
        sides = [np.concatenate([np.array(ids[k][s], np.int64) for k in good] + [np.zeros(0, np.int64)]).astype(np.int64) for s in (0, 1)]
        self.parts.add(self.tokens, *sides, np.cumsum([1 + len(texts[k].encode()) for k in good]), np.ones(len(good), bool))
        return dict.fromkeys(texts) | {texts[k]: start + i for i, k in enumerate(good)}

    def _learn_words(self, words: list[str], at_once: int = JOINED) -> None:
        """Let words be known, many of them joined to a text behind a first word that is not looked at; those that a side does not give back stay unknown."""
        lists = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        ids = self.tokens.encode([ANCHOR + "".join(w if w[0] == "\n" else " " + w for w in part) for part in lists])
        a, b, sizes, kept, names, again = [], [], [], [], [], []
        for part, (own_a, own_b) in zip(lists, ids, strict=True):
            if not own_a:
                again += part if len(part) > 1 else []
                continue
            a.append(np.array(own_a, np.int64))
            b.append(np.array(own_b, np.int64))
            sizes += [1 + len(ANCHOR), *(len(w.encode()) + (w[0] != "\n") for w in part)]
            kept += [False, *[True] * len(part)]
            names += part
        start = len(self.parts.spelled)
        if a:
            self.parts.add(self.tokens, np.concatenate(a), np.concatenate(b), np.cumsum(sizes), np.array(kept))
        self.known |= zip(names, range(start, start + len(names)), strict=True)
        if again:
            self._learn_words(again, 1)


def aligned(words: Words, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text n_a, n_b, n_groups, n_links and the hash of its groups; then the different pairs (a << SHIFT | b), the texts that hold each, and by text the pairs (start, index, times)."""
    split = words.split([t or "" for t in texts])
    parts, spelling = words.parts, words.parts.spelled
    hashes = [hashlib.sha256("".join(map(spelling.__getitem__, own))[:-1].encode()).hexdigest() if own else "" for own in split]
    count = np.array([len(own) for own in split], np.int64)
    flat = np.fromiter((k for own in split for k in own), np.int64, count.sum())
    bounds = np.concatenate([[0], np.cumsum(count)])
    figures = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(parts.figures[flat], axis=0)])[bounds], axis=0)
    # each text's different parts, then the pairs of the parts of all texts, numbered
    held = max(1, len(spelling))
    key, many = np.unique(np.repeat(np.arange(len(texts)), count) * held + flat, return_counts=True)
    doc, part = np.divmod(key, held)
    used, part = np.unique(part, return_inverse=True)
    size = parts.first[used + 1] - parts.first[used]
    own = _ranges(parts.first[used], size)
    pairs, number = np.unique(parts.pair[own], return_inverse=True)
    rep = size[part]
    at = _ranges((np.cumsum(size) - size)[part], rep)
    key, times = _summed_by(np.repeat(doc, rep) * max(1, len(pairs)) + number[at], parts.times[own][at] * np.repeat(many, rep))
    doc, at = np.divmod(key, max(1, len(pairs)))
    return figures, hashes, pairs, np.bincount(at, minlength=len(pairs)), np.searchsorted(doc, np.arange(len(texts) + 1)), at, times


def _aligned_blocks(path_a: str, path_b: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ids, texts, size = Words(Tokens(path_a, path_b)), [], [], 0

        def block() -> pd.DataFrame:
            figures, hashes, pairs, held, starts, at, times = aligned(words, texts)
            nulls = np.array([i is None for i in ids])
            name = hashlib.sha256("".join(map(str, ids)).encode() + b"".join(h.encode() for h in hashes)).hexdigest()
            row = {"block": f"{name[:24]}-{os.urandom(6).hex()}", "ids": np.array([i or 0 for i in ids], np.int64), "nulls": nulls, "figures": figures, "pairs": pairs, "held": held.astype(np.int32), "starts": starts, "at": at.astype(np.int32), "times": times}
            packed = {k: [v.tobytes() if isinstance(v, np.ndarray) else v] for k, v in row.items()} | {"hashes": ["\n".join(hashes).encode()]}
            return pd.DataFrame(packed)[[f.split()[0] for f in BLOCK.split(", ")]]

        for batch in batches:
            for i, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if i is None else int(i))
                texts.append(text)
                size += len(text or "")
                if size >= limit:
                    yield block()
                    ids, texts, size = [], [], 0
                    trim()
        if ids:
            yield block()
        trim()

    return run


def _block_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, pairs, held in zip(batch["block"], batch["pairs"], batch["held"], strict=True):
            pair = np.frombuffer(pairs, np.int64)
            yield pd.DataFrame({"block": block, "a": (pair >> SHIFT).astype(np.int32), "b": (pair & ((1 << SHIFT) - 1)).astype(np.int32), "held": np.frombuffer(held, np.int32)})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Figures of each document of a block, from the counts of the block's pairs in the order of the pairs."""
    for batch in batches:
        for r in batch.itertuples():
            ids, nulls, starts = np.frombuffer(r.ids, np.int64), np.frombuffer(r.nulls, bool), np.frombuffer(r.starts, np.int64)
            figures, at, times = np.frombuffer(r.figures, np.int64).reshape(-1, 4), np.frombuffer(r.at, np.int32), np.frombuffer(r.times, np.int64)
            count, best = np.array(r.counts if r.counts is not None else [], np.int64), np.array(r.bests if r.bests is not None else [], np.int64)
            total = lambda w: np.diff(np.concatenate([[0], np.cumsum(w)])[starts])  # noqa: B023, E731
            links = {"n_best": times * (best[at] & 1), "n_best_b": times * (best[at] >> 1), "count_sum": times * count[at]}
            sums = {k: total(v) for k, v in links.items()}
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_a": figures[:, 0], "n_b": figures[:, 1], "n_groups": figures[:, 2], "n_links": figures[:, 3], **sums, "groups_sha256": r.hashes.decode().split("\n")}).assign(doc_id=lambda t: t["doc_id"].mask(nulls))  # noqa: B023


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, a, b, held) of a table of blocks, and of each pair count, the documents that hold it, and whether it is the highest of its a and of its b."""
    rows = blocks.select("block", "pairs", "held").mapInPandas(_block_pairs, "block string, a int, b int, held int")
    counts = rows.groupBy("a", "b").agg(F.sum("held").alias("count"))
    return rows, counts


def alignment(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256 for each row of docs(doc_id, text).

    a: a byte-level tokenizer file, given blank + text; b: a sentencepiece model
    that adds the blank itself; neither adds special tokens, and their strings
    in texts are plain text. Groups lie between places where tokens of both
    sides end; every a and every b of a group are linked. A pair's count is the
    number of rows that hold it linked. n_best: links whose count is the highest
    of their a id, ties included; n_best_b: of their b id; count_sum: the sum
    of the counts over links.

    Texts that are null or empty, or that a side does not give back byte by
    byte, have no tokens: zeros and an empty hash. Repeated rows and repeated
    or null ids are documents of their own. An empty table gives no rows. The
    highest counts have a row for each id of a vocabulary at most.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    return settled(spark, lambda: _alignment(docs, path_a, path_b, block_bytes), "aligned")


def _alignment(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas makes whole numbers beside nulls doubles
    blocks = materialize(texts.mapInPandas(_aligned_blocks(path_a, path_b, block_bytes), BLOCK), "links")
    rows, counts = pair_counts(blocks)
    counts = materialize(counts, "pairs")
    high = lambda side: F.broadcast(counts.groupBy(side).agg(F.max("count").alias(f"high_{side}")))  # noqa: E731  bounded by the vocabulary
    known = counts.join(high("a"), "a").join(high("b"), "b").select("a", "b", "count", ((F.col("count") == F.col("high_a")).cast("int") + F.lit(2) * (F.col("count") == F.col("high_b")).cast("int")).alias("best"))
    ordered = rows.select("block", "a", "b").join(known, ["a", "b"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("a", "b", "count", "best"))).alias("p"))
    sums = ordered.select("block", F.col("p.count").alias("counts"), F.col("p.best").alias("bests"))
    return blocks.drop("pairs", "held").join(sums, "block", "left").drop("block").mapInPandas(_summed, OUT)
