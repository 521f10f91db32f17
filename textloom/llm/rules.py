"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on a bounded sample of labelled rows give the rules: every path
from a root is a conjunction of thresholds. A logistic regression with an L1
penalty chooses and weighs them, and the chosen ones become one Spark column
expression over the statistics, so scoring is a narrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bound_batches

#: Labelled rows that a fit sees at most, chosen by hash of their id.
SAMPLE = 20_000
_SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?")
_DIGITS = b"0123456789"
STATS = ("n_chars", "n_words", "word_length", "longest_word", "distinct_words", "repeated_next", "distinct_lines", "words_a_line", "upper_words", "title_words", "letter_words", "symbols", "digits", "bars", "shouts", "stops", "commas", "compressed")


def compressed_size(raw: bytes) -> int:
    """Bytes of raw when compressed, piece by piece."""
    packer, size = zlib.compressobj(1), 0
    for at in range(0, len(raw), 1 << 20):
        size += len(packer.compress(raw[at : at + (1 << 20)]))
    return size + len(packer.flush())


def text_stats(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATS; shares are of 0 where nothing is counted."""
    raw, words, lines = text.encode("utf-8", "surrogatepass"), text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    return (
        float(len(text)), float(len(words)), sum(map(len, words)) / w, float(max(map(len, words), default=0)), len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines), len(words) / len(lines), sum(map(str.isupper, words)) / w, sum(map(str.istitle, words)) / w,
        sum(map(str.isalpha, words)) / w, (len(raw) - len(raw.translate(None, _SYMBOLS))) / n, (len(raw) - len(raw.translate(None, _DIGITS))) / n,
        text.count("|") / w, text.count("!") / w, text.count(".") / w, text.count(",") / w, compressed_size(raw) / n,
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([text_stats(t or "") for t in batch], columns=list(STATS), dtype="float64")


def stats_column(text: Column) -> Column:
    """Struct of the statistics; null counts as the empty text."""
    return _stats(F.coalesce(text, F.lit("")))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold): all must hold


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Rule, np.ndarray, float]], np.ndarray]:
    """Rules of every node under the root, with the rows and the value of each; the step of each row."""
    step, nodes = np.zeros(len(grad)), []
    todo: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(grad)))]
    while todo:
        rule, rows = todo.pop()
        g, h = grad[rows], hess[rows]
        step[rows] = value = g.sum() / (h.sum() + 1.0)
        if rule:
            nodes.append((rule, rows, float(value)))
        if len(rule) == depth or len(rows) < 2 * least:
            continue
        best = (1e-6, -1, -1)
        for f in range(bins.shape[1]):
            k = len(cuts[f]) + 1
            b = bins[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, x, k))[:-1] for x in (g, h, None))
            fit = (ns >= least) & (len(rows) - ns >= least)
            if fit.any():
                gain = np.where(fit, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1), -1)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), f, at))
        if best[1] >= 0:
            _, f, at = best
            above = bins[rows, f] > at
            todo += [((*rule, (f, up, float(cuts[f][at]))), rows[above == up]) for up in (False, True)]
    return nodes, step


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient."""
    n, scale = len(y), np.maximum(x.std(0), 1e-3).astype(np.float32)
    mean = x.mean(0)
    z = (x - mean) / scale
    v = np.random.default_rng(0).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(30):  # largest eigenvalue, for the step
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.26 * float(np.linalg.norm(z.T @ (z @ v))) / n + 0.26)
    w, b, vw, vb, t = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(z.shape[1]), 0.0, 1.0
    vb = b
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ vw.astype(np.float32) + vb, -30, 30)))
        nw = vw - step * (z.T @ (p - y).astype(np.float32)) / n
        nb = vb - step * float((p - y).mean())
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    w = w / scale
    return w, b - float(w @ mean)


@dataclass
class RuleModel:
    """Weighted conjunctions over statistics; ``bias`` alone where there was nothing to learn from."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    stats: tuple[str, ...] = STATS

    def column(self, of: str = "stats") -> Column:
        """Score from 0 to 1 as a column expression over a struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for f, above, cut in rule:
                c = F.col(f"{of}.{self.stats[f]}")
                one = c > F.lit(cut) if above else c <= F.lit(cut)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))

    def describe(self) -> list[str]:
        """Rules in words, weightiest first."""
        return [f"{w:+.3f}  " + " and ".join(f"{self.stats[f]} {'>' if up else '<='} {cut:.4g}" for f, up, cut in r) for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, rate: float = 0.3, bins: int = 48) -> RuleModel:
    """Rules from boosted trees over x (rows by statistics), weighed by a lasso against y (0 or 1)."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(0.0 if len(y) == 0 else (6.0 if y[0] else -6.0))
    least = max(3, len(y) // 1000)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    logit, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        nodes, step = _tree(binned, cuts, y - p, p * (1 - p) + 1e-6, depth, least)
        logit += rate * step
        for rule, rows, _ in nodes:
            key = tuple(sorted(rule))
            if key not in found:
                found[key] = rows
        if np.abs(y - p).mean() < 1e-4:
            break
    rules, matrix = [], np.zeros((len(y), len(found)), np.float32)
    for k, (rule, rows) in enumerate(found.items()):
        rules.append(rule)
        matrix[rows, k] = 1
    weights, bias = _lasso(matrix, y.astype(np.float32), penalty)
    return RuleModel(bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def label_sample(labels: DataFrame, id_col: str, label_col: str, train: Column, bound: int) -> DataFrame:
    """(id, label) of at most bound training rows, chosen by hash of the id; of conflicting labels the greater."""
    ok = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train)
    one = ok.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    return one.orderBy(F.xxhash64(F.col("label_id").cast("string")), "label_id").limit(bound)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE) -> RuleModel:
    """Fit on at most ``bound`` labelled rows; the sample of ids, so bounded, is broadcast.

    Of rows that share an id, that of the least statistics is taken; null texts
    count as empty. Null ids and labels are no sample; without a row, or with
    one label only, the model has no rule. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    sample = label_sample(labels, id_col, label_col, train, bound)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id")
    got = rows.groupBy("label_id").agg(F.first("label").alias("label"), F.min(stats_column(F.col("text"))).alias("stats")).select("label_id", "label", "stats.*").toPandas()
    got = got.sort_values("label_id", kind="stable")
    return fit_rules(got[list(STATS)].to_numpy(float), (got["label"].to_numpy() > 0).astype(float))


def quality_scores(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with a column ``score``: one narrow pass; null and empty texts are scored as empty ones.

    Repeated rows and null ids stay; a column named score or stats of docs is
    replaced. An empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "stats")]
    return docs.select(*[docs[c] for c in kept], stats_column(docs[text_col]).alias("stats")).withColumn("score", model.column()).drop("stats")
