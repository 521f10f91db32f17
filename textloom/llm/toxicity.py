"""Toxic passages: maximal scoring segments of token log-odds, calibrated by extreme values.

Weights are log-odds ratios with an informative Dirichlet prior, of words and
of word beginnings, kept where they are significantly on the toxic side. A
linear scan finds every maximal scoring segment of a text; a segment counts by
its score in units of the null distribution less the logarithm of the text's
length, as the theory of extreme segment scores has it, and a Gumbel law fitted
on clean labelled texts turns the best total into a chance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bound_batches, materialize
from textloom.llm.rules import SAMPLE, label_sample

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are units besides whole words ("=word").
STARTS = range(4, 9)
#: Words whose weights a worker remembers; beyond it the memory is emptied.
REMEMBERED = 200_000


def units(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in STARTS if n <= len(word))]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = Counter(WORD.findall((text or "").lower()))
            mine: Counter = Counter()
            for w, n in words.items():
                for u in units(w):
                    mine[u] += n
            count[int(label)].update(mine)
            docs[int(label)].update(mine.keys())
        keys = list(count[0].keys() | count[1].keys())
        yield pd.DataFrame({"unit": pd.Series(keys, dtype=object), "toxic": [count[1][k] for k in keys], "clean": [count[0][k] for k in keys], "toxic_docs": [docs[1][k] for k in keys], "clean_docs": [docs[0][k] for k in keys]})


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by one linear scan."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before = i, total
        total += s
        after = total
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, before, after))
    return [(a, b, y - x) for a, b, x, y in found]


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    other: float = -0.1  # a word outside the lexicon
    unit: float = 1.0  # score units of the null distribution
    place: float = 0.0  # Gumbel law of the null totals
    width: float = 1.0
    slope: float = 1.0  # logistic calibration of the standardised totals
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        return max((self.weights[u] for u in units(w) if u in self.weights), default=self.other)

    def passages(self, text: str | None, significant: bool = True) -> list[tuple[int, int, float]]:
        """(first word, end, excess) of the segments whose score exceeds what chance gives in so long a text."""
        words = WORD.findall((text or "").lower())
        if not words:
            return []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, other = self.known, self.other
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        weights = np.fromiter(map(known.__getitem__, words), float, len(words))
        hits = np.flatnonzero(weights > 0)
        if not len(hits):
            return []
        # the words between hits are one step each
        steps: list[float] = []
        for gap, h in zip(np.diff(hits, prepend=hits[0]) - 1, hits, strict=True):
            if steps:
                steps.append(float(gap) * other)
            steps.append(float(weights[h]))
        low = np.log(len(words) + 1.0) if significant else 0.0
        return [(int(hits[a // 2]), int(hits[(b - 1) // 2]) + 1, s * self.unit - low) for a, b, s in segments(steps) if s * self.unit > low]

    def total(self, text: str | None) -> float:
        return float(sum(x for _, _, x in self.passages(text)))

    def standard(self, total: float) -> float:
        """How rare the total is without toxicity: -ln P(null total as great) under the Gumbel law, at most 12."""
        z = np.exp(-min(700.0, max(-700.0, (total - self.place) / self.width)))
        return float(min(12.0, -np.log(max(1e-300, -np.expm1(-z)))))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.standard(self.total(text)) + self.shift, -30, 30))))


def _gumbel(totals: np.ndarray) -> tuple[float, float]:
    """Place and width by moments, the uppermost hundredth (wrong labels) cut to the next; texts without a passage total 0."""
    if not len(totals):
        return 0.0, 1.0
    totals = np.minimum(totals, np.quantile(totals, 0.99))
    width = max(0.25, float(totals.std()) * 6**0.5 / np.pi)
    return float(totals.mean()) - 0.5772156649 * width, width


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, not negative, and shift of a lightly penalised logistic regression on one variable.

    Newton steps are halved until the loss falls: whole ones overshoot where the
    classes lie apart. The loss is convex, so what they reach is its minimum.
    """
    def loss(w: float, b: float) -> float:
        z = w * x + b
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.05 * w * w)

    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(base / (1 - base)))
    w, b = 0.0, start
    now = loss(w, b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -700, 700)))
        r = p * (1 - p)
        grad = np.array([((p - y) * x).sum() + 0.1 * w, (p - y).sum()])
        hess = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-9]])
        dw, db = (float(v) for v in np.linalg.solve(hess, grad))
        size = 1.0
        while size > 1e-9 and not loss(w - size * dw, b - size * db) < now:
            size /= 2
        if size <= 1e-9:
            break
        w, b = w - size * dw, b - size * db
        now, before = loss(w, b), now
        if before - now < 1e-10 * (1 + now):
            break
    return (w, b) if w >= 0 else (0.0, start)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = SAMPLE, prior: float = 100_000.0, z_least: float = 3.5, z_docs: float = 2.5, docs_least: float = 0.02) -> ToxicModel:
    """Fit on at most ``bound`` labelled rows, chosen by hash of their id.

    Units are counted on the executors; those that are significantly toxic by
    their number (``z_least``) and by the number of texts that have them (``z_docs``) come to
    the driver, as many as the sample, which is bounded, has. A unit has to occur
    in the share ``docs_least`` of the different toxic texts and in four of them:
    with rarer ones, names and the like of a few texts, the held-out accuracy
    falls. Copies of a text count once. Of rows that share an id, that of the
    least text is taken; null texts count as empty; null ids and labels are no
    sample. Without both labels the model has no lexicon and every text the
    score of the base rate. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    sample = label_sample(labels, id_col, label_col, train, bound)
    rows = docs.select(F.col(id_col).alias("label_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "label_id")
    # documents are read once for the fit; the sample that stays is bounded
    rows = rows.groupBy("label_id").agg(F.min("text").alias("text"), (F.first("label") > 0).cast("int").alias("label"))
    rows = materialize(rows.groupBy("text").agg(F.max("label").alias("label")), "toxic-sample")
    texts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(texts) < 2:
        return ToxicModel(shift=0.0 if not texts else (6.0 if 1 in texts else -6.0), slope=0.0)
    counts = rows.mapInPandas(_counted, "unit string, toxic long, clean long, toxic_docs long, clean_docs long").groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_docs", "clean_docs")])
    counts = materialize(counts, "toxic-units")
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    y1, y0 = F.col("toxic").cast("double"), F.col("clean").cast("double")
    a = F.lit(prior) * (y1 + y0) / F.lit(max(1.0, n1 + n0)) + F.lit(0.01)
    # a unit may be all there is, so that what is left of a class may be next to nothing
    odds = F.log((y1 + a) / F.greatest(F.lit(0.01), F.lit(n1 + prior) - y1 - a)) - F.log((y0 + a) / F.greatest(F.lit(0.01), F.lit(n0 + prior) - y0 - a))
    z = odds / F.sqrt(F.lit(1.0) / (y1 + a) + F.lit(1.0) / (y0 + a))
    d1, d0 = F.col("toxic_docs") + F.lit(0.5), F.col("clean_docs") + F.lit(0.5)
    zd = (F.log(d1 / F.lit(float(texts[1]))) - F.log(d0 / F.lit(float(texts[0])))) / F.sqrt(1 / d1 + 1 / d0)
    lexicon = counts.where((F.col("toxic_docs") >= max(4.0, docs_least * texts[1])) & (zd >= z_docs)).withColumn("odds", odds).where((z >= z_least) & (F.col("odds") > 1.0)).collect()
    model = ToxicModel({r["unit"]: float(min(8.0, r["odds"])) for r in lexicon})
    # weights that words of either class get, in tenths: a histogram of bounded size
    seen = rows.mapInPandas(_profiled(model), "label int, tenths int, n long").groupBy("label", "tenths").agg(F.sum("n").alias("n")).collect()
    words = {k: sum(r["n"] for r in seen if r["label"] == k) + 1.0 for k in (0, 1)}
    share = {k: (sum(r["n"] for r in seen if r["label"] == k and r["tenths"] > 0) + 0.5) / words[k] for k in (0, 1)}
    model.other = min(-0.02, float(np.log((1 - min(0.5, share[1])) / (1 - min(0.4, share[0])))))
    model.unit = _null_unit({r["tenths"] / 10: r["n"] / words[0] for r in seen if r["label"] == 0 and r["tenths"] > 0}, model.other)
    got = rows.mapInPandas(_totalled(model), "label int, total double").toPandas()
    clean = got.loc[got["label"] == 0, "total"].to_numpy()
    model.place, model.width = _gumbel(clean)
    x = np.array([model.standard(t) for t in got["total"]])
    model.slope, model.shift = _logistic(x, got["label"].to_numpy(float))
    return model


def _null_unit(shares: dict[float, float], other: float) -> float:
    """The positive root of E[exp(unit * weight)] = 1 over words of clean texts; shares: of the positive weights."""
    rest = 1 - sum(shares.values())
    if not shares or sum(w * s for w, s in shares.items()) + rest * other >= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if sum(s * np.exp(mid * w) for w, s in shares.items()) + rest * np.exp(mid * other) > 1:
            high = mid
        else:
            low = mid
    return max(0.05, low)


def _profiled(model: ToxicModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for w, n in Counter(WORD.findall(text.lower())).items():
                    seen[int(label), max(0, round(10 * model.word(w)))] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["label", "tenths", "n"])

    return run


def _totalled(model: ToxicModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "total": [model.total(t) for t in batch["text"]]})

    return run


def toxicity_scores(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with ``score`` and ``passages`` (first word, end, excess): one narrow pass.

    Null and empty texts have no passage and the score that goes with it;
    repeated rows and null ids stay; columns of these names are replaced.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("score double, passages array<struct<start: int, end: int, excess: double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.passages(t) for t in batch]
            totals = [float(sum(x for _, _, x in f)) for f in found]
            scores = [float(1 / (1 + np.exp(-np.clip(model.slope * model.standard(t) + model.shift, -30, 30)))) for t in totals]
            yield pd.DataFrame({"score": scores, "passages": [[{"start": a, "end": b, "excess": x} for a, b, x in f] for f in found]})

    kept = [docs[c] for c in docs.columns if c not in ("score", "passages", "found")]
    return docs.select(*kept, scored(F.coalesce(docs[text_col], F.lit(""))).alias("found")).select("*", "found.score", "found.passages").drop("found")
