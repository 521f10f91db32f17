"""A second language detector: profiles of three-letter groups, learnt from texts whose language is known."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of a group; texts of a language that its profile is learnt from, and groups that it keeps.
GROUP, SAMPLE, KEPT = 3, 300, 20_000
#: What a group counts that a language has not shown.
UNSEEN = 0.5


def groups(text: str | None) -> Iterator[str]:
    """Every three letters of the lower-cased text with blanks collapsed and one at either end."""
    line = f" {' '.join((text or '').lower().split())} "
    return (line[i : i + GROUP] for i in range(len(line) - GROUP + 1))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for language, texts in batch.groupby("language")["text"]:
            seen = Counter(g for t in texts for g in groups(t))
            yield pd.DataFrame({"language": language, "gram": list(seen), "n": list(seen.values())})


def fit_profiles(docs: DataFrame, sample: int = SAMPLE, kept: int = KEPT) -> dict[str, dict[str, int]]:
    """Counts of the most frequent groups of each language, from ``sample`` texts of it at most, those of the least hash.

    docs: language, text. Texts without a language or "und" teach nothing. The
    profiles have ``kept`` groups a language at most, so that they fit a closure.
    """
    known = docs.select("language", "text").where(~F.coalesce("language", F.lit("")).isin("", "und") & F.col("text").isNotNull())
    first = F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("text"), "text"))
    rows = known.withColumn("r", first).where(F.col("r") <= sample).select("language", "text").mapInPandas(_counts, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, dict[str, int]] = {}
    for r in rows.withColumn("r", best).where(F.col("r") <= kept).collect():
        profiles.setdefault(r["language"], {})[r["gram"]] = r["n"]
    return profiles


def by_profiles(profiles: dict[str, dict[str, int]]) -> Callable[[str], tuple[str, float] | None]:
    """The language under which a text's groups are likeliest, the first name of equals, with its share of the likelihoods a group; None for texts without letters."""
    whole = {name: sum(p.values()) for name, p in profiles.items()}
    kinds = len(set().union(*profiles.values())) + 1 if profiles else 1
    logs = {name: {g: math.log((n + UNSEEN) / (whole[name] + UNSEEN * kinds)) for g, n in p.items()} for name, p in profiles.items()}
    rest = {name: math.log(UNSEEN / (whole[name] + UNSEEN * kinds)) for name in profiles}

    def detect(text: str) -> tuple[str, float] | None:
        seen = Counter(groups(text))
        n = sum(seen.values())
        if not profiles or not n or not any(c.isalpha() for g in seen for c in g):
            return None
        mean = {name: sum(k * logs[name].get(g, rest[name]) for g, k in seen.items()) / n for name in profiles}
        best = min(mean, key=lambda name: (-mean[name], name))
        return best, 1 / sum(math.exp(m - mean[best]) for m in mean.values())

    return detect
