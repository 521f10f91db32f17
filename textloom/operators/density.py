"""Topics by density: a mutual-reachability spanning tree, its condensed tree, clusters of most stability.

The tree of a language is fitted on a sample of bounded size, by hash of the
id; every document is then given the topic of the sampled document that lies
nearest, if it is no further than documents of that topic lie apart. Words are
weighed by class-based tf-idf over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.scratch import materialize

#: Documents of a language that a tree is fitted on, buckets that words are hashed to, dimensions after the projection.
SAMPLE, BUCKETS, DIMS = 2000, 4096, 48
#: Distances under this count as this: the density of copies is finite.
LEAST = 1e-6
#: Documents whose distances to the sample are held at once.
BLOCK = 1024
SEED = 7


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def buckets_of(text: str | None) -> dict[int, int]:
    """How often the words of a text fall into each bucket."""
    counts: dict[int, int] = {}
    for w in words_of(text):
        k = zlib.crc32(w.encode()) % BUCKETS
        counts[k] = counts.get(k, 0) + 1
    return counts


def projection() -> np.ndarray:
    """A fixed random matrix with entries of plus or minus one."""
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(BUCKETS, DIMS)) / np.sqrt(DIMS)


def embedded(text: str | None, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Logarithmic counts times inverse document frequency, projected, of length one; zeros without words. Steps of 1e-6."""
    counts = buckets_of(text)
    if not counts:
        return np.zeros(DIMS)
    at = np.array(sorted(counts))
    v = ((1 + np.log([counts[k] for k in at.tolist()])) * idf[at]) @ matrix[at]
    size = np.sqrt(v @ v)
    return np.round(v / size, 6) if size > 0 else np.zeros(DIMS)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in steps of 1e-6, so that the order of sums decides no comparison."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.round(np.sqrt(np.maximum(squares, 0)), 6)


def mutual_reachability(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(core distances to the k-th nearest, itself counted; the greatest of distance and both cores)."""
    d = distances(x, x)
    np.fill_diagonal(d, 0.0)
    d = np.minimum(d, d.T)
    core = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    return core, np.maximum(np.maximum(d, core[:, None]), core[None, :])


def spanning_tree(reach: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (length, a, b) of the least spanning tree, by length, then places: Boruvka's rounds.

    In each round every component takes its shortest edge to another, the first
    of equals, and components that edges join become one.
    """
    n = len(reach)
    part, edges = np.arange(n), set()
    while len(edges) < n - 1:
        best: dict[int, tuple[float, int, int]] = {}
        for i in range(n):
            row = np.where(part == part[i], np.inf, reach[i])
            j = int(row.argmin())
            edge = (float(row[j]), min(i, j), max(i, j))
            best[int(part[i])] = min(best.get(int(part[i]), edge), edge)
        edges |= set(best.values())
        parent = list(range(n))

        def root(i: int) -> int:
            while parent[i] != i:  # noqa: B023
                parent[i] = parent[parent[i]]  # noqa: B023
                i = parent[i]  # noqa: B023
            return i

        for _, a, b in edges:
            parent[root(a)] = root(b)
        part = np.array([root(i) for i in range(n)])
    return sorted(edges)


def condensed(edges: list[tuple[float, int, int]], n: int, least: int) -> tuple[list[int], dict[int, float], np.ndarray]:
    """(parent of each cluster, stability of each cluster, cluster that each point fell out of).

    The dendrogram is walked from the root: where both sides have ``least``
    points they become clusters, where one has it goes on as the same cluster
    and the points of the other fall out, at a density of 1 / length.
    Stability is the sum over points of the densities that a cluster lasts.
    """
    join, size = list(range(n)), [1] * n
    sides: list[tuple[int, int, float]] = []
    top = list(range(n))

    def root(i: int) -> int:
        while join[i] != i:
            join[i] = join[join[i]]
            i = join[i]
        return i

    for w, a, b in edges:
        ra, rb = root(a), root(b)
        sides.append((top[ra], top[rb], w))
        join[rb] = ra
        size.append(size[top[ra]] + size[top[rb]])
        top[ra] = n + len(sides) - 1
    parent, birth, stability = [-1], [0.0], {0: 0.0}
    out = np.zeros(n, np.int64)
    todo = [(n + len(sides) - 1, 0)] if sides else []

    def fall(node: int, cluster: int, density: float) -> None:
        below = [node]
        while below:
            i = below.pop()
            if i < n:
                out[i] = cluster
                stability[cluster] += density - birth[cluster]
            else:
                below += sides[i - n][:2]

    while todo:
        node, cluster = todo.pop()
        a, b, w = sides[node - n]
        density = 1 / max(w, LEAST)
        great = [s for s in (a, b) if size[s] >= least]
        if len(great) == 2:
            for s in (a, b):
                stability[cluster] += size[s] * (density - birth[cluster])
                parent.append(cluster)
                birth.append(density)
                stability[len(parent) - 1] = 0.0
                if s < n:
                    fall(s, len(parent) - 1, density)
                else:
                    todo.append((s, len(parent) - 1))
            continue
        for s in (a, b):
            if s in great and s >= n:
                todo.append((s, cluster))
            else:
                fall(s, cluster, density)
    return parent, stability, out


def clusters(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(topic of each point or -1, core distances): clusters whose stability is over that of the clusters within them, by falling size, then first point; never the whole."""
    n = len(x)
    core, reach = mutual_reachability(x, least)
    parent, stability, out = condensed(spanning_tree(reach), n, least)
    total, chosen = dict(stability), set()
    for c in range(len(parent) - 1, 0, -1):  # children have greater numbers
        inner = sum(total[k] for k in range(c + 1, len(parent)) if parent[k] == c)
        if inner > stability[c]:
            total[c] = inner
        else:
            chosen.add(c)
    label = np.full(n, -1, np.int64)
    for i in range(n):
        c, found = int(out[i]), -1
        while c > 0:
            found = c if c in chosen else found
            c = parent[c]
        label[i] = found
    kept = sorted((c for c in set(label.tolist()) if c >= 0), key=lambda c: (-(label == c).sum(), int(np.argmax(label == c))))
    return np.array([kept.index(c) if c >= 0 else -1 for c in label.tolist()], np.int64), core


def nearest_topics(x: np.ndarray, sample: np.ndarray, topic: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Topic of the nearest sampled point, the first of equals, or -1 beyond that point's reach."""
    d = distances(x, sample)
    j = d.argmin(axis=1)
    return np.where(d[np.arange(len(x)), j] <= reach[j], topic[j], -1)


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for language, texts in batch.groupby("language")["text"]:
            seen: dict[int, int] = {}
            for t in texts:
                for k in buckets_of(t):
                    seen[k] = seen.get(k, 0) + 1
            yield pd.DataFrame({"language": language, "bucket": [-1, *seen], "docs": [len(texts), *seen.values()]})


def density_topics(docs: DataFrame, least: int = 10, sample: int = SAMPLE, words: int = 5) -> DataFrame:
    """article_id, language, topic_id, topic_label, topic_confidence, model_hash of docs(article_id, language, text).

    Languages with fewer than ``least`` documents with text, blank ones and
    "und" are left out, as are blank texts. topic_id counts from 0 within a
    language, -1 with confidence 0 is none. Each language is fitted on
    ``sample`` documents at most, those of the least hash of their id; a
    document joins the topic of the nearest one within its core distance.
    topic_label names the ``words`` words of most class-based tf-idf.
    """
    rows = docs.select("article_id", "language", "text").where(~F.coalesce("language", F.lit("")).isin("", "und") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    counts = rows.select("language", "text").mapInPandas(_bucket_counts, "language string, bucket int, docs long").groupBy("language", "bucket").agg(F.sum("docs").alias("docs")).collect()
    whole = {r["language"]: r["docs"] for r in counts if r["bucket"] < 0 and r["docs"] >= least}
    if not whole:
        return docs.sparkSession.createDataFrame([], "article_id string, language string, topic_id int, topic_label string, topic_confidence double, model_hash string")
    idf = {language: np.log(1 + n) * np.ones(BUCKETS) for language, n in whole.items()}
    for r in counts:
        if r["bucket"] >= 0 and r["language"] in idf:
            idf[r["language"]][r["bucket"]] = np.log((1 + whole[r["language"]]) / (1 + r["docs"]))
    matrix = projection()

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["article_id", "language"]].assign(v=[embedded(t, idf[language], matrix).tobytes() for t, language in zip(batch["text"], batch["language"], strict=True)])

    known = rows.where(F.col("language").isin(*whole))
    points = materialize(known.mapInPandas(embed, "article_id string, language string, v binary"), "points")
    first = F.row_number().over(Window.partitionBy("language").orderBy(F.crc32(F.col("article_id").cast("binary")), "article_id"))
    fitted = points.withColumn("r", first).where(F.col("r") <= sample).drop("r")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("article_id", kind="stable")
        x = np.array([np.frombuffer(v) for v in group["v"]])
        topic, core = clusters(x, least)
        return pd.DataFrame({"language": group["language"].iloc[0], "v": [x.tobytes()], "topic": [topic.tobytes()], "reach": [core.tobytes()]})

    models = {r["language"]: (np.frombuffer(r["v"]).reshape(-1, DIMS), np.frombuffer(r["topic"], np.int64), np.frombuffer(r["reach"])) for r in fitted.groupBy("language").applyInPandas(fit, "language string, v binary, topic binary, reach binary").collect()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, group in batch.groupby("language"):
                for k in range(0, len(group), BLOCK):
                    part = group.iloc[k : k + BLOCK]
                    yield part[["article_id", "language"]].assign(topic_id=nearest_topics(np.array([np.frombuffer(v) for v in part["v"]]), *models[language]).astype(np.int32))

    given = materialize(points.mapInPandas(assign, "article_id string, language string, topic_id int"), "topics")
    return given.join(topic_labels(known, given, words), ["language", "topic_id"], "left").select("article_id", "language", "topic_id", F.coalesce("topic_label", F.lit("outlier")).alias("topic_label"), F.when(F.col("topic_id") < 0, 0.0).otherwise(1.0).alias("topic_confidence"), F.sha2(F.concat(F.lit(f"density:{BUCKETS}:{DIMS}:{SEED}:{sample}:{least}:"), "language"), 256).alias("model_hash"))


def topic_labels(docs: DataFrame, given: DataFrame, words: int) -> DataFrame:
    """(language, topic_id, topic_label): the words of most class-based tf-idf: share of the topic's words, times log(1 + mean words of a topic / words of the language that are this one)."""
    terms = docs.join(given.select("article_id", "topic_id").where("topic_id >= 0").distinct(), "article_id").select("language", "topic_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''")
    counts = terms.groupBy("language", "topic_id", "word").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("language", "topic_id").agg(F.sum("n").alias("size"))
    mean = sizes.groupBy("language").agg(F.avg("size").alias("mean"))
    every = counts.groupBy("language", "word").agg(F.sum("n").alias("all"))
    weighed = counts.join(sizes, ["language", "topic_id"]).join(mean, "language").join(every, ["language", "word"]).withColumn("weight", F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.col("all")))
    best = F.row_number().over(Window.partitionBy("language", "topic_id").orderBy(F.desc(F.round("weight", 12)), "word"))
    first = weighed.withColumn("r", best).where(F.col("r") <= words).groupBy("language", "topic_id").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("w"))
    return first.select("language", "topic_id", F.concat_ws("_", F.col("topic_id").cast("string"), F.array_join("w.word", "_")).alias("topic_label"))
