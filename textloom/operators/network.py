"""Entity mentions: rankings, co-occurrence, networks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.scratch import materialize

#: Most edges and nodes that a network shows.
MOST_EDGES, MOST_NODES, MOST_NODE_FIRST = 6000, 10_000, 12_000


def entity_ranking(entities: DataFrame, links: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """Mentions of each entity with its sources and the link of the greatest confidence."""
    out = entities.groupBy("entity_text", "entity_label").agg(F.count(F.lit(1)).alias("mentions"), F.sort_array(F.collect_set("source")).alias("sources"))
    out = out.orderBy(F.desc("mentions"), "entity_text", "entity_label").limit(max(1, min(1000, limit)))
    if links is None:
        return out
    best = links.groupBy("entity_text").agg(F.max(F.struct("link_confidence", "wikidata_qid", "link_method")).alias("b"))
    return out.join(best, "entity_text", "left").select(*out.columns, F.coalesce("b.wikidata_qid", F.lit("")).alias("qid"), F.coalesce("b.link_confidence", F.lit(0.0)).alias("confidence"))


def language_distribution(languages: DataFrame) -> DataFrame:
    rows = languages.where("rank = 1")
    return rows.groupBy("detected_language").agg(F.count(F.lit(1)).alias("detections"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_set("source")).alias("sources"))


def pairs(entities: DataFrame) -> DataFrame:
    """Unordered pairs of different entity texts of an article, by text and label; weight is the lesser mention count."""
    counts = entities.groupBy("article_id", "source", "entity_text", "entity_label").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("window_start"))
    side = lambda s: counts.select("article_id", "source", *[F.col(c).alias(f"{c}_{s}") for c in ("entity_text", "entity_label", "n", "window_start")])
    both = side("a").join(side("b"), ["article_id", "source"]).where((F.struct("entity_text_a", "entity_label_a") < F.struct("entity_text_b", "entity_label_b")) & (F.col("entity_text_a") != F.col("entity_text_b")))
    return both.select("article_id", "source", F.least("window_start_a", "window_start_b").alias("window_start"), F.col("entity_text_a").alias("a_text"), F.col("entity_label_a").alias("a_label"), F.col("entity_text_b").alias("b_text"), F.col("entity_label_b").alias("b_label"), F.least("n_a", "n_b").alias("weight"))


def gap_articles(entities: DataFrame, cooccurrences: DataFrame) -> DataFrame:
    """Articles with two different entities or more that have no pair: a gap of the sweep."""
    rich = entities.groupBy("article_id").agg(F.countDistinct("entity_text").alias("entities")).where("entities >= 2")
    return rich.join(cooccurrences.select("article_id").distinct(), "article_id", "left_anti")


def edges(cooc: DataFrame, least: int = 1) -> DataFrame:
    out = cooc.groupBy("a_text", "b_text").agg(F.sum("weight").alias("weight"), F.countDistinct("article_id").alias("articles"))
    return out.where(F.col("weight") >= least)


def edge_first(cooc: DataFrame, top: int = 200, least: int = 1) -> DataFrame:
    """The heaviest edges."""
    return edges(cooc, least).orderBy(F.desc("weight"), "a_text", "b_text").limit(max(1, min(MOST_EDGES, top)))


def nodes_of(shown: DataFrame) -> DataFrame:
    """Degree and total weight of each node from the edges shown."""
    ends = shown.select(F.col("a_text").alias("node"), "weight").unionAll(shown.select(F.col("b_text").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("total"))


def node_first(cooc: DataFrame, most_nodes: int = 100, top: int = 200, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The heaviest nodes (totals over all edges) and of the edges among them those in the first K of either end."""
    every = materialize(edges(cooc, least), "edges")  # read four times below
    most_nodes = max(1, min(MOST_NODES, most_nodes))
    nodes = nodes_of(every).orderBy(F.desc("total"), "node").limit(most_nodes)
    k = max(1, min(8, round(top / most_nodes)))
    among = every.join(nodes.select(F.col("node").alias("a_text")), "a_text", "left_semi").join(nodes.select(F.col("node").alias("b_text")), "b_text", "left_semi")
    first = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("weight"), "a_text", "b_text"))
    pruned = among.withColumn("ra", first("a_text")).withColumn("rb", first("b_text")).where(F.least("ra", "rb") <= k)
    return nodes, pruned.select("a_text", "b_text", "weight", "articles").orderBy(F.desc("weight"), "a_text", "b_text").limit(MOST_NODE_FIRST)


def edge_presence(cooc: DataFrame, shown: DataFrame) -> DataFrame:
    """Sources of each edge shown."""
    return cooc.join(shown.select("a_text", "b_text"), ["a_text", "b_text"], "left_semi").groupBy("a_text", "b_text").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def node_presence(cooc: DataFrame) -> DataFrame:
    """Articles of each node in each source."""
    ends = cooc.select(F.col("a_text").alias("node"), "source", "article_id").unionAll(cooc.select(F.col("b_text").alias("node"), "source", "article_id"))
    return ends.groupBy("node", "source").agg(F.countDistinct("article_id").alias("articles"))


def node_metric(entities: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Mean over the articles of an entity of the article's mean of a metric."""
    means = metrics.where(F.col("metric_name") == metric).groupBy("article_id").agg(F.avg("value").alias("m"))
    return entities.select("article_id", "entity_text").distinct().join(means, "article_id").groupBy("entity_text").agg(F.avg("m").alias("value"))


def node_labels(nodes: DataFrame, links: DataFrame, labels: DataFrame, language: str) -> DataFrame:
    """The best link of each node and its label in the viewer's language."""
    best = links.groupBy(F.col("entity_text").alias("node")).agg(F.max(F.struct("link_confidence", "wikidata_qid")).alias("b")).select("node", F.col("b.wikidata_qid").alias("wikidata_qid"))
    return nodes.join(best, "node", "left").join(labels.where(F.col("language") == language).select("wikidata_qid", "label"), "wikidata_qid", "left").select("node", "wikidata_qid", "label")


def articles_in_scope(entities: DataFrame) -> DataFrame:
    """Articles with two different (text, label) at least."""
    rich = entities.groupBy("article_id").agg(F.countDistinct("entity_text", "entity_label").alias("n")).where("n >= 2")
    return rich.agg(F.count(F.lit(1)).alias("articles"))


def undated_overlay(cooc: DataFrame, undated: DataFrame) -> DataFrame:
    """For each edge the articles without a real date."""
    marked = cooc.join(undated.select("article_id").distinct().withColumn("flag", F.lit(True)), "article_id", "left")
    return marked.groupBy("a_text", "b_text").agg(F.countDistinct(F.when(F.col("flag"), F.col("article_id"))).alias("undated"))


def scope_union(groups: dict[str, Sequence[str]], languages: dict[str, str], allow_cross_language: bool = False, most_sources: int = 100, most_groups: int = 25) -> list[str]:
    """Sources of several groups in first-seen order; more than one language is refused unless allowed."""
    if len(groups) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    out = list(dict.fromkeys(s for g in groups.values() for s in g))
    if not out or len(out) > most_sources:
        raise ValueError(f"1 to {most_sources} sources")
    if len({languages.get(s, "und") for s in out}) > 1 and not allow_cross_language:
        raise PermissionError("the scope crosses languages")
    return out


def topic_distribution(topics: DataFrame, start: str | None = None, end: str | None = None, least_confidence: float = 0.0) -> DataFrame:
    """Articles of each topic of the newest sweep, or of the sweeps that overlap [start, end); outliers (-1) are left out."""
    if start is None:
        newest = topics.agg(F.max("window_start").alias("window_start"))
        rows = topics.join(F.broadcast(newest), "window_start")
    else:
        rows = topics.where((F.col("window_start") < F.lit(end).cast("timestamp_ntz")) & (F.col("window_end") > F.lit(start).cast("timestamp_ntz")))
    rows = rows.where((F.col("topic_id") != -1) & (F.col("topic_confidence") >= least_confidence))
    return rows.groupBy("language", "topic_id").agg(F.min("topic_label").alias("label"), F.countDistinct("article_id").alias("articles"), F.avg("topic_confidence").alias("confidence"), F.max(F.struct("topic_confidence", "model_hash")).getField("model_hash").alias("model"))


def communities(edge_list: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by weighted label propagation: each node takes the heaviest label around it, the smaller of equals.

    An approximation of modularity communities; the number of rounds is fixed,
    and each cuts its lineage with a table in the shared folder.
    """
    edge_list = materialize(edge_list.select("a_text", "b_text", "weight"), "edges")
    both = edge_list.select(F.col("a_text").alias("node"), F.col("b_text").alias("near"), "weight").unionAll(edge_list.select(F.col("b_text"), F.col("a_text"), "weight"))
    labels = both.select("node").distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("node").alias("near"), "community"), "near").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        own = labels.select("node", "community", F.lit(0).cast("long").alias("w"))
        best = around.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "community")))
        labels = materialize(best.where("r = 1").select("node", "community"), "communities")
    return labels


#: Shares of the nodes that may move at once, one in so many; after the last only the node that gains most moves.
SHARES = (2, 4, 16, 64)
#: Steps of local moving at one level, and levels of contraction, after which the search ends where it is.
MOST_STEPS, MOST_LEVELS = 200, 40
_EXACT = "decimal(19,0)"


def _surroundings(edge_rows: DataFrame, weights: DataFrame, labels: DataFrame) -> DataFrame:
    """For each node its own community and those next to it: node, own, k, loop, community, into (weight of its edges there), total and members of the community."""
    near = labels.select(F.col("node").alias("near"), F.col("own").alias("community"))
    into = edge_rows.join(near, "near").groupBy("node", "community").agg(F.sum("weight").alias("into"))
    own = labels.select("node", F.col("own").alias("community"), F.lit(0).cast("long").alias("into"))
    sizes = labels.join(weights, "node").groupBy(F.col("own").alias("community")).agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("members"))
    every = into.unionByName(own).groupBy("node", "community").agg(F.sum("into").alias("into"))
    return every.join(labels, "node").join(weights, "node").join(sizes, "community")


def _quality(around: DataFrame, twice: int) -> int:
    """Modularity times the square of twice the total weight, exact."""
    own = around.where("community = own").agg(F.sum(F.col("into") + F.col("loop")).cast("decimal(38,0)").alias("inside"), F.sum(F.col("k").cast(_EXACT) * F.col("total").cast(_EXACT)).cast("decimal(38,0)").alias("squares")).first()
    return twice * int(own["inside"]) - int(own["squares"])


def _moves(around: DataFrame, twice: int) -> DataFrame:
    """node, target, gain of the nodes for which another community is better than their own.

    The score of a community is its edges with the node less those that weights
    alone would give. Of two nodes that are alone only the one of the greater
    name moves to the other. Equal scores: the smallest community.
    """
    without = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
    score = F.col("into").cast(_EXACT) * F.lit(twice).cast(_EXACT) - F.col("k").cast(_EXACT) * without.cast(_EXACT)
    one = Window.partitionBy("node")
    stay = F.max(F.when(F.col("community") == F.col("own"), F.struct(F.col("score").alias("score"), F.col("members").alias("members"))))
    rows = around.withColumn("score", score).withColumn("stay", stay.over(one))
    swap = (F.col("stay.members") == 1) & (F.col("members") == 1) & (F.col("community") > F.col("own"))
    better = rows.where((F.col("community") != F.col("own")) & (F.col("score") > F.col("stay.score")) & ~swap)
    first = better.withColumn("r", F.row_number().over(one.orderBy(F.desc("score"), "community"))).where("r = 1")
    return first.select("node", F.col("community").alias("target"), (F.col("score") - F.col("stay.score")).alias("gain"))


def louvain(edge_list: DataFrame) -> DataFrame:
    """(node, community, total, head): communities of high modularity, each named by its smallest node.

    edge_list: a_text, b_text, weight (whole, positive), each pair once. Nodes
    start alone. At each level nodes move to the neighbouring community of most
    gain, a part of them at once, chosen by a hash that changes from step to
    step. Steps that do not raise the modularity are taken back and tried with
    fewer nodes, in the end with the one of most gain, which cannot fail; a
    level ends when no node gains. Communities then become nodes, until a level
    changes nothing. total is the weight of a node's edges, head marks the node
    of the greatest total of a community, the smallest name of equals. All sums
    are whole numbers, so that results do not depend on the order of rows.
    Null ends and loops are left out; an empty list gives an empty result.
    """
    clean = edge_list.where("a_text IS NOT NULL AND b_text IS NOT NULL AND a_text <> b_text AND weight > 0").select("a_text", "b_text", F.col("weight").cast("long").alias("weight"))
    rows = materialize(clean.select(F.col("a_text").alias("node"), F.col("b_text").alias("near"), "weight").unionAll(clean.select(F.col("b_text"), F.col("a_text"), "weight")).groupBy("node", "near").agg(F.sum("weight").alias("weight")), "edges")
    totals = rows.groupBy("node").agg(F.sum("weight").alias("total"))
    mapping = materialize(totals.select("node", F.col("node").alias("community")), "communities")
    weights = materialize(totals.select("node", F.col("total").alias("k"), F.lit(0).cast("long").alias("loop")), "weights")
    twice = weights.agg(F.sum("k")).first()[0]
    for _ in range(MOST_LEVELS if twice else 0):
        labels = _settled_level(rows, weights, twice)
        if labels is None:
            break
        mapping = materialize(mapping.join(labels.select(F.col("node").alias("community"), "own"), "community").select("node", F.col("own").alias("community")), "communities")
        of = lambda end: labels.select(F.col("node").alias(end), F.col("own").alias(f"{end}_in"))  # noqa: B023, E731
        ends = materialize(rows.join(of("node"), "node").join(of("near"), "near").groupBy(F.col("node_in").alias("node"), F.col("near_in").alias("near")).agg(F.sum("weight").alias("weight")), "contracted")
        inside = weights.join(labels, "node").groupBy(F.col("own").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("old"))
        loops = ends.where("node = near").select("node", "weight")
        weights = materialize(inside.join(loops, "node", "left").select("node", "k", (F.col("old") + F.coalesce("weight", F.lit(0))).alias("loop")), "weights")
        rows = ends.where("node <> near")
    named = mapping.join(mapping.groupBy("community").agg(F.min("node").alias("name")), "community").select("node", F.col("name").alias("community")).join(totals, "node")
    best = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("total"), "node"))
    return named.select("node", "community", "total", (best == 1).alias("head"))


def _settled_level(rows: DataFrame, weights: DataFrame, twice: int) -> DataFrame | None:
    """(node, own) after local moving, None if no node gains by a move."""
    labels = weights.select("node", F.col("node").alias("own"))
    around, moved, share = materialize(_surroundings(rows, weights, labels), "around"), False, 0
    quality, moves = _quality(around, twice), None
    for step in range(MOST_STEPS):
        if moves is None:
            moves = materialize(_moves(around, twice), "moves")
            if moves.isEmpty():
                break
        if share < len(SHARES):
            some = moves.where(F.pmod(F.crc32(F.concat("node", F.lit(f"/{step}")).cast("binary")), F.lit(SHARES[share])) == 0)
        else:
            some = moves.orderBy(F.desc("gain"), "node").limit(1)
        now = around.where("community = own").select("node", "own").join(some, "node", "left").select("node", F.coalesce("target", "own").alias("own"))
        tried = materialize(_surroundings(rows, weights, now), "around")
        reached = _quality(tried, twice)
        if reached > quality:
            around, quality, moves, moved, share = tried, reached, None, True, max(share - 1, 0)
        elif share < len(SHARES):
            share += 1
        else:
            break
    return around.where("community = own").select("node", "own") if moved else None


def modularity(edge_list: DataFrame, labels: DataFrame) -> float:
    """Of a partition (node, community) of an undirected list of edges."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"{end}_in"))
    ends = edge_list.join(of("a_text"), "a_text").join(of("b_text"), "b_text")
    inside, whole = ends.agg(F.sum(F.when(F.col("a_text_in") == F.col("b_text_in"), F.col("weight")).otherwise(0)), F.sum("weight")).first()
    either = ends.select(F.col("a_text_in").alias("c"), "weight").unionAll(ends.select("b_text_in", "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    return inside / whole - either.agg(F.sum(F.pow(F.col("k") / (2.0 * whole), 2))).first()[0]
