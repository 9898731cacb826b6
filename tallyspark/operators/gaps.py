"""Gaps of a taxonomy: frequent labels that no item takes, sorted by how near they come to one, and grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled
from .vectors import cosine, hints

#: From which score a label is an item's alias, below which it is a new item, and from which labels are alike.
ALIAS, NEW, ALIKE = 0.80, 0.60, 0.75
#: Labels of a report, matches and labels that it shows.
MOST_LABELS, MATCHES = 200, 3


def frequent(groups: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """The most frequent labels (label, total, ...), with their place n from 1; ties by label."""
    return groups.orderBy(F.desc("total"), "label").limit(most).withColumn("n", F.row_number().over(Window.orderBy(F.desc("total"), "label")))


def analyse(labels: DataFrame, items: DataFrame, alias: float = ALIAS, new: float = NEW) -> DataFrame:
    """L: each label (label, total, entities, vector) by its best item (item, vector): alias_candidate, ambiguous, or new_item_candidate if none reaches new.

    Items are scored down to new, so that what lies between is found. Ties go to the smaller item. Zero vectors have no score.
    """
    found = hints(labels.select(F.col("label").alias("vec_id"), "vector"), items, alias, new, MATCHES)
    best = found.groupBy(F.col("vec_id").alias("label")).agg(
        F.max_by("score", -F.col("rank")).alias("best_score"), F.max_by("item", -F.col("rank")).alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"].cast("string")), "|").alias("matches"),
    )
    rows = labels.join(best, "label", "left").withColumn("best_score", F.coalesce("best_score", F.lit(0.0)))
    kind = F.when(F.col("best_score") >= alias, "alias_candidate").when(F.col("best_score") < new, "new_item_candidate").otherwise("ambiguous")
    return rows.select("label", "total", "entities", "best_score", kind.alias("classification"), F.when(kind == "alias_candidate", F.col("best")).alias("suggested"), F.coalesce("matches", F.lit("")).alias("matches"))


def alike(labels: DataFrame, least: float = ALIKE) -> DataFrame:
    """Pairs a, b of places (n) of a report's labels, a before b, whose vectors have a cosine of least; a report has at most MOST_LABELS labels (checked), so it is one block that is sent to all."""
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels; give greedy_clusters pairs from an index instead")
    a, b = labels.select(F.col("n").alias("a"), F.col("vector").alias("v")), labels.select(F.col("n").alias("b"), F.col("vector").alias("w"))
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.round(cosine(F.col("v"), F.col("w")), 6) >= least)).select("a", "b")


def greedy_clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """L: n and the seed of its cluster, as if in the order of n each node not yet taken became a seed and took all its neighbours not yet taken.

    nodes: n, distinct and ordered as the run is; pairs: a, b with a < b, on a graph of any size. A node is a seed as soon as
    every neighbour before it is taken, and taken as soon as one of these is a seed; which takes it is known in the end: the
    first. So all seeds that are certain are found at once, round by round, each a group and two equi-joins; rounds go with
    the longest chain of undecided neighbours (few on graphs whose order is unrelated to their edges), not with the nodes.
    Nodes without neighbours are their own seeds; pairs of unknown nodes, repeated ones and loops are ignored.
    """
    known = nodes.select("n").distinct()
    edges = pairs.where("a < b").distinct().join(known.withColumnRenamed("n", "a"), "a", "left_semi").join(known.withColumnRenamed("n", "b"), "b", "left_semi")
    edges = rest = settled(edges)
    taken = None
    while not rest.isEmpty():
        seeds = rest.select(F.col("a").alias("n")).distinct().join(rest.select(F.col("b").alias("n")).distinct(), "n", "left_anti")
        gone = settled(rest.join(seeds.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct())
        taken = gone if taken is None else taken.unionByName(gone)
        out = gone.unionByName(seeds)
        rest = settled(rest.join(out.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti"))
    if taken is None:
        return known.select("n", F.col("n").alias("seed"))
    owner = edges.join(taken.withColumnRenamed("n", "a"), "a", "left_anti").groupBy(F.col("b").alias("n")).agg(F.min("a").alias("seed"))
    return known.join(taken.join(owner, "n"), "n", "left").select("n", F.coalesce("seed", "n").alias("seed"))


def clusters(labels: DataFrame, pairs: DataFrame, items: DataFrame, alias: float = ALIAS) -> DataFrame:
    """L: representative, labels in the order of the report, their number, occurrences together, entities of the one with most, the representative's best score, and what to do."""
    rows = greedy_clusters(labels, pairs).join(labels, "n")
    found = rows.groupBy("seed").agg(
        F.min_by("label", "n").alias("representative"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), "|").alias("labels"),
        F.count("*").alias("cluster_size"), F.sum("total").alias("total"), F.max("entities").alias("entities"),
    )
    seeds = labels.join(found.select(F.col("seed").alias("n")), "n", "left_semi")
    best = hints(seeds.select(F.col("n").alias("vec_id"), "vector"), items, alias, -1.0, 1).select(F.col("vec_id").alias("seed"), F.col("score").alias("best_score"))
    rows = found.join(best, "seed", "left").withColumn("best_score", F.coalesce("best_score", F.lit(0.0)))
    return rows.select("representative", "labels", "cluster_size", "total", "entities", "best_score", F.when(F.col("best_score") >= alias, "add_alias").otherwise("add_new_item").alias("action"))
