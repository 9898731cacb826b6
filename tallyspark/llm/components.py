"""Connected components of a link table by contraction: hook each node to its least neighbour, jump to roots, relabel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of links (a, b: long).

    Each round at least halves the nodes of every component that has several, as only nodes without a smaller neighbour
    stay. Jumps double, so depth costs its logarithm. No round gathers a component anywhere: a node's least neighbour
    is a partial aggregate, and relabelling is an equi-join. Loops, repeated links and nulls are ignored; without links
    the result is empty.
    """
    links = _tidy(links.select("a", "b").dropna())
    rounds: list[DataFrame] = []
    links = stash(links, "links")
    while not links.isEmpty():
        up = _roots(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        rounds.append(up)
        at = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
        links = stash(_tidy(moved.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    total = rounds[-1]
    for up in reversed(rounds[:-1]):
        last = total.select(F.col("node").alias("root"), F.col("root").alias("last"))
        total = up.join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root")).unionByName(total)
    return total


def _tidy(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _roots(up: DataFrame) -> DataFrame:
    """Pointer jumping until every root is a node that has none."""
    up = stash(up, "up")
    while True:
        over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = stash(up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        up = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return up
