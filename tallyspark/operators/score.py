"""Completeness of statements and quality of extractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.roles import double

GRADES = (("A", 0.90), ("B", 0.75), ("C", 0.60), ("D", 0.40))


def completeness(found: DataFrame, template: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """E: statements of which at least least items are found: weighted, raw and core coverage.

    template: statement, canonical_name, weight, core; a small table.
    """
    own = found.select(*keys, "canonical_name").distinct()
    size = template.groupBy("statement").agg(F.sum("weight").alias("weights"), F.count("*").alias("items"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("core_weights"))
    hits = own.join(F.broadcast(template), "canonical_name").groupBy(*keys, "statement").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("core"), F.col("weight"))), F.lit(0)).alias("cw"))
    div = lambda a, b: double(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    return hits.where(F.col("n") >= least).join(F.broadcast(size), "statement").select(*keys, "statement", F.col("n").alias("found_items"), div("w", "weights").alias("weighted"), div("n", "items").alias("raw"), div("cw", "core_weights").alias("core"))


def grade(score: Column) -> Column:
    out = F
    for g, least in GRADES:
        out = out.when(score >= least, g)
    return out.otherwise("F")


def quality(rows: DataFrame, weights: dict[str, float], optional: str) -> DataFrame:
    """F/A16: weighted mean of the dimensions; without the optional one, its weight goes to the others in proportion.

    Caps: a cell rate below 0.5 allows D at most, a formula mismatch rate above 0.3 C at most.
    """
    rest = {k: w for k, w in weights.items() if k != optional}
    total = sum(rest.values())
    mean = lambda ws, by: sum((F.col(k) * (w / by) for k, w in ws.items()), F.lit(0.0))
    score = F.when(F.col(optional).isNull(), mean(rest, total)).otherwise(mean(weights, 1.0))
    rank = F.array_position(F.array(*[F.lit(g) for g in "FDCBA"]), grade(F.col("score")))
    cap = F.least(F.when(F.col(optional) < 0.5, 2).otherwise(5), F.when(F.col("mismatch") > 0.3, 3).otherwise(5))
    rows = rows.withColumn("score", double(score, 6)).withColumn("rank", F.least(rank.cast("int"), cap))
    label = F.when(F.col("score") >= 0.80, "trustworthy").when(F.col("score") >= 0.55, "needs_review").otherwise("unreliable")
    return rows.withColumn("grade", F.element_at(F.array(*[F.lit(g) for g in "FDCBA"]), F.col("rank"))).withColumn("label", label)


def gate(rows: DataFrame, least: str = "D") -> DataFrame:
    """Fails when the grade is at or below least."""
    return rows.withColumn("gate_passed", F.col("rank") > "FDCBA".index(least) + 1)


def decayed(confidence: Column, days: Column, exempt: Column, rate: float = 0.3, floor: float = 0.5) -> Column:
    """confidence fades over a year, down to a floor; user corrections and unseen patterns don't."""
    kept = F.greatest(F.lit(floor), 1 - days.cast("double") / 365 * rate)
    return F.when(exempt | days.isNull(), confidence).otherwise(confidence * kept)
