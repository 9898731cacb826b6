"""Accounting checks within and across statements, sign conventions, tolerances, feedback on mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import check, divergence
from ..sources.roles import double


def near(a: Column, b: Column) -> Column:
    """equal within 0.01, or within a thousandth of b (at least of 1)."""
    gap = F.abs(a - b)
    return (gap <= 0.01) | (gap / F.greatest(F.abs(b), F.lit(1.0)) <= 0.001)


def wide(facts: DataFrame, keys: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(*[F.max(F.when(F.col("canonical_name") == n, F.col("value"))).cast("double").alias(n) for n in wanted])


def accounting(rows: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """F12 over wide rows: keys, rule, passed for each (name, rule text, tolerance)."""
    each = F.array(*[F.struct(F.lit(n).alias("rule"), check(text, F.col, tol).alias("passed")) for n, text, tol in rules])
    return rows.select(*keys, F.inline(each))


def cross_statement(rows: DataFrame, entity: str, period: str, checks: Sequence[tuple[str, Column, Column, float, str]]) -> DataFrame:
    """Expected against actual columns, relative to the larger of both and 1: rows whose operands are missing vanish.

    checks: (name, actual, expected, tolerance, severity on failure).
    """
    each = F.array(*[F.struct(F.lit(n).alias("check_name"), a.alias("actual"), e.alias("expected"), divergence(a, e).alias("divergence"), F.lit(t).alias("tolerance"), F.lit(s).alias("on_failure")) for n, a, e, t, s in checks])
    out = rows.select(entity, period, F.inline(each)).where("actual is not null and expected is not null")
    passed = F.col("divergence") <= F.col("tolerance")
    return out.withColumn("passed", passed).withColumn("severity", F.when(passed, "info").otherwise(F.col("on_failure")))


def before(name: str, entity: str = "entity_id", period: str = "period") -> Column:
    """The column's value in the entity's period before."""
    return F.lag(name).over(Window.partitionBy(entity).orderBy(period))


def signs(facts: DataFrame, expected: DataFrame, hard: Sequence[str]) -> DataFrame:
    """Sign convention: value against its expected sign; hard items are errors, all others warnings."""
    rows = facts.join(F.broadcast(expected), "canonical_name")
    v = F.col("value").cast("double")
    ok = (v == 0) | ((F.col("sign") == "positive") & (v > 0)) | ((F.col("sign") == "negative") & (v < 0))
    return rows.withColumn("passed", ok).withColumn("severity", F.when(F.col("canonical_name").isin(list(hard)) & ~ok, "error").otherwise("warning"))


def percentage(value: Column, kind: Column) -> Column:
    """percentages above 1 are taken as hundredths."""
    return F.when((kind == "percentage") & (F.abs(value) > 1), value / 100).otherwise(value)


def feedback(confidence: Column, passed: Column) -> Column:
    """H: a failed check costs 0.1 (not below 0.1), a passed one adds 0.02 (not above 1), none changes nothing."""
    return F.when(passed.isNull(), confidence).when(passed, F.least(confidence + 0.02, F.lit(1.0))).otherwise(F.greatest(confidence - 0.1, F.lit(0.1)))


def reconcile(values: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each value with its cell by period, else by position; match, mismatch or unmatched."""
    by_period = cells.select(*keys, "period", F.col("raw").alias("p_raw"))
    by_place = cells.select(*keys, F.col("place"), F.col("raw").alias("n_raw"))
    rows = values.join(by_period, [*keys, "period"], "left").join(by_place, [*keys, "place"], "left")
    raw = F.coalesce("p_raw", "n_raw")
    return rows.withColumn("raw", raw).withColumn("status", F.when(F.col("raw").isNull(), "unmatched").when(near(F.col("value"), F.col("raw")), "match").otherwise("mismatch")).drop("p_raw", "n_raw")


def share(top: Column, bottom: Column) -> Column:
    return double(F.try_divide(top.cast("double"), bottom.cast("double")), 6)
