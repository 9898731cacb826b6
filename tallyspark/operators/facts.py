"""Operators on long facts: latest and first per key, filters, precedence joins, dense grids, deltas, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.roles import double


def filter_facts(facts: DataFrame, entity: int | None = None, canonical: str | None = None, period: str | None = None, min_confidence: float | None = None, year: int | None = None, period_range: tuple[str, str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Optional filters, all of which must hold; the range compares period text, the year is a substring."""
    conditions = [
        None if entity is None else F.col("entity_id") == entity,
        None if canonical is None else F.col("canonical_name") == canonical,
        None if period is None else F.col("period") == period,
        None if min_confidence is None else F.col("confidence") >= min_confidence,
        None if year is None else F.col("period").contains(str(year)),
        None if period_range is None else F.col("period").between(*period_range),
        None if names is None else F.col("canonical_name").isin(list(names)),
    ]
    for c in conditions:
        facts = facts if c is None else facts.where(c)
    return facts


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page of rows in a total order; limit is held to most."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def latest(facts: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return facts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def percent_change(now: Column, before: Column, scale: int = 2) -> Column:
    """(b - a) / |a| in percent; null if a is zero or null."""
    now, before = now.cast("double"), before.cast("double")
    return double(F.try_divide(now - before, F.abs(before)) * 100, scale)


def trends(facts: DataFrame, keys: Sequence[str] = ("entity_id", "canonical_name"), period: str = "period") -> DataFrame:
    """Each value with its change from the period before, in percent."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy(period))
    return facts.withColumn("yoy_change_pct", percent_change(F.col("value"), before))


def standardised(extracted: DataFrame, derived: DataFrame, keys: Sequence[str], least: float = 0.70) -> DataFrame:
    """Full outer join; the extracted value wins if nothing was derived or its confidence is at least least."""
    e = extracted.select(*keys, F.col("value").alias("e_value"), F.col("confidence").alias("e_conf"))
    d = derived.select(*keys, F.col("value").alias("d_value"), F.col("confidence").alias("d_conf"))
    own = F.col("e_value").isNotNull() & (F.col("d_value").isNull() | (F.col("e_conf") >= least))
    source = F.when(own, "extracted").when(F.col("e_value").isNotNull() & F.col("d_value").isNotNull(), "computed_supplement").when(F.col("d_value").isNotNull(), "computed").otherwise("extracted")
    return e.join(d, list(keys), "full").select(*keys, F.when(own, F.col("e_value")).otherwise(F.coalesce("d_value", "e_value")).alias("value"), F.when(own, F.col("e_conf")).otherwise(F.coalesce("d_conf", "e_conf")).alias("confidence"), source.alias("source"))


def grid(facts: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every requested pair of the two small key tables, with its fact or nulls."""
    return left.crossJoin(right).join(facts, list(keys), "left")


def deltas(rows: DataFrame, keys: Sequence[str], period: str = "period") -> DataFrame:
    """Change from the neighbouring period on a dense grid, absolute and in percent."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy(period))
    return rows.withColumn("delta", F.col("value") - before).withColumn("delta_pct", percent_change(F.col("value"), before))


def diff(a: DataFrame, b: DataFrame, key: str = "label") -> DataFrame:
    """Label, change (added, removed, mapping_changed, value_changed, unchanged) and both sides. A changed mapping hides a changed value."""
    a = a.select(key, F.col("canonical_name").alias("canonical_a"), F.col("value").alias("value_a"), F.lit(True).alias("_a"))
    b = b.select(key, F.col("canonical_name").alias("canonical_b"), F.col("value").alias("value_b"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("canonical_a").eqNullSafe(F.col("canonical_b")), "mapping_changed")
        .when(~F.col("value_a").eqNullSafe(F.col("value_b")), "value_changed").otherwise("unchanged")
    )
    return a.join(b, key, "full").select(key, change.alias("change"), "canonical_a", "canonical_b", "value_a", "value_b")


def decompose(line_items: DataFrame) -> DataFrame:
    """One fact for each period of a line item's values; nulls, malformed numbers and unmapped items go."""
    rows = line_items.where("canonical_name <> 'unmapped'").select("job_id", "canonical_name", "label", "confidence", F.explode("values").alias("period", "raw"))
    return rows.withColumn("value", F.expr("try_cast(raw as decimal(20,4))")).where("value is not null").drop("raw")


def resolve_conflicts(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key stays active, in an order that leaves no ties."""
    return rows.withColumn("is_active", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def first_wins(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The first write for a key is kept."""
    return latest(rows, keys, [F.col(seq)])


def redirect(rows: DataFrame, redirects: DataFrame) -> DataFrame:
    """Names that are deprecated become their target, one hop."""
    return rows.join(redirects.select(F.col("name").alias("canonical_name"), "target"), "canonical_name", "left").withColumn("canonical_name", F.coalesce("target", "canonical_name")).drop("target")


def upsert(state: DataFrame, delta: DataFrame, keys: Sequence[str], merged: dict[str, Column]) -> DataFrame:
    """Full outer join of state and delta on keys; merged: new columns over old_<c> and new_<c>."""
    old = state.select(*keys, *[F.col(c).alias(f"old_{c}") for c in state.columns if c not in keys])
    new = delta.select(*keys, *[F.col(c).alias(f"new_{c}") for c in delta.columns if c not in keys])
    return old.join(new, list(keys), "full").select(*keys, *[c.alias(n) for n, c in merged.items()])
