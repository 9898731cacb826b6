"""Aggregations over jobs, facts, patterns and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.roles import double


def ratio(top: Column, bottom: Column, scale: int = 6) -> Column:
    """A10: top / bottom as a double, 0 if the bottom is zero or missing."""
    return F.coalesce(double(F.try_divide(top.cast("double"), bottom.cast("double")), scale), F.lit(0.0))


def zero_filled(counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Every listed value has a row, missing ones with count 0."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return F.broadcast(every).join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def costs(jobs: DataFrame) -> DataFrame:
    """Totals, by entity and by day from one scan (grouping sets); columns level, entity_id, day, n, total, average."""
    rows = jobs.withColumn("day", F.to_date("created_at"))
    sets = rows.groupingSets([[], ["entity_id"], ["day"]], "entity_id", "day").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("cost").alias("total"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "entity").otherwise("day")
    return sets.select(level.alias("level"), "entity_id", "day", "n", F.col("total").cast("double"), double(F.col("total").cast("double") / F.col("n")).alias("average"))


def histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins over confidence with total, correct and accuracy; empty bins stay, with null accuracy."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("total"), F.count_if(F.expr("correct")).alias("correct"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return every.join(found, "bin", "left").select("bin", zero(F.col("total")).alias("total"), zero(F.col("correct")).alias("correct"), double(F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")), 6).alias("accuracy"))


def label_groups(rows: DataFrame, min_count: int, min_entities: int) -> DataFrame:
    """Labels with their count, entities and sorted variants, kept by both thresholds."""
    found = rows.groupBy("label").agg(F.sum("n").alias("total"), F.count_distinct("entity").alias("entities"), F.array_join(F.array_sort(F.collect_set("variant")), "|").alias("variants"))
    return found.where((F.col("total") >= min_count) & (F.col("entities") >= min_entities))


def precision_recall(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows hold expected and predicted (null: unmapped); a wrong prediction is a false positive and a false negative."""
    hit = F.col("predicted") == F.col("expected")
    tp, fp = F.count_if(hit), F.count_if(F.col("predicted").isNotNull() & ~F.coalesce(hit, F.lit(False)))
    fn = F.count("*") - tp
    div = lambda a, b: double(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return rows.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def value_errors(rows: DataFrame, keys: Sequence[str], pct: float, absolute: float) -> DataFrame:
    """Expected against actual values (null: missing): exact and within tolerance, mean absolute and percentage error."""
    e, a = F.col("expected").cast("double"), F.col("actual").cast("double")
    gap = F.abs(e - a)
    exact, near = gap < 1e-9, gap <= F.greatest(F.abs(e) * pct, F.lit(absolute))
    decimals = lambda c: F.sum(c.cast("decimal(30,8)")).cast("double")
    return rows.groupBy(*keys).agg(
        F.count("actual").alias("compared"), F.count_if(exact).alias("exact"), F.count_if(near).alias("within"),
        double(F.try_divide(decimals(gap), F.count("actual").cast("double")), 4).alias("mae"), double(F.try_divide(decimals(F.try_divide(gap, F.abs(e)) * 100), F.count_if(a.isNotNull() & (e != 0)).cast("double")), 4).alias("mape"),
    )


def latest_per_entity(jobs: DataFrame) -> DataFrame:
    """Each entity's newest job, by max_by: one partial aggregate instead of a window."""
    newest = F.max_by(F.struct(*jobs.columns), F.struct("created_at", "job_id"))
    return jobs.groupBy("entity_id").agg(newest.alias("_j")).select("_j.*")
