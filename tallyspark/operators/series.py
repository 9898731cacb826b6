"""Time-series checks and peer anomalies on long facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.roles import double


def changes(facts: DataFrame, keys: Sequence[str], thresholds: DataFrame, default: float, phase: str | None = None) -> DataFrame:
    """Values whose change from the period before exceeds the threshold of the item, else of the category, else the default. A change of phase suppresses the flag.

    thresholds (scope, name, pct) is a small configuration table.
    """
    w = Window.partitionBy(*keys).orderBy("period")
    rows = facts.withColumn("before", F.lag("value").over(w))
    if phase:
        rows = rows.withColumn("_phase_before", F.lag(phase).over(w))
    change = F.try_divide((F.col("value") - F.col("before")).cast("double"), F.abs(F.col("before").cast("double")))
    scoped = lambda scope: F.broadcast(thresholds.where(F.col("scope") == scope).select(F.col("name").alias(f"_{scope}"), F.col("pct").alias(f"_{scope}_pct")))
    rows = rows.withColumn("change", change).join(scoped("item"), F.col("canonical_name") == F.col("_item"), "left").join(scoped("category"), F.col("category") == F.col("_category"), "left")
    limit = F.coalesce("_item_pct", "_category_pct", F.lit(default))
    kept = F.lit(True) if phase is None else F.coalesce(F.col(phase) == F.col("_phase_before"), F.lit(True))
    return rows.withColumn("threshold", limit).where((F.abs(F.col("change")) > F.col("threshold")) & kept)


def sign_flips(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A value whose sign is the opposite of the one before; zero is no sign."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("period"))
    return facts.withColumn("before", before).where(F.signum(F.col("value").cast("double")) * F.signum(F.col("before").cast("double")) < 0)


def moments(value: Column, over: Window | None = None) -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation from exact decimal sums, so that the order of rows doesn't matter."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = at(F.count(value))
    x = value.cast("decimal(20,4)")
    s, ss = at(F.sum(x)).cast("double"), at(F.sum((x * x).cast("decimal(38,8)"))).cast("double")
    mean = s / n
    return n, mean, F.sqrt(F.greatest(F.try_divide(ss - s * s / n, (n - 1).cast("double")), F.lit(0.0)))


def outliers(facts: DataFrame, keys: Sequence[str], threshold: float = 3.0, least: int = 4) -> DataFrame:
    """|z| over the series beyond threshold; short or constant series have none."""
    n, mean, sd = moments(F.col("value"), Window.partitionBy(*keys))
    rows = facts.withColumns({"n": n, "mean": mean, "sd": sd}).where((F.col("n") >= least) & (F.col("sd") >= 1e-10))
    return rows.withColumn("z", (F.col("value").cast("double") - F.col("mean")) / F.col("sd")).where(F.abs("z") > threshold)


def gaps(facts: DataFrame, periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods without a value between a series' first and last."""
    span = facts.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    every = span.join(F.broadcast(periods.select("period").distinct()), (F.col("period") > F.col("lo")) & (F.col("period") < F.col("hi")))
    return every.join(facts.select(*keys, "period"), [*keys, "period"], "left_anti").select(*keys, "period")


def drops(facts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Cumulative items that fall."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("period"))
    return facts.where(F.col("canonical_name").isin(list(names))).withColumn("before", before).where("value < before")


def iqr_anomalies(facts: DataFrame, keys: Sequence[str], reach: float = 1.5, least: int = 3) -> DataFrame:
    """Peers outside the fences. Quartiles are by nearest rank (sorted[n // 4], sorted[3n // 4]), so a rank window gives them: no group is gathered."""
    w = Window.partitionBy(*keys)
    ranked = facts.withColumn("rn", F.row_number().over(w.orderBy("value", "entity_id")) - 1).withColumn("n", F.count("*").over(w))
    pick = lambda at: F.max(F.when(F.col("rn") == at, F.col("value"))).over(w).cast("double")
    rows = ranked.withColumns({"q1": pick(F.floor(F.col("n") / 4)), "q3": pick(F.floor(F.col("n") * 3 / 4))}).where(F.col("n") >= least)
    spread, v = F.col("q3") - F.col("q1"), F.col("value").cast("double")
    low, high = F.col("q1") - reach * spread, F.col("q3") + reach * spread
    distance = F.when(v < low, F.try_divide(low - v, spread)).when(v > high, F.try_divide(v - high, spread))
    direction = F.when(spread > 0, F.when(v < low, "low").when(v > high, "high"))
    return rows.withColumns({"lower": low, "upper": high, "direction": direction, "distance": double(distance, 4)}).where((v < low) | (v > high))


def zscore_anomalies(facts: DataFrame, keys: Sequence[str], threshold: float = 2.0, least: int = 3) -> DataFrame:
    """Peers whose z-score within the group is beyond threshold."""
    return outliers(facts, keys, threshold, least)


def consistency(findings: DataFrame, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - weighted findings / checks, within 0 and 1; error 2, warning 1, info a half."""
    weight = F.when(F.col("severity") == "error", 2.0).when(F.col("severity") == "warning", 1.0).otherwise(0.5)
    bad = findings.groupBy(*keys).agg(F.sum(weight.cast("decimal(10,1)")).alias("bad"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.col("bad").cast("double"), F.lit(0.0)) / F.col("n")))
    return checks.groupBy(*keys).agg(F.count("*").alias("n")).join(bad, list(keys), "left").select(*keys, double(score, 6).alias("score"))


def lifecycle(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """W17 (corporate): construction before the first revenue, ramp-up after it, operations, a maintenance gap, tail, and what follows the last.

    Ramp-up: the first periods of revenue, three at most, while below half the median of positive values. Tail: the last
    ones, two at most, each below half the peak and not rising. A zero between revenues is a shutdown. Prefix scans are
    running minima of where the run breaks.
    """
    w = Window.partitionBy(key).orderBy(order)
    every = Window.partitionBy(key)
    v = F.col(value)
    pos = v > 0
    rows = series.withColumn("i", F.row_number().over(w)).withColumns({"first": F.min(F.when(pos, F.col("i"))).over(every), "last": F.max(F.when(pos, F.col("i"))).over(every), "peak": F.max(v).over(every), "n_pos": F.count(F.when(pos, 1)).over(every)})
    # lower median of the positive values, by rank
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(pos, v).asc_nulls_last(), order))
    rows = rows.withColumn("rank", rank).withColumn("median", F.max(F.when(F.col("rank") == F.ceil(F.col("n_pos") / 2), v)).over(every))
    inside = F.col("i").between(F.col("first"), F.col("last"))
    rows = rows.withColumn("ramp_end", F.min(F.when(inside & ~(v * 2 < F.col("median")), F.col("i"))).over(every))
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    falls = (v * 2 < F.col("peak")) & (v <= F.coalesce(before, v))
    rows = rows.withColumn("tail_from", F.max(F.when(inside & ~falls, F.col("i"))).over(every))
    phase = (
        F.when(F.col("first").isNull() | (F.col("i") < F.col("first")), "construction").when(F.col("i") > F.col("last"), "post_operations")
        .when((v == 0) & (before > 0) & (after > 0), "maintenance_shutdown")
        .when((F.col("i") < F.coalesce("ramp_end", F.col("last") + 1)) & (F.col("i") < F.col("first") + 3), "ramp_up")
        .when((F.col("i") > F.col("tail_from")) & (F.col("i") > F.col("last") - 2), "tail").otherwise("operations")
    )
    return rows.select(key, order, value, phase.alias("phase"))
