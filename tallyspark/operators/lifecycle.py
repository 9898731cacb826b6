"""Phases of a project's or a company's life, told from its items period by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of which a project has two, items that tell phases, shares of the median and the peak revenue, periods of a start and of an end.
PROJECT = ["cfads", "cfae", "dscr", "llcr", "plcr", "debt_service", "equity_irr", "dsra_balance", "sculpted_debt_service", "equity_contribution", "development_costs", "total_investment"]
SIGNALS = ["revenue", "capex", "debt_drawdown", "development_costs", "dscr"]
START, END, START_PERIODS, END_PERIODS = 0.5, 0.5, 3, 2


def profiles(facts: DataFrame) -> DataFrame:
    """Of each entity is_project, signals (in their order, joined), confidence, and of its positive revenue the first and last place, the median and the peak.

    facts: entity, at (place of the period), item, value. Without positive revenue the confidence is 0 and there are no phases.
    """
    positive = F.when((F.col("item") == "revenue") & (F.col("value") > 0), F.col("value").cast("double"))
    there = [F.max(F.when(F.col("item") == s, s)) for s in SIGNALS]
    rows = facts.groupBy("entity").agg(
        F.count_distinct(F.when(F.col("item").isin(PROJECT), F.col("item"))).alias("indicators"), F.concat_ws("|", *there).alias("signals"),
        F.min(F.when(positive.isNotNull(), F.col("at"))).alias("first"), F.max(F.when(positive.isNotNull(), F.col("at"))).alias("last"), F.median(positive).alias("median"), F.max(positive).alias("peak"),
    )
    project = F.col("indicators") >= 2
    score = F.when(F.col("signals") == "", 0.0).otherwise(F.size(F.split("signals", r"\|")) / F.lit(float(len(SIGNALS))))
    sure = F.when(project, F.least(score * 0.8 + F.least(F.col("indicators") / F.lit(5.0), F.lit(1.0)) * 0.2, F.lit(1.0))).otherwise(score)
    return rows.select("entity", project.alias("is_project"), "indicators", "signals", F.when(F.col("first").isNull(), 0.0).otherwise(F.round(sure, 4)).alias("confidence"), "first", "last", "median", "peak")


def phases(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Entity, at, phase of all periods of entities with revenue. known: profiles of facts.

    A company is built, runs from its first to its last revenue, and is over. A project is prepared (money is drawn and
    nothing spent) or built before the first; then starts (up to START_PERIODS periods below START of the median revenue,
    none after one that isn't), runs, stands still (no revenue next to some) and ends (from the last running period back, up
    to END_PERIODS below END of the peak, each less than the one before). An entity's periods are one window, partitioned
    by entity; missing values count as 0.
    """
    item = lambda name: F.coalesce(F.max(F.when(F.col("item") == name, F.col("value"))).cast("double"), F.lit(0.0)).alias(name)
    wide = facts.groupBy("entity", "at").agg(*[item(s) for s in SIGNALS[:4]])
    by = Window.partitionBy("entity")
    up, down = by.orderBy("at"), by.orderBy(F.desc("at"))
    rev = F.col("revenue")
    rows = wide.join(known.where(F.col("first").isNotNull()).select("entity", "is_project", "first", "last", "median", "peak"), "entity")
    rows = rows.withColumns({"before": F.coalesce(F.lag("revenue").over(up), F.lit(0.0)), "after": F.coalesce(F.lead("revenue").over(up), F.lit(0.0)), "leads": F.lag("at").over(up).isNull()})
    inside = F.col("at").between(F.col("first"), F.col("last"))
    low = inside & (rev > 0) & (rev < F.col("median") * START)
    steady = inside & (rev >= F.col("median") * START)
    count = lambda c, w: F.count_if(c).over(w)
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", low & (count(steady, so_far) == 0) & (count(low, so_far) <= START_PERIODS))
    still = inside & (rev <= 0) & (F.col("at") > F.col("first")) & (F.col("at") < F.col("last")) & ((F.col("before") > 0) | (F.col("after") > 0))
    rows = rows.withColumn("runs", inside & ~F.col("start") & ~still)
    falls = F.col("runs") & (rev > 0) & (rev < F.col("peak") * END) & (rev < F.col("before")) & ~F.col("leads")
    from_end = down.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ends", falls & (count(F.col("runs") & ~falls, from_end) == 0) & (count(falls, from_end) <= END_PERIODS))
    spent = (F.abs("capex") > 0) | (F.abs("development_costs") > 0)
    outside = F.when(F.col("at") > F.col("last"), "post_operations").when(F.col("at") < F.col("first"), F.when(F.col("is_project") & ~spent & (F.col("debt_drawdown") > 0), "pre_construction").otherwise("construction"))
    project: Column = F.when(F.col("start"), "ramp_up").when(~F.col("runs"), "maintenance_shutdown").when(F.col("ends"), "tail").otherwise("operations")
    return rows.select("entity", "at", F.when(~inside, outside).when(F.col("is_project"), project).otherwise("operations").alias("phase"))
