"""Lives of suppliers, quarter by quarter: revenue from line items, with gaps, slow starts and ends, and items of projects beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as op
from ..sources import roles
from .base import ITEMS, query, with_

#: Values of the items from the supplier s, the quarter q and its sales p, the same text for both engines; null: no such item then.
VALUES = {
    "revenue": "CASE WHEN s % 17 = 5 OR q < 2 + s % 4 OR q > 26 - s % 3 THEN 0.0 WHEN (q + s) % 9 = 0 OR (s % 4 = 1 AND (q + s) % 9 IN (1, 2)) THEN 0.0 WHEN q < 4 + s % 6 THEN p * 0.1 WHEN q > 23 - s % 4 THEN p * (30 - q) / 40 ELSE p END",
    "capex": "CASE WHEN s % 2 = 0 AND q < 6 THEN CASE WHEN q % 3 = 1 THEN 0.0 ELSE -100.0 END END",
    "development_costs": "CASE WHEN s % 5 = 0 AND q < 2 THEN 20.0 END",
    "debt_drawdown": "CASE WHEN s % 3 = 0 AND q < 5 THEN 50.0 END",
    "dscr": "CASE WHEN s % 3 <> 1 THEN 1.3 END",
    "cfads": "CASE WHEN s % 3 <> 1 AND q = 10 THEN 7.0 END",
}
SALES = """sales AS (SELECT l_suppkey AS s, CAST((yr - (SELECT MIN(yr) FROM items)) * 4 + quarter(l_shipdate) - 1 AS INT) AS q, CAST(SUM(p) AS DOUBLE) AS p FROM items GROUP BY 1, 2)"""
LIVES = with_(ITEMS, SALES, "facts AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT s AS entity, q AS at_, '{n}' AS item, {v} AS value FROM sales" for n, v in VALUES.items()) + ") WHERE value IS NOT NULL)",
    f"""told AS (SELECT entity, COUNT(DISTINCT item) FILTER (item IN {tuple(op.PROJECT)}) AS indicators, MIN(at_) FILTER (item = 'revenue' AND value > 0) AS first, MAX(at_) FILTER (item = 'revenue' AND value > 0) AS last, MEDIAN(value) FILTER (item = 'revenue' AND value > 0) AS mid, MAX(value) FILTER (item = 'revenue' AND value > 0) AS peak FROM facts GROUP BY 1)""",
    f"""signals AS (SELECT entity, string_agg(item, '|' ORDER BY list_position({op.SIGNALS}, item)) AS signals, COUNT(*) AS n FROM (SELECT DISTINCT entity, item FROM facts WHERE item IN {tuple(op.SIGNALS)}) GROUP BY 1)""",
    "profiles AS (SELECT *, indicators >= 2 AS is_project FROM told JOIN signals USING (entity))")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = roles.items(spark, sf_dir)
    since = items.agg(F.min("yr").alias("since"))
    quarter = ((F.col("yr") - F.col("since")) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    sales = items.join(F.broadcast(since)).groupBy(F.col("l_suppkey").alias("s"), quarter.alias("q")).agg(F.sum("p").cast("double").alias("p"))
    each = F.array(*[F.struct(F.lit(n).alias("item"), F.expr(v).cast("double").alias("value")) for n, v in VALUES.items()])
    return sales.select(F.col("s").alias("entity"), F.col("q").alias("at"), F.inline(each)).where("value is not null")


@query(LIVES + " SELECT entity, is_project, indicators, signals, CASE WHEN first IS NULL THEN 0.0 ELSE ROUND(CASE WHEN is_project THEN LEAST(n / 5.0 * 0.8 + LEAST(indicators / 5.0, 1.0) * 0.2, 1.0) ELSE n / 5.0 END, 4) END AS confidence FROM profiles")
def lifecycle_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers are projects, by which signals, and how sure that is."""
    return op.profiles(_facts(spark, sf_dir)).select("entity", "is_project", "indicators", "signals", "confidence")


@query(LIVES.replace("WITH ", "WITH RECURSIVE ", 1) + """, wide AS (SELECT entity, at_, COALESCE(MAX(value) FILTER (item = 'revenue'), 0) AS rev, COALESCE(MAX(value) FILTER (item = 'capex'), 0) AS capex, COALESCE(MAX(value) FILTER (item = 'development_costs'), 0) AS dev, COALESCE(MAX(value) FILTER (item = 'debt_drawdown'), 0) AS draw FROM facts GROUP BY 1, 2),
ordered AS (SELECT w.*, is_project, first, last, mid, peak, ROW_NUMBER() OVER e AS i, COUNT(*) OVER (PARTITION BY w.entity) AS n, COALESCE(LAG(rev) OVER e, 0) AS before, COALESCE(LEAD(rev) OVER e, 0) AS after FROM wide w JOIN profiles p ON p.entity = w.entity AND first IS NOT NULL WINDOW e AS (PARTITION BY w.entity ORDER BY at_)),
forward(entity, i, starts, open, phase) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), 0, TRUE, '' FROM ordered UNION ALL
 SELECT o.entity, o.i, starts + CASE WHEN open AND starts < 3 AND at_ BETWEEN first AND last AND rev > 0 AND rev < mid * 0.5 THEN 1 ELSE 0 END, open AND NOT (at_ BETWEEN first AND last AND rev >= mid * 0.5) AND NOT starts >= 3,
  CASE WHEN at_ > last THEN 'post_operations' WHEN at_ < first THEN CASE WHEN is_project AND capex = 0 AND dev = 0 AND draw > 0 THEN 'pre_construction' ELSE 'construction' END WHEN NOT is_project THEN 'operations'
   WHEN open AND starts < 3 AND rev > 0 AND rev < mid * 0.5 THEN 'ramp_up' WHEN rev <= 0 AND at_ > first AND at_ < last AND (before > 0 OR after > 0) THEN 'maintenance_shutdown' ELSE 'operations' END
 FROM forward f JOIN ordered o ON o.entity = f.entity AND o.i = f.i + 1),
backward(entity, i, ends, open, tail) AS (SELECT DISTINCT entity, n + 1, 0, TRUE, FALSE FROM ordered UNION ALL
 SELECT o.entity, o.i, ends + CASE WHEN open AND ends < 2 AND is_project AND p.phase = 'operations' AND rev > 0 AND rev < peak * 0.5 AND o.i > 1 AND rev < before THEN 1 ELSE 0 END,
  open AND ends < 2 AND NOT (p.phase = 'operations' AND NOT (rev > 0 AND rev < peak * 0.5 AND o.i > 1 AND rev < before)), open AND ends < 2 AND is_project AND p.phase = 'operations' AND rev > 0 AND rev < peak * 0.5 AND o.i > 1 AND rev < before
 FROM backward b JOIN ordered o ON o.entity = b.entity AND o.i = b.i - 1 JOIN forward_done p ON p.entity = o.entity AND p.i = o.i)
SELECT o.entity, o.at_ AS at, CASE WHEN b.tail THEN 'tail' ELSE f.phase END AS phase FROM ordered o JOIN forward_done f ON f.entity = o.entity AND f.i = o.i JOIN backward b ON b.entity = o.entity AND b.i = o.i""".replace("),\nbackward(", "),\nforward_done AS (SELECT * FROM forward WHERE i > 0),\nbackward("))
def lifecycle_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of all suppliers' quarters; the SQL walks them forth and back one by one."""
    facts = _facts(spark, sf_dir)
    return op.phases(facts, op.profiles(facts))
