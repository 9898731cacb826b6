"""Time-series, anomaly and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series as op
from ..sources import roles
from .base import FACTS, dbl, query, with_

KEYS = ["entity_id", "canonical_name"]
LAG = "LAG(value) OVER (PARTITION BY entity_id, canonical_name ORDER BY period) AS before"
VB = "CAST(value AS DOUBLE) AS value, CAST(before AS DOUBLE) AS before"
THRESHOLDS = [("item", "revenue", 0.2), ("item", "cash", 0.6), ("category", "balance_sheet", 0.3)]


@query(with_(FACTS) + f"""SELECT entity_id, canonical_name, period, {VB}, threshold FROM (SELECT *, CASE canonical_name WHEN 'revenue' THEN 0.2 WHEN 'cash' THEN 0.6 ELSE CASE category WHEN 'balance_sheet' THEN 0.3 ELSE 0.5 END END :: DOUBLE AS threshold,
 yr // 3 AS phase, LAG(yr // 3) OVER (PARTITION BY entity_id, canonical_name ORDER BY period) AS phase_before, {LAG} FROM facts)
WHERE abs((CAST(value - before AS DOUBLE)) / NULLIF(abs(CAST(before AS DOUBLE)), 0)) > threshold AND NOT (phase <> phase_before)""")
def ts_yoy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(THRESHOLDS, "scope string, name string, pct double")
    rows = roles.facts(spark, sf_dir).withColumn("phase", F.expr("yr div 3"))
    return op.changes(rows, KEYS, limits, 0.5, "phase").select(*KEYS, "period", F.col("value").cast("double"), F.col("before").cast("double"), "threshold")


@query(with_(FACTS) + f"SELECT entity_id, canonical_name, period, {VB} FROM (SELECT *, {LAG} FROM (SELECT * REPLACE (value - 2250000 AS value) FROM facts WHERE canonical_name IN ('ebit', 'net_income', 'cash'))) WHERE sign(value) * sign(before) < 0")
def ts_sign_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.facts(spark, sf_dir).where(F.col("canonical_name").isin("ebit", "net_income", "cash")).withColumn("value", F.col("value") - 2250000)
    return op.sign_flips(rows, KEYS).select(*KEYS, "period", F.col("value").cast("double"), F.col("before").cast("double"))


def _z(keys: str, threshold: float, least: int) -> str:
    over = f"OVER (PARTITION BY {keys})"
    s, ss = f"CAST(SUM(CAST(value AS DECIMAL(20,4))) {over} AS DOUBLE)", f"CAST(SUM(CAST(CAST(value AS DECIMAL(20,4)) * CAST(value AS DECIMAL(18,4)) AS DECIMAL(38,8))) {over} AS DOUBLE)"
    return f"""SELECT entity_id, canonical_name, period, CAST(value AS DOUBLE) AS value, {dbl('z', 4)} AS z FROM (SELECT *, (CAST(value AS DOUBLE) - s / n) / sd AS z FROM
 (SELECT *, sqrt(greatest((ss - s * s / n) / NULLIF(n - 1, 0), 0)) AS sd FROM (SELECT *, COUNT(*) {over} AS n, {s} AS s, {ss} AS ss FROM facts)) WHERE n >= {least} AND sd >= 1e-10) WHERE abs(z) > {threshold}"""


@query(with_(FACTS) + _z("entity_id, canonical_name", 1.6, 4))
def ts_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.outliers(roles.facts(spark, sf_dir), KEYS, 1.6).select(*KEYS, "period", F.col("value").cast("double"), roles.double("z", 4).alias("z"))


@query(with_(FACTS) + _z("canonical_name, period", 2.0, 3))
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.zscore_anomalies(roles.facts(spark, sf_dir), ["canonical_name", "period"]).select(*KEYS, "period", F.col("value").cast("double"), roles.double("z", 4).alias("z"))


@query(with_(FACTS) + """SELECT entity_id, canonical_name, y.period FROM (SELECT entity_id, canonical_name, MIN(period) AS lo, MAX(period) AS hi FROM facts GROUP BY 1, 2) s JOIN (SELECT DISTINCT period FROM facts) y ON y.period > lo AND y.period < hi
WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = s.entity_id AND f.canonical_name = s.canonical_name AND f.period = y.period)""")
def ts_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = roles.facts(spark, sf_dir)
    return op.gaps(f.select(*KEYS, "period"), f, KEYS)


@query(with_(FACTS) + f"SELECT entity_id, canonical_name, period, {VB} FROM (SELECT *, {LAG} FROM facts WHERE canonical_name IN ('cash', 'total_debt', 'capex')) WHERE value < before")
def ts_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.drops(roles.facts(spark, sf_dir), KEYS, ["cash", "total_debt", "capex"]).select(*KEYS, "period", F.col("value").cast("double"), F.col("before").cast("double"))


@query(with_(FACTS) + f"""SELECT entity_id, {dbl('greatest(0, least(1, 1 - coalesce(CAST(bad AS DOUBLE), 0) / n))', 6)} AS score FROM (SELECT entity_id, COUNT(*) AS n FROM facts GROUP BY 1) LEFT JOIN
 (SELECT entity_id, SUM(CASE WHEN value < before * 0.5 THEN 2.0 WHEN value < before * 0.8 THEN 1.0 ELSE 0.5 END) AS bad FROM (SELECT *, {LAG} FROM facts) WHERE value < before GROUP BY 1) USING (entity_id)""")
def ts_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = roles.facts(spark, sf_dir)
    found = op.drops(f, KEYS, roles.NAMES)
    half, most = (F.col("before") * F.lit(x).cast("decimal(2,1)") for x in (0.5, 0.8))
    severity = F.when(F.col("value") < half, "error").when(F.col("value") < most, "warning").otherwise("info")
    return op.consistency(found.withColumn("severity", severity), f, ["entity_id"])


@query(with_(FACTS) + f"""SELECT entity_id, canonical_name, period, CAST(value AS DOUBLE) AS value, direction, {dbl('distance', 4)} AS distance FROM (SELECT *, CASE WHEN v < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - v) / NULLIF(q3 - q1, 0) ELSE (v - (q3 + 1.5 * (q3 - q1))) / NULLIF(q3 - q1, 0) END AS distance,
 CASE WHEN q3 > q1 THEN CASE WHEN v < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END END AS direction FROM (SELECT *, CAST(value AS DOUBLE) AS v, CAST(s[n // 4 + 1] AS DOUBLE) AS q1, CAST(s[3 * n // 4 + 1] AS DOUBLE) AS q3
 FROM facts JOIN (SELECT canonical_name, period, COUNT(*) AS n, list(value ORDER BY value) AS s FROM facts GROUP BY 1, 2) USING (canonical_name, period) WHERE n >= 3)
 WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))""")
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.iqr_anomalies(roles.facts(spark, sf_dir), ["canonical_name", "period"]).select(*KEYS, "period", F.col("value").cast("double"), "direction", "distance")


DAYS = "SELECT user_id, CAST(ts AS DATE) AS day, SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS revenue FROM events GROUP BY 1, 2"


@query(f"""WITH d AS ({DAYS}), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
b AS (SELECT *, MIN(i) FILTER (revenue > 0) OVER u AS first, MAX(i) FILTER (revenue > 0) OVER u AS last, MAX(revenue) OVER u AS peak, COUNT(*) FILTER (revenue > 0) OVER u AS n_pos, LAG(revenue) OVER (u ORDER BY day) AS before, LEAD(revenue) OVER (u ORDER BY day) AS after FROM a WINDOW u AS (PARTITION BY user_id)),
m AS (SELECT user_id, list(revenue ORDER BY revenue)[(COUNT(*) + 1) // 2] AS median FROM d WHERE revenue > 0 GROUP BY 1),
c AS (SELECT b.*, MIN(i) FILTER (i BETWEEN first AND last AND NOT revenue * 2 < median) OVER u AS ramp_end, MAX(i) FILTER (i BETWEEN first AND last AND NOT (revenue * 2 < peak AND revenue <= coalesce(before, revenue))) OVER u AS tail_from FROM b LEFT JOIN m USING (user_id) WINDOW u AS (PARTITION BY b.user_id))
SELECT user_id, day, CAST(revenue AS DOUBLE) AS revenue, CASE WHEN first IS NULL OR i < first THEN 'construction' WHEN i > last THEN 'post_operations' WHEN revenue = 0 AND before > 0 AND after > 0 THEN 'maintenance_shutdown'
 WHEN i < coalesce(ramp_end, last + 1) AND i < first + 3 THEN 'ramp_up' WHEN i > tail_from AND i > last - 2 THEN 'tail' ELSE 'operations' END AS phase FROM c""")
def lifecycle_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(12,2)")).otherwise(F.lit(0).cast("decimal(12,2)"))
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(amount).alias("revenue"))
    return op.lifecycle(days, "user_id", "day", "revenue").select("user_id", "day", F.col("revenue").cast("double"), "phase")


@query(f"SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, {dbl('CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*)')} AS score FROM events WHERE user_id <= 20 GROUP BY 1, 2 ORDER BY day DESC, user_id LIMIT 200")
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots, newest first."""
    return _snapshots(roles.table(spark, sf_dir, "events").where("user_id <= 20")).orderBy(F.desc("day"), "user_id").limit(200)


@query(f"SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, {dbl('CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*)')} AS score FROM events GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY day DESC) <= 30")
def quality_trend_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 daily snapshots of every user."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    return _snapshots(roles.table(spark, sf_dir, "events")).withColumn("_rank", newest).where("_rank <= 30").drop("_rank")


def _snapshots(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), roles.double(F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / F.count("*")).alias("score"))
