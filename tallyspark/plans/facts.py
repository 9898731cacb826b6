"""Fact queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as op
from ..sources import roles

from .base import ENTITIES, FACTS, JOBS, ORACLES, RAW, dbl, query, with_

V = "CAST(value AS DOUBLE) AS value"


@query(with_(FACTS) + f"SELECT entity_id, canonical_name, period, {V}, confidence FROM facts WHERE canonical_name = 'revenue' AND confidence >= 0.6 ORDER BY created_at DESC, entity_id, period LIMIT 50 OFFSET 10")
def fact_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.filter_facts(roles.facts(spark, sf_dir), canonical="revenue", min_confidence=0.6)
    return op.page(rows, [F.desc("created_at"), "entity_id", "period"], 50, 10).select("entity_id", "canonical_name", "period", F.col("value").cast("double"), "confidence")


@query(with_(FACTS) + f"SELECT entity_id, canonical_name, period, {V} FROM facts WHERE canonical_name IN ('revenue', 'cogs', 'cash') AND period BETWEEN 'FY1996' AND 'FY1998' AND contains(period, '1997')")
def fact_in_list_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.filter_facts(roles.facts(spark, sf_dir), names=["revenue", "cogs", "cash"], period_range=("FY1996", "FY1998"), year=1997)
    return rows.select("entity_id", "canonical_name", "period", F.col("value").cast("double"))


LATEST = "ROW_NUMBER() OVER (PARTITION BY entity_id, canonical_name, period ORDER BY created_at DESC, seq_1, seq_2, seq_3, value) AS rn"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("created_at"), F.col("seq_1"), F.col("seq_2"), F.col("seq_3"), F.col("value")]
    return op.latest(roles.raw_facts(spark, sf_dir), ["entity_id", "canonical_name", "period"], order)


@query(with_(RAW) + f"SELECT entity_id, canonical_name, period, {V}, confidence, created_at FROM (SELECT *, {LATEST} FROM raw) WHERE rn = 1")
def latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("entity_id", "canonical_name", "period", F.col("value").cast("double"), "confidence", "created_at")


@query(with_(RAW) + f"""SELECT entity_id, canonical_name, period, {V}, {dbl('(CAST(value AS DOUBLE) - CAST(before AS DOUBLE)) / NULLIF(abs(CAST(before AS DOUBLE)), 0) * 100')} AS yoy_change_pct
FROM (SELECT *, LAG(value) OVER (PARTITION BY entity_id, canonical_name ORDER BY period) AS before FROM (SELECT *, {LATEST} FROM raw) WHERE rn = 1)""")
def entity_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.trends(_latest(spark, sf_dir)).select("entity_id", "canonical_name", "period", F.col("value").cast("double"), "yoy_change_pct")


@query(with_(FACTS) + """, e AS (SELECT entity_id, canonical_name, period, value, confidence FROM facts WHERE canonical_name IN ('gross_profit', 'ebit')),
d AS (SELECT entity_id, 'gross_profit' AS canonical_name, period, r - c AS value, least(cr, cc) AS confidence FROM
 (SELECT entity_id, period, MAX(value) FILTER (canonical_name = 'revenue') AS r, MAX(value) FILTER (canonical_name = 'cogs') AS c, MAX(confidence) FILTER (canonical_name = 'revenue') AS cr, MAX(confidence) FILTER (canonical_name = 'cogs') AS cc FROM facts GROUP BY 1, 2) WHERE r IS NOT NULL AND c IS NOT NULL)
SELECT entity_id, canonical_name, period, CAST(CASE WHEN e.value IS NOT NULL AND (d.value IS NULL OR e.confidence >= 0.7) THEN e.value ELSE coalesce(d.value, e.value) END AS DOUBLE) AS value,
 CASE WHEN e.value IS NOT NULL AND (d.value IS NULL OR e.confidence >= 0.7) THEN e.confidence ELSE coalesce(d.confidence, e.confidence) END AS confidence,
 CASE WHEN e.value IS NOT NULL AND (d.value IS NULL OR e.confidence >= 0.7) THEN 'extracted' WHEN e.value IS NOT NULL THEN 'computed_supplement' ELSE 'computed' END AS source
FROM e FULL JOIN d USING (entity_id, canonical_name, period)""")
def standardised_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = roles.facts(spark, sf_dir)
    one = lambda n, c: F.max(F.when(F.col("canonical_name") == n, F.col(c)))
    both = facts.groupBy("entity_id", "period").agg(one("revenue", "value").alias("r"), one("cogs", "value").alias("c"), F.least(one("revenue", "confidence"), one("cogs", "confidence")).alias("confidence"))
    derived = both.where("r is not null and c is not null").select("entity_id", F.lit("gross_profit").alias("canonical_name"), "period", (F.col("r") - F.col("c")).alias("value"), "confidence")
    extracted = facts.where(F.col("canonical_name").isin("gross_profit", "ebit"))
    return op.standardised(extracted, derived, ["entity_id", "canonical_name", "period"]).withColumn("value", F.col("value").cast("double"))


@query(with_(RAW) + """, j AS (SELECT l_suppkey || ':' || l_partkey % 200 AS label, yr, MIN(l_returnflag) AS canonical_name, SUM(p) AS value FROM items WHERE yr IN (1996, 1997) GROUP BY ALL),
a AS (SELECT * FROM j WHERE yr = 1996), b AS (SELECT * FROM j WHERE yr = 1997)
SELECT label, CASE WHEN a.yr IS NULL THEN 'added' WHEN b.yr IS NULL THEN 'removed' WHEN a.canonical_name IS DISTINCT FROM b.canonical_name THEN 'mapping_changed' WHEN a.value IS DISTINCT FROM b.value THEN 'value_changed' ELSE 'unchanged' END AS change,
 a.canonical_name AS canonical_a, b.canonical_name AS canonical_b, CAST(a.value AS DOUBLE) AS value_a, CAST(b.value AS DOUBLE) AS value_b FROM a FULL JOIN b USING (label)""")
def job_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.items(spark, sf_dir).where("yr in (1996, 1997)")
    label = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), (F.col("l_partkey") % 200).cast("string"))
    sides = rows.groupBy(label.alias("label"), "yr").agg(F.min("l_returnflag").alias("canonical_name"), F.sum("p").alias("value"))
    out = op.diff(sides.where("yr = 1996"), sides.where("yr = 1997"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("value_a", "value_b")})


ASKED = ["revenue", "ebit", "cash", "capex", "llcr"]


@query(with_(FACTS, ENTITIES) + f""", asked AS (SELECT unnest({ASKED!r}) AS canonical_name), one AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY canonical_name, entity_id ORDER BY created_at DESC, period DESC) AS rn FROM facts WHERE contains(period, '1998')) WHERE rn = 1)
SELECT canonical_name, entity_id, name, CAST(value AS DOUBLE) AS amount, period, CAST((SELECT COUNT(DISTINCT fiscal_year_end) > 1 FROM entities WHERE entity_id <= 40) AS BOOLEAN) AS mixed_year_ends
FROM asked CROSS JOIN (SELECT entity_id, name FROM entities WHERE entity_id <= 40) LEFT JOIN one USING (canonical_name, entity_id)""")
def cross_entity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = op.filter_facts(roles.facts(spark, sf_dir), year=1998, names=ASKED)
    one = op.latest(facts, ["canonical_name", "entity_id"], [F.desc("created_at"), F.desc("period")])
    who = roles.entities(spark, sf_dir).where("entity_id <= 40")
    mixed = who.agg((F.count_distinct(F.coalesce("fiscal_year_end", F.lit(12))) > 1).alias("mixed_year_ends"))
    asked = spark.createDataFrame([(n,) for n in ASKED], "canonical_name string")
    rows = op.grid(one.select("canonical_name", "entity_id", "value", "period"), who.select("entity_id", "name"), asked, ["canonical_name", "entity_id"])
    return rows.crossJoin(F.broadcast(mixed)).select("canonical_name", "entity_id", "name", F.col("value").cast("double").alias("amount"), "period", "mixed_year_ends")


@query(with_(FACTS) + f""", names AS (SELECT DISTINCT canonical_name FROM facts WHERE entity_id = 7), periods AS (SELECT unnest(['FY1995','FY1996','FY1997','FY1998','FY1999']) AS period)
SELECT canonical_name, period, CAST(value AS DOUBLE) AS value, CAST(value - before AS DOUBLE) AS delta, {dbl('(CAST(value AS DOUBLE) - CAST(before AS DOUBLE)) / NULLIF(abs(CAST(before AS DOUBLE)), 0) * 100')} AS delta_pct
FROM (SELECT *, LAG(value) OVER (PARTITION BY canonical_name ORDER BY period) AS before FROM names CROSS JOIN periods LEFT JOIN (SELECT canonical_name, period, value FROM facts WHERE entity_id = 7) USING (canonical_name, period))""")
def multi_period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = op.filter_facts(roles.facts(spark, sf_dir), entity=7)
    periods = spark.createDataFrame([(f"FY{y}",) for y in range(1995, 2000)], "period string")
    rows = op.grid(facts.select("canonical_name", "period", "value"), facts.select("canonical_name").distinct(), periods, ["canonical_name", "period"])
    return op.deltas(rows, ["canonical_name"]).select("canonical_name", "period", F.col("value").cast("double"), F.col("delta").cast("double"), "delta_pct")


@query(with_(JOBS) + "SELECT job_id, entity_id, c_name AS entity, status, CAST(cost AS DOUBLE) AS cost, created_at FROM jobs JOIN customer ON entity_id = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY created_at DESC, job_id LIMIT 100")
def entity_jobs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = roles.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity"))
    rows = roles.jobs(spark, sf_dir).join(c, "entity_id")
    return op.page(rows, [F.desc("created_at"), "job_id"], 100).select("job_id", "entity_id", "entity", "status", F.col("cost").cast("double"), "created_at")


@query("""SELECT job_id, canonical_name, label, confidence, period, CAST(value AS DOUBLE) AS value FROM (
 SELECT l_orderkey AS job_id, CASE WHEN l_partkey % 10 = 0 THEN 'unmapped' ELSE l_returnflag END AS canonical_name, CAST(l_partkey AS VARCHAR) AS label, CAST(CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS confidence,
 unnest(['q', 'p', 'x', 'n']) AS period, unnest([CAST(CAST(l_quantity AS DECIMAL(6,0)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), 'n/a', NULL]) AS raw FROM lineitem WHERE l_linenumber = 1),
 LATERAL (SELECT TRY_CAST(raw AS DECIMAL(20,4)) AS value) WHERE canonical_name <> 'unmapped' AND value IS NOT NULL""")
def fact_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decomposed(roles.items(spark, sf_dir).where("l_linenumber = 1"))


@query(ORACLES["fact_decomposition"].replace(" WHERE l_linenumber = 1", ""))
def fact_decomposition_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_decomposition over all lines of an order."""
    return _decomposed(roles.items(spark, sf_dir))


def _decomposed(li: DataFrame) -> DataFrame:
    items = li.select(
        F.col("l_orderkey").alias("job_id"), F.when(F.col("l_partkey") % 10 == 0, "unmapped").otherwise(F.col("l_returnflag")).alias("canonical_name"), F.col("l_partkey").cast("string").alias("label"), F.col("d").cast("double").alias("confidence"),
        F.create_map(F.lit("q"), F.col("q").cast("string"), F.lit("p"), F.col("p").cast("string"), F.lit("x"), F.lit("n/a"), F.lit("n"), F.lit(None).cast("string")).alias("values"),
    )
    return op.decompose(items).select("job_id", "canonical_name", "label", "confidence", "period", F.col("value").cast("double"))


@query(with_(FACTS) + "SELECT entity_id, canonical_name, " + ", ".join(f"CAST(MAX(value) FILTER (period = 'FY{y}') AS DOUBLE) AS FY{y}" for y in range(1995, 2002)) + " FROM facts GROUP BY 1, 2")
def csv_pivot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = [f"FY{y}" for y in range(1995, 2002)]
    rows = roles.facts(spark, sf_dir).groupBy("entity_id", "canonical_name").pivot("period", periods).agg(F.max("value"))
    return rows.select("entity_id", "canonical_name", *[F.col(p).cast("double") for p in periods])


@query(with_(RAW) + f"""SELECT entity_id, canonical_name, period, {V}, is_active FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, canonical_name ORDER BY confidence DESC, created_at DESC, seq_1, seq_2, seq_3, value) = 1 AS is_active FROM raw WHERE period = 'FY1997')""")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.filter_facts(roles.raw_facts(spark, sf_dir), period="FY1997")
    out = op.resolve_conflicts(rows, ["entity_id", "canonical_name"], [F.desc("confidence"), F.desc("created_at"), F.col("seq_1"), F.col("seq_2"), F.col("seq_3"), F.col("value")])
    return out.select("entity_id", "canonical_name", "period", F.col("value").cast("double"), "is_active")


