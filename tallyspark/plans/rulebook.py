"""A table of rules over the facts of each entity and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rulebook as op
from ..sources import roles
from .base import FACTS, query, with_

#: item, kind, must_be_positive, typical_sign
ITEMS = [("revenue", "currency", True, "positive"), ("cogs", "currency", None, "negative"), ("gross_margin", "percentage", False, "varies"), ("net_income", "currency", True, "varies"), ("capex", "currency", False, "negative"), ("cash", None, False, None), ("ebit", "currency", True, "positive")]
#: item, rule, tolerance, warning_only, optional; the SQL of whether it holds, of the value looked at, of what it should be; upper bound
RELATIONS = [
    ("gross_profit", "gross_profit == revenue - cogs", 0.01, False, False, ("abs(gross_profit - (revenue - cogs)) / greatest(abs(gross_profit), abs(revenue - cogs), 1) <= 0.01", "gross_profit", "revenue - cogs", None)),
    ("ebit", "ebit == gross_profit - tax_expense", 0.0001, None, None, ("abs(ebit - (gross_profit - tax_expense)) / greatest(abs(ebit), abs(gross_profit - tax_expense), 1) <= 0.0001", "ebit", "gross_profit - tax_expense", None)),
    ("gross_margin", "gross_margin == gross_profit / revenue", 0.02, True, False, ("abs(gross_margin - gross_profit / revenue) <= 0.02", "gross_margin", "gross_profit / revenue", None)),
    ("gross_margin", "0 <= gross_margin <= 0.949", None, False, True, ("gross_margin BETWEEN 0 AND 0.949", "gross_margin", "0.0", "0.949")),
    ("cash", "cash >= capex + interest_expense * 2", None, True, True, ("cash >= capex + interest_expense * 2", "cash", "capex + interest_expense * 2", None)),
    ("tax_expense", "tax_expense <= cogs", None, False, False, ("tax_expense <= cogs", "tax_expense", "cogs", None)),
    ("total_debt", "total_debt / ebit <= 3.5", None, True, False, ("total_debt / nullif(ebit, 0) <= 3.5", "total_debt / nullif(ebit, 0)", "3.5", None)),
    ("net_income", "capex <= net_income <= revenue", None, True, False, ("net_income BETWEEN capex AND revenue", "net_income", "capex", "revenue")),
    ("revenue", "revenue >= cogs + tax_expense + capex", None, False, False, ("true", "NULL", "NULL", None)),
    ("revenue", "revenue >= goodwill", None, False, True, None),
    ("revenue", "revenue is large", None, False, False, "unreadable"),
    ("revenue", "revenue = cogs", None, False, True, None),
]
NAMED = sorted({"revenue", "cogs", "gross_profit", "tax_expense", "net_income", "cash", "total_debt", "ebit", "interest_expense", "capex"})
WIDE = with_(FACTS, "w AS (SELECT entity_id, period, " + ", ".join(f"CAST(MAX(value) FILTER (canonical_name = '{n}') AS DOUBLE) AS {n}" for n in NAMED) + " FROM facts GROUP BY 1, 2)",
             "v AS (SELECT *, CASE WHEN gross_profit IS NOT NULL AND revenue <> 0 THEN round(100 * gross_profit / revenue, 1) / 100 END AS gross_margin FROM w)")


def _checks() -> str:
    rows = [f"SELECT entity_id, period, '{i}' AS item, 'must_be_positive' AS rule, {i} > 0 AS passed, 'error' AS severity, {i} AS actual, NULL AS expected, NULL AS upper, 'checked' AS reason FROM v WHERE {i} IS NOT NULL" for i, _, positive, _ in ITEMS if positive]
    for item, rule, _, warning, optional, told in RELATIONS:
        severity = "warning" if warning or told == "unreadable" else "error"
        if told == "unreadable":
            rows.append(f"SELECT entity_id, period, '{item}', '{rule}', FALSE, 'warning', NULL, NULL, NULL, 'unreadable' FROM v WHERE {item} IS NOT NULL")
        elif told:
            holds, actual, expected, upper = told
            # a range is told by its middle, any other rule by both sides
            there = f"({actual}) IS NOT NULL" if upper else f"({actual}) IS NOT NULL AND ({expected}) IS NOT NULL"
            rows.append(f"SELECT entity_id, period, '{item}', '{rule}', COALESCE({holds}, TRUE), '{severity}', CASE WHEN {there} THEN {actual} END, CASE WHEN {there} THEN {expected} END, CASE WHEN {there} THEN {upper or 'NULL'} END, CASE WHEN {there} THEN 'checked' ELSE 'not told' END FROM v WHERE {item} IS NOT NULL" + (f" AND {there}" if optional else ""))
    return WIDE + ", r AS (" + " UNION ALL ".join(rows) + ")"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = roles.facts(spark, sf_dir).select("entity_id", "period", F.col("canonical_name").alias("item"), F.col("value").cast("double").alias("value"))
    sums = facts.groupBy("entity_id", "period").agg(*[F.max(F.when(F.col("item") == n, F.col("value"))).alias(n) for n in ("gross_profit", "revenue")])
    margins = sums.where("gross_profit is not null and revenue <> 0").select("entity_id", "period", F.lit("gross_margin").alias("item"), F.round(100 * F.col("gross_profit") / F.col("revenue"), 1).alias("value"))
    items = spark.createDataFrame(ITEMS, "item string, kind string, must_be_positive boolean, typical_sign string")
    return facts.unionByName(margins), items, spark.createDataFrame([r[:5] for r in RELATIONS], "item string, rule string, tolerance double, warning_only boolean, optional boolean")


@query(_checks() + " SELECT entity_id, period, item, rule, passed, severity, ROUND(actual, 4) AS actual, ROUND(expected, 4) AS expected, ROUND(upper, 4) AS upper, reason FROM r")
def taxonomy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C/F12: rules of a table for all entities and years, with margins that are hundredths."""
    found = op.validate(*_tables(spark, sf_dir), ["entity_id", "period"])
    return found.select("entity_id", "period", "item", "rule", "passed", "severity", *[F.round(c, 4).alias(c) for c in ("actual", "expected", "upper")], "reason")


@query(_checks() + " SELECT entity_id, COUNT(*) AS total_checks, COUNT(*) FILTER (passed) AS passed, COUNT(*) FILTER (NOT passed) AS failed, COUNT(*) FILTER (NOT passed AND severity = 'error') AS errors, COUNT(*) FILTER (NOT passed AND severity = 'warning') AS warnings, COUNT(*) FILTER (reason = 'not told') AS not_told, COUNT(*) FILTER (reason = 'unreadable') AS unreadable FROM r GROUP BY 1")
def taxonomy_rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: the outcome for each entity."""
    return op.summary(op.validate(*_tables(spark, sf_dir), ["entity_id", "period"]), ["entity_id"])


@query(with_(FACTS) + """SELECT entity_id, period, canonical_name AS item, CAST(value AS DOUBLE) AS value, typical_sign, (value > 0) = (typical_sign = 'positive') AS passed, CASE WHEN canonical_name IN ('capex', 'revenue') AND (value > 0) <> (typical_sign = 'positive') THEN 'error' ELSE 'warning' END AS severity
 FROM facts JOIN (VALUES ('revenue', 'positive'), ('cogs', 'negative'), ('capex', 'negative'), ('ebit', 'positive')) t(canonical_name, typical_sign) USING (canonical_name) WHERE value <> 0""")
def taxonomy_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: signs as the table of items tells them."""
    facts, items, _ = _tables(spark, sf_dir)
    return op.signs(facts, items, ["capex", "revenue"])
