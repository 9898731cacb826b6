"""Derivation, validation and scoring queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES, names
from ..operators import derive as dop
from ..operators import score as sop
from ..operators import validate as vop
from ..sources import roles
from .base import FACTS, ITEMS, ORACLES, dbl, query, with_

KEYS = ["entity_id", "period"]
#: Column expressions in the text of the oracle: the same rules by another route, common table expressions.
WANTED = list(dict.fromkeys(n for r in RULES for n in [r.target, *names(r.formula)]))
#: Names that no line item plays get a stand-in, so that every rule meets values.
EXTRA = {"depreciation": "cogs * 0.5", "amortization": "tax_expense * 0.1", "cfads": "cfo * 0.75", "debt_service": "interest_expense * 50", "accounts_payable": "cogs * 0.25", "distribution_lock_up": "entity_id % 7 * 0.5"}


def _sql_formula(text: str) -> str:
    out = ""
    for i, x in enumerate(re.findall(r"[A-Za-z_]\w*|\d+|[-+*/]", text)):
        x = f"v_{x}" if re.match("[A-Za-z_]", x) else x
        out = x if i == 0 else f"({out} {x}" if x in "+-*/" else f"{out} NULLIF({x}, 0))" if out.endswith("/") else f"{out} {x})"
    return out


def _sql_uncertainty(c: str) -> str:
    return f"CASE WHEN {c} >= 0.99 THEN 0.01 WHEN {c} >= 0.90 THEN 0.03 WHEN {c} >= 0.80 THEN 0.07 WHEN {c} >= 0.70 THEN 0.12 ELSE 0.20 END::DOUBLE"


def _derive_sql() -> str:
    ctes = [FACTS.replace("facts AS", "given AS", 1)]
    ctes.append("facts AS (SELECT entity_id, period, canonical_name, CAST(value AS DOUBLE) AS value, confidence FROM given UNION ALL " + " UNION ALL ".join(f"SELECT entity_id, 'FY' || yr, '{n}', CAST({e} AS DOUBLE), 0.8::DOUBLE FROM (SELECT entity_id, yr, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in roles.NAMES)} FROM wide)" for n, e in EXTRA.items()) + ")")
    ctes.append("w0 AS (SELECT entity_id, period, " + ", ".join(f"MAX(value) FILTER (canonical_name = '{n}') AS v_{n}, MAX(confidence) FILTER (canonical_name = '{n}') AS c_{n}" for n in WANTED) + " FROM facts GROUP BY 1, 2)")
    out = []
    for i, r in enumerate(sorted(RULES, key=lambda r: r.priority)):
        ins = names(r.formula)
        least = f"least({', '.join('c_' + n for n in ins)})"
        conf = f"greatest(0, least(1, {' * '.join('c_' + n for n in ins)} * 0.95))" if r.product else f"greatest(0, least(1, {least}))"
        there = " AND ".join(f"v_{n} IS NOT NULL" for n in ins)
        b = dbl(f"sqrt({' + '.join(f'({_sql_uncertainty('c_' + n)}) * ({_sql_uncertainty('c_' + n)})' for n in ins)})", 6)
        strong = f"(v_{r.target} IS NOT NULL AND c_{r.target} >= 0.70)"
        ctes.append(f"x{i} AS (SELECT *, {_sql_formula(r.formula)} AS val, {conf}::DOUBLE AS conf, {least} AS lo, {b} AS b FROM w{i})")
        ctes.append(f"y{i} AS (SELECT *, CASE WHEN NOT ({there}) OR val IS NULL THEN NULL WHEN {strong} AND lo >= 0.75 THEN 'consistency' WHEN NOT {strong} AND lo >= 0.60 THEN CASE WHEN v_{r.target} IS NULL THEN 'gap_fill' ELSE 'supplement' END END AS kind, abs(v_{r.target} - val) / greatest(abs(v_{r.target}), abs(val), 0.001) AS apart FROM x{i})")
        low = "CASE WHEN val > 0 THEN greatest(val * (1 - b), 0) ELSE val * (1 - b) END"
        near = "" if r.product else "WHEN abs(val) < 1e-10 THEN NULL "
        out.append(f"SELECT entity_id, period, '{r.id}' AS rule_id, '{r.target}' AS canonical_name, val AS value, conf AS confidence, kind, apart AS divergence, apart <= {r.tolerance} AS passed, CASE {near}WHEN TRUE THEN {low} END AS low, CASE {near}WHEN TRUE THEN val * (1 + b) END AS high FROM y{i} WHERE kind IS NOT NULL")
        ctes.append(f"w{i + 1} AS (SELECT entity_id, period, " + ", ".join((f"CASE WHEN kind IN ('gap_fill', 'supplement') THEN val ELSE v_{n} END AS v_{n}, CASE WHEN kind IN ('gap_fill', 'supplement') THEN conf ELSE c_{n} END AS c_{n}" if n == r.target else f"v_{n}, c_{n}") for n in WANTED) + f" FROM y{i})")
    return with_(*ctes) + ", derived AS (" + " UNION ALL ".join(out) + ")"


DERIVED = _derive_sql()


def _doubles(text: str) -> Column:
    """The stand-in's value in doubles, its decimal literals too."""
    return F.expr(re.sub(r"\b(\d+\.\d+)\b", r"\1D", text)).cast("double")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["entity_id", "period", "canonical_name", "value", "confidence"]
    w = roles.wide(spark, sf_dir).select("entity_id", F.concat(F.lit("FY"), F.col("yr").cast("string")).alias("period"), *[F.col(c).cast("double") for c in roles.NAMES])
    more = w.select("entity_id", "period", F.inline(F.array(*[F.struct(F.lit(n).alias("canonical_name"), _doubles(e).alias("value"), F.lit(0.8).alias("confidence")) for n, e in EXTRA.items()])))
    return dop.derive(roles.facts(spark, sf_dir).withColumn("value", F.col("value").cast("double")).select(cols).unionByName(more.select(cols)))


@query(DERIVED + "SELECT entity_id, period, rule_id, canonical_name, value, confidence, kind FROM derived WHERE kind <> 'consistency'")
def derivation_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir).where("kind <> 'consistency'").select(*KEYS, "rule_id", "canonical_name", "value", "confidence", "kind")


@query(DERIVED + "SELECT entity_id, period, rule_id, canonical_name, value, divergence, passed FROM derived WHERE kind = 'consistency'")
def derivation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir).where("kind = 'consistency'").select(*KEYS, "rule_id", "canonical_name", "value", "divergence", "passed")


@query(DERIVED + "SELECT entity_id, period, rule_id, value, low, high, (low < 1.35 AND 1.35 < high) OR (value > 1.35 AND low < 1.35) AS sensitive, value - 1.35::DOUBLE AS headroom FROM derived WHERE rule_id IN ('DR-030', 'DR-031', 'DR-042', 'DR-050')")
def derivation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _derived(spark, sf_dir).where(F.col("rule_id").isin("DR-030", "DR-031", "DR-042", "DR-050"))
    sensitive, headroom = dop.covenant(F.col("value"), F.col("low"), F.col("high"), F.lit(1.35))
    return rows.select(*KEYS, "rule_id", "value", "low", "high", sensitive.alias("sensitive"), headroom.alias("headroom"))


CHECKED = ["revenue", "cogs", "gross_profit", "ebit", "tax_expense", "net_income", "cash", "total_debt", "capex", "cfo", "total_current_assets", "total_current_liabilities"]
PIVOT = "w AS (SELECT entity_id, period, " + ", ".join(f"CAST(MAX(value) FILTER (canonical_name = '{n}') AS DOUBLE) AS {n}" for n in CHECKED) + " FROM facts GROUP BY 1, 2)"
REL = "abs({a} - {b}) / greatest(abs({a}), abs({b}), 1)"


def _rel(a: str, b: str) -> str:
    return REL.format(a=f"({a})", b=f"({b})")


@query(with_(FACTS, PIVOT) + " UNION ALL ".join(f"SELECT entity_id, period, '{n}' AS rule, coalesce({c}, TRUE) AS passed FROM w" for n, c in (
    ("gross", _rel("gross_profit", "revenue - cogs") + " <= 0.01"), ("ebit_tax", _rel("ebit", "gross_profit - tax_expense") + " <= 0.01"), ("cash_cover", "cash >= capex"), ("order", "tax_expense <= cogs AND cogs <= revenue"), ("weird", _rel("total_current_assets", "(total_current_liabilities + cash) * 0.5") + " <= 0.2"))))
def accounting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("gross", "gross_profit == revenue - cogs", 0.01), ("ebit_tax", "ebit == gross_profit - tax_expense", 0.01), ("cash_cover", "cash >= capex", 0.0), ("order", "tax_expense <= cogs <= revenue", 0.0), ("weird", "total_current_assets == total_current_liabilities + cash * 0.5", 0.2)]
    return vop.accounting(vop.wide(roles.facts(spark, sf_dir), KEYS, CHECKED), KEYS, rules)


CROSS = [("net_income_matches", "net_income", "ebit - tax_expense", 0.02, "error"), ("cash_roll", "cash", "cash_before + cfo - capex", 0.05, "error"), ("debt_roll", "total_debt", "debt_before", 0.1, "warning"), ("working_capital", "total_current_assets", "total_current_liabilities + abs(capex)", 0.5, "warning")]


@query(with_(FACTS, PIVOT) + ", l AS (SELECT *, LAG(cash) OVER e AS cash_before, LAG(total_debt) OVER e AS debt_before FROM w WINDOW e AS (PARTITION BY entity_id ORDER BY period))" + " UNION ALL ".join(f"""
SELECT entity_id, period, '{n}' AS check_name, {a} AS actual, {e} AS expected, {_rel(a, e)} <= {t} AS passed, CASE WHEN {_rel(a, e)} <= {t} THEN 'info' ELSE '{s}' END AS severity FROM l WHERE {a} IS NOT NULL AND ({e}) IS NOT NULL""" for n, a, e, t, s in CROSS))
def cross_statement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vop.wide(roles.facts(spark, sf_dir), KEYS, CHECKED).withColumns({"cash_before": vop.before("cash"), "debt_before": vop.before("total_debt")})
    out = vop.cross_statement(rows, "entity_id", "period", [(n, F.col(a), F.expr(e), t, s) for n, a, e, t, s in CROSS])
    return out.select("entity_id", "period", "check_name", "actual", "expected", "passed", "severity")


SIGNS = {"revenue": "positive", "cogs": "negative", "net_income": "positive", "capex": "negative"}


@query(with_(FACTS) + f"""SELECT entity_id, canonical_name, period, CAST(value AS DOUBLE) AS value, ok AS passed, CASE WHEN canonical_name IN ('revenue', 'capex') AND NOT ok THEN 'error' ELSE 'warning' END AS severity FROM (SELECT *, value = 0 OR (sgn = 'positive' AND value > 0) OR (sgn = 'negative' AND value < 0) AS ok
 FROM facts JOIN (SELECT unnest({list(SIGNS)!r}) AS canonical_name, unnest({list(SIGNS.values())!r}) AS sgn) USING (canonical_name))""")
def sign_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame(list(SIGNS.items()), "canonical_name string, sign string")
    return vop.signs(roles.facts(spark, sf_dir), expected, ["revenue", "capex"]).select("entity_id", "canonical_name", "period", F.col("value").cast("double"), "passed", "severity")


@query(with_(FACTS) + """, c AS (SELECT entity_id, canonical_name, MIN(value) > 100000 AS passed FROM facts WHERE canonical_name IN ('revenue', 'cogs', 'cash') GROUP BY 1, 2)
SELECT entity_id, canonical_name, period, CASE WHEN passed IS NULL THEN confidence WHEN passed THEN least(confidence + 0.02, 1.0) ELSE greatest(confidence - 0.1, 0.1) END AS confidence FROM facts LEFT JOIN c USING (entity_id, canonical_name)""")
def validation_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = roles.facts(spark, sf_dir)
    checks = f.where(F.col("canonical_name").isin("revenue", "cogs", "cash")).groupBy("entity_id", "canonical_name").agg((F.min("value") > 100000).alias("passed"))
    rows = f.join(checks, ["entity_id", "canonical_name"], "left")
    return rows.select("entity_id", "canonical_name", "period", vop.feedback(F.col("confidence"), F.col("passed")).alias("confidence"))


@query(with_(ITEMS) + """, v AS (SELECT l_orderkey AS k, l_linenumber AS place, 'P' || l_linenumber AS period, CAST(SUM(p) AS DOUBLE) AS value FROM items WHERE l_orderkey % 20 = 0 GROUP BY ALL),
c AS (SELECT k, place, CASE WHEN place % 3 = 0 THEN 'X' ELSE period END AS period, CASE WHEN place % 4 = 0 THEN value + 5 ELSE value END AS raw FROM v WHERE place % 5 <> 0)
SELECT k, place, period, value, raw, CASE WHEN raw IS NULL THEN 'unmatched' WHEN abs(value - raw) <= 0.01 OR abs(value - raw) / greatest(abs(raw), 1) <= 0.001 THEN 'match' ELSE 'mismatch' END AS status
FROM (SELECT v.*, coalesce(a.raw, b.raw) AS raw FROM v LEFT JOIN c a ON a.k = v.k AND a.period = v.period LEFT JOIN c b ON b.k = v.k AND b.place = v.place)""")
def cell_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(roles.items(spark, sf_dir).where("l_orderkey % 20 = 0"))


@query(ORACLES["cell_reconciliation"].replace(" WHERE l_orderkey % 20 = 0", ""))
def cell_reconciliation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_reconciliation over all orders."""
    return _reconciled(roles.items(spark, sf_dir))


def _reconciled(li: DataFrame) -> DataFrame:
    v = li.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("place")).agg(F.sum("p").cast("double").alias("value")).withColumn("period", F.concat(F.lit("P"), F.col("place").cast("string")))
    cells = v.where("place % 5 <> 0").select("k", "place", F.when(F.expr("place % 3 = 0"), "X").otherwise(F.col("period")).alias("period"), F.when(F.expr("place % 4 = 0"), F.col("value") + 5).otherwise(F.col("value")).alias("raw"))
    return vop.reconcile(v, cells, ["k"]).select("k", "place", "period", "value", "raw", "status")


#: statement, item, weight, core
TEMPLATE = [("income_statement", n, w, c) for n, w, c in (("revenue", 10, True), ("cogs", 8, True), ("gross_profit", 6, False), ("ebit", 7, True), ("tax_expense", 4, False), ("net_income", 9, True), ("ebitda", 5, False))] + [("balance_sheet", n, w, c) for n, w, c in (("cash", 9, True), ("total_debt", 8, True), ("total_current_assets", 5, False), ("total_current_liabilities", 5, False), ("equity", 9, True))]
TEMPLATE_SQL = f"t AS (SELECT unnest({[t[0] for t in TEMPLATE]!r}) AS statement, unnest({[t[1] for t in TEMPLATE]!r}) AS canonical_name, unnest({[t[2] for t in TEMPLATE]!r}) AS weight, unnest({[t[3] for t in TEMPLATE]!r}) AS core)"


@query(with_(FACTS, TEMPLATE_SQL) + f"""SELECT entity_id, period, statement, n AS found_items, {dbl('CAST(w AS DOUBLE) / weights', 4)} AS weighted, {dbl('CAST(n AS DOUBLE) / items', 4)} AS raw, {dbl('CAST(cw AS DOUBLE) / core_weights', 4)} AS core
FROM (SELECT entity_id, period, statement, SUM(weight) AS w, COUNT(*) AS n, coalesce(SUM(weight) FILTER (core), 0) AS cw FROM (SELECT DISTINCT entity_id, period, canonical_name FROM facts) JOIN t USING (canonical_name) GROUP BY ALL HAVING COUNT(*) >= 2)
JOIN (SELECT statement, SUM(weight) AS weights, COUNT(*) AS items, SUM(weight) FILTER (core) AS core_weights FROM t GROUP BY 1) USING (statement)""")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sop.completeness(roles.facts(spark, sf_dir), spark.createDataFrame(TEMPLATE, "statement string, canonical_name string, weight int, core boolean"), KEYS)


WEIGHTS = {"mapping": 0.25, "validation": 0.20, "completeness": 0.20, "series": 0.15, "cells": 0.20}
DIMENSIONS = "SELECT o_orderkey AS job_id, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS mapping, CAST(o_custkey % 83 AS DOUBLE) / 82 AS validation, CAST((o_orderkey + o_custkey) % 97 AS DOUBLE) / 96 AS completeness, CAST(o_orderkey % 7 AS DOUBLE) / 6 AS series, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 11 AS DOUBLE) / 10 END AS cells, CAST(o_orderkey % 5 AS DOUBLE) / 10 AS mismatch FROM orders"


def _mean(ws: dict[str, float], by: float) -> str:
    return "0.0::DOUBLE" + "".join(f" + {k} * {w / by!r}::DOUBLE" for k, w in ws.items())


REST = {k: w for k, w in WEIGHTS.items() if k != "cells"}
SCORED = f"""WITH q AS ({DIMENSIONS}), s AS (SELECT *, {dbl(f"CASE WHEN cells IS NULL THEN {_mean(REST, sum(REST.values()))} ELSE {_mean(WEIGHTS, 1.0)} END", 6)} AS score FROM q),
r AS (SELECT *, CAST(least(CASE WHEN score >= 0.9 THEN 5 WHEN score >= 0.75 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 ELSE 1 END, CASE WHEN cells < 0.5 THEN 2 ELSE 5 END, CASE WHEN mismatch > 0.3 THEN 3 ELSE 5 END) AS INT) AS rank FROM s)
"""


def job_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = roles.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    d = lambda x, by: x.cast("double") / by
    return o.select(k.alias("job_id"), d(k % 101, 100).alias("mapping"), d(c % 83, 82).alias("validation"), d((k + c) % 97, 96).alias("completeness"), d(k % 7, 6).alias("series"), F.when(F.col("o_orderstatus") != "P", d(c % 11, 10)).alias("cells"), d(k % 5, 10).alias("mismatch"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sop.quality(job_dimensions(spark, sf_dir), WEIGHTS, "cells")


@query(SCORED + "SELECT job_id, score, ['F', 'D', 'C', 'B', 'A'][rank] AS grade, CASE WHEN score >= 0.8 THEN 'trustworthy' WHEN score >= 0.55 THEN 'needs_review' ELSE 'unreliable' END AS label FROM r")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("job_id", "score", "grade", "label")


@query(SCORED + "SELECT ['F', 'D', 'C', 'B', 'A'][rank] AS grade, rank > 2 AS gate_passed, COUNT(*) AS n FROM r GROUP BY ALL")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sop.gate(_scored(spark, sf_dir)).groupBy("grade", "gate_passed").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderpriority = '1-URGENT' THEN c ELSE c * greatest(0.5, 1 - CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS DOUBLE) / 365 * 0.3) END AS effective FROM (SELECT *, CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS c FROM orders)""")
def confidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = roles.table(spark, sf_dir, "orders").withColumn("c", (50 + F.col("o_orderkey") % 50).cast("double") / 100)
    days = F.date_diff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("job_id"), sop.decayed(F.col("c"), days, F.col("o_orderpriority") == "1-URGENT").alias("effective"))
