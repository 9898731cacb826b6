"""Statement checks over all suppliers' years, and their SQL, written check by check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as op
from ..operators import templates
from ..sources import roles
from .base import ITEMS, dbl, query, with_
from .rules import DIMENSIONS as JOB_DIMENSIONS
from .rules import job_dimensions

STATEMENTS = ITEMS + ", sums AS (SELECT l_suppkey AS entity_id, yr, {} FROM items GROUP BY ALL), wide AS (SELECT entity_id, yr, {} FROM sums)".format(
    ", ".join(f"CAST(SUM(CAST({e} AS DECIMAL(20,4))) AS DECIMAL(20,4)) AS {name}" for name, e in roles.BASES.items()),
    ", ".join(f"{e} AS {name}" for name, e in roles.statement_columns().items()),
)
WIDE = STATEMENTS + """, w AS (SELECT *, LAG(retained_earnings) OVER p AS re0, LAG(ppe) OVER p AS ppe0, LAG(total_equity) OVER p AS eq0, ABS(COALESCE(dividends_paid, 0)) AS div,
 CASE WHEN depreciation <> 0 THEN depreciation ELSE depreciation_and_amortization END AS dep, CASE WHEN principal_payment <> 0 THEN principal_payment ELSE debt_mandatory_repayment END AS repaid,
 CASE WHEN dscr_project_finance <> 0 THEN dscr_project_finance ELSE dscr END AS cover, CASE WHEN debt_service <> 0 THEN ABS(debt_service) END AS ds,
 (senior_debt IS NOT NULL)::INT + (term_loan_a IS NOT NULL)::INT + (revolver_balance IS NOT NULL)::INT + (long_term_debt IS NOT NULL)::INT AS tranches, COALESCE(senior_debt, 0) + COALESCE(term_loan_a, 0) + COALESCE(revolver_balance, 0) + COALESCE(long_term_debt, 0) AS tranche_sum,
 CASE WHEN product_revenue IS NOT NULL AND service_revenue IS NOT NULL THEN product_revenue + service_revenue END AS revenue_sum,
 CASE WHEN total_investment <> 0 THEN CAST(total_debt AS DOUBLE) / CAST(total_investment AS DOUBLE) END AS ltc, CASE WHEN ABS(equity_irr) > 1 THEN CAST(equity_irr AS DOUBLE) / 100 ELSE CAST(equity_irr AS DOUBLE) END AS irr
 FROM wide WINDOW p AS (PARTITION BY entity_id ORDER BY yr))"""


def _row(rule: str, item: str, passed: str, actual: str, expected: str, hard: bool = False) -> str:
    worst = "error" if hard else "warning"
    return f"SELECT entity_id, yr, '{rule}' AS rule, '{item}' AS item, {passed} AS passed, CASE WHEN {passed} THEN 'warning' ELSE '{worst}' END AS severity, ROUND(CAST({actual} AS DOUBLE), 4) AS actual, ROUND(CAST({expected} AS DOUBLE), 4) AS expected FROM w"


def _same(rule: str, item: str, a: str, b: str, tolerance: float, hard: bool = False, shown: tuple[str, str] | None = None, floor: float = 1) -> str:
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    # greatest() passes over nulls here
    passed = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ABS({x} - {y}) / GREATEST(ABS({x}), ABS({y}), {floor}::DOUBLE) <= {tolerance}::DOUBLE END"
    return _row(rule, item, passed, *(shown or (a, b)), hard)


CROSS = with_(WIDE) + ", found AS (" + " UNION ALL ".join([
    _same("cross_statement:cash_bs_cf", "cash", "cash", "ending_cash", 0.01),
    _same("cross_statement:retained_earnings_ni", "retained_earnings", "(retained_earnings - re0)", "(net_income - div)", 0.02),
    _same("cross_statement:total_debt_schedule", "total_debt", "total_debt", "(CASE WHEN tranches >= 2 THEN tranche_sum END)", 0.02),
    _same("cross_statement:depreciation_is_cf", "depreciation_and_amortization", "ABS(depreciation_and_amortization)", "ABS(depreciation_cf)", 0.03, shown=("depreciation_and_amortization", "depreciation_cf")),
    _same("cross_statement:capex_ppe_change", "capex", "ABS(capex)", "(ppe - ppe0 + ABS(dep))", 0.10, shown=("capex", "(ppe - ppe0 + ABS(dep))")),
    _same("cross_statement:working_capital", "working_capital", "working_capital", "(current_assets - current_liabilities)", 0.01),
    _same("cross_statement:interest_is_ds", "interest_expense", "ABS(interest_expense)", "ABS(total_interest)", 0.05, shown=("interest_expense", "total_interest")),
    _same("cross_statement:equity_reconciliation", "total_equity", "total_equity", "(eq0 + net_income - div)", 0.02),
    _same("cross_statement:net_income_cf_vs_is", "net_income_cf", "net_income_cf", "net_income", 0.02, True),
    _same("cross_statement:cash_roll_forward", "ending_cash", "ending_cash", "(beginning_cash + net_change_cash)", 0.01, True),
    _same("cross_statement:debt_roll_forward", "debt_closing_balance", "debt_closing_balance", "(debt_opening_balance + ABS(COALESCE(debt_drawdown, 0)) - ABS(repaid))", 0.01, True),
    _same("cross_statement:debt_service_identity", "debt_service", "ABS(debt_service)", "(ABS(principal_payment) + ABS(interest_payment))", 0.01, True),
    _same("cross_statement:dscr_pf_consistency", "dscr_project_finance", "dscr_project_finance", "(CAST(ABS(cfads) AS DOUBLE) / CAST(ds AS DOUBLE))", 0.03, floor=0.001),
    _same("cross_statement:fcf_consistency", "fcf", "fcf", "(cfo - ABS(capex))", 0.02),
    _same("additivity:revenue_components", "revenue", "revenue", "revenue_sum", 0.03, shown=("revenue_sum", "revenue")),
    _same("additivity:total_assets", "total_assets", "total_assets", "(total_current_assets + total_non_current_assets)", 0.03),
    _same("additivity:total_liabilities", "total_liabilities", "total_liabilities", "(total_current_liabilities + total_non_current_liabilities)", 0.03),
    _row("pf_covenant:dscr_distribution_lock_up", "dscr_project_finance", "(cover >= distribution_lock_up)", "cover", "distribution_lock_up", True),
    _row("pf_covenant:cfae_positive", "cfae", "(cfae >= 0)", "cfae", "0"),
    _same("pf_check:sources_uses", "total_investment", "total_investment", "(equity_contribution + total_debt)", 0.03, shown=("(equity_contribution + total_debt)", "total_investment")),
    _row("pf_check:loan_to_cost_plausibility", "loan_to_cost", "(ltc <= 0.9::DOUBLE)", "ltc", "0.9"),
    _same("pf_check:cfae_consistency", "cfae", "cfae", "(cfads - ABS(debt_service))", 0.02, shown=("cfae", "ROUND(CAST(cfads - ABS(debt_service) AS DOUBLE), 0)")),
    _row("pf_check:llcr_vs_dscr", "llcr", "(llcr >= cover)", "llcr", "cover"),
    _row("pf_check:plcr_vs_llcr", "plcr", "(plcr >= llcr)", "plcr", "llcr"),
    _row("pf_check:dsra_adequacy", "dsra_balance", "(dsra_balance >= ds * 0.95)", "dsra_balance", "ds"),
    _row("pf_check:equity_irr_plausibility", "equity_irr", "(irr BETWEEN 0.03::DOUBLE AND 0.4::DOUBLE)", "irr", "NULL"),
]) + ") SELECT * FROM found WHERE passed IS NOT NULL"


@query(CROSS)
def statement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: all 26 checks between statements, for every supplier and year."""
    return op.cross_statement(roles.statements(spark, sf_dir))


def _values(rows: list[tuple]) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)


def _count(kind: str) -> str:
    return f"len(list_intersect(names, {templates.INDICATORS[kind]!r}))"


LONG = STATEMENTS + ", facts AS ({})".format(" UNION ALL ".join(f"SELECT entity_id, yr AS period, '{n}' AS canonical_name FROM wide WHERE {n} IS NOT NULL" for n in roles.STATEMENT))
FOUND = with_(LONG, f"template(statement, canonical_name, weight, core, detects) AS (SELECT col0, col1, CAST(col2 AS DECIMAL(4,2)), col3, col4 FROM (VALUES {_values(templates.template_rows())}))") + f""",
size AS (SELECT statement, SUM(weight) AS weights, COUNT(*) AS expected, SUM(weight) FILTER (core) AS core_weights FROM template WHERE weight IS NOT NULL GROUP BY 1),
fills AS (SELECT entity_id, canonical_name, COUNT(DISTINCT period) AS fill FROM facts GROUP BY 1, 2),
keys AS (SELECT entity_id, COUNT(DISTINCT period) AS periods, list(DISTINCT canonical_name) AS names FROM facts GROUP BY 1),
kinds AS (SELECT entity_id, periods, CASE WHEN {_count('saas')} >= 2 AND {_count('pf')} >= 3 THEN 'mixed' WHEN {_count('saas')} >= 2 THEN 'saas' WHEN {_count('pf')} >= 2 AND {_count('construction')} >= 2 AND {_count('income')} <= 1 THEN 'construction_only'
 WHEN {_count('pf')} >= 3 AND {_count('income')} >= 2 THEN 'mixed' WHEN {_count('pf')} >= 3 THEN 'project_finance' ELSE 'corporate' END AS model_type FROM keys),
hits AS (SELECT entity_id, statement, model_type, periods, COUNT(*) FILTER (detects) AS n, COUNT(weight) AS found, COALESCE(SUM(weight), 0) AS w, COALESCE(SUM(weight) FILTER (core), 0) AS cw, COALESCE(SUM(fill) FILTER (weight IS NOT NULL), 0) AS filled,
 COUNT(*) FILTER (weight IS NOT NULL AND fill * 2 < periods) AS sparse_items FROM fills JOIN template USING (canonical_name) JOIN kinds USING (entity_id) GROUP BY ALL),
parts AS (SELECT *, {dbl('CAST(found AS DOUBLE) / expected', 4)} AS raw, {dbl('CAST(w AS DOUBLE) / CAST(weights AS DOUBLE)', 4)} AS weighted, {dbl('CAST(cw AS DOUBLE) / CAST(core_weights AS DOUBLE)', 4)} AS core, CASE WHEN found > 0 THEN {dbl('CAST(filled AS DOUBLE) / (found * periods)', 4)} END AS coverage
 FROM hits JOIN size USING (statement) WHERE n >= 2 AND NOT (model_type = 'construction_only' AND statement = 'income_statement')),
found AS (SELECT entity_id, statement, model_type, found, expected, raw, weighted, core, coverage, sparse_items, COALESCE({dbl('0.7::DOUBLE * weighted + 0.3::DOUBLE * coverage', 4)}, weighted) AS blended FROM parts)
"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in roles.STATEMENT])
    return roles.statements(spark, sf_dir).select("entity_id", F.col("yr").alias("period"), F.explode(F.array_compact(there)).alias("canonical_name"))


@query(FOUND + "SELECT * FROM found")
def completeness_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: the nine templates over all suppliers' years."""
    return templates.by_statement(_names(spark, sf_dir))


@query(FOUND + f"""SELECT entity_id, model_type, statements, score, e AS expected, f AS found FROM (SELECT entity_id, model_type, string_agg(statement, '|' ORDER BY statement) AS statements, {dbl('CAST(SUM(CAST(blended AS DECIMAL(6,4)) * expected) AS DOUBLE) / SUM(expected)', 4)} AS score FROM found GROUP BY 1, 2)
JOIN (SELECT entity_id, COUNT(*) AS e, COUNT(fill) AS f FROM (SELECT DISTINCT entity_id, canonical_name FROM found JOIN template USING (statement) WHERE weight IS NOT NULL) LEFT JOIN fills USING (entity_id, canonical_name) GROUP BY 1) USING (entity_id)""")
def completeness_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.overall(_names(spark, sf_dir))


KINDS = ["corporate", "project_finance", "construction_only", "mixed", "saas", "other"]
SETS = ", ".join(f"('{k}', {', '.join(f'{w}::DOUBLE' for w in ws)})" for k, ws in templates.MODEL_WEIGHTS.items())
QUALITY = f"""WITH sets(model_type, wm, wv, wc, ws, wl) AS (VALUES {SETS}), q AS (SELECT *, {KINDS!r}[job_id % 6 + 1] AS model_type FROM ({JOB_DIMENSIONS})),
d AS (SELECT q.job_id, q.model_type, cells, mismatch, 0.0::DOUBLE + greatest(0.0, least(1.0, mapping)) * s.wm + greatest(0.0, least(1.0, validation)) * s.wv + greatest(0.0, least(1.0, completeness)) * s.wc + greatest(0.0, least(1.0, series)) * s.ws AS four, 0.0::DOUBLE + s.wm + s.wv + s.wc + s.ws AS rest, s.wl
 FROM q JOIN sets s ON s.model_type = CASE WHEN q.model_type = 'other' THEN 'corporate' ELSE q.model_type END),
s AS (SELECT *, {dbl("CASE WHEN cells IS NULL THEN four / rest ELSE four + greatest(0.0, least(1.0, cells)) * wl END", 6)} AS score FROM d)
SELECT job_id, model_type, score, ['F', 'D', 'C', 'B', 'A'][least(CASE WHEN score >= 0.9 THEN 5 WHEN score >= 0.75 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 ELSE 1 END, CASE WHEN cells < 0.5 THEN 2 ELSE 5 END, CASE WHEN mismatch > 0.3 THEN 3 ELSE 5 END)] AS grade,
 CASE WHEN score >= 0.8 THEN 'trustworthy' WHEN score >= 0.55 THEN 'needs_review' ELSE 'unreliable' END AS label FROM s"""


@query(QUALITY)
def quality_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F: all jobs, with the weights of their kind of model."""
    rows = job_dimensions(spark, sf_dir).withColumn("model_type", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("job_id") % 6 + 1).cast("int")))
    return templates.quality_by_model(rows).select("job_id", "model_type", "score", "grade", "label")
