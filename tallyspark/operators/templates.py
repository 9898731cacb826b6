"""Completeness of statements by nine templates, the kind of model an entity's names speak of, and quality weights for each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.roles import double

#: By statement, names two of which show that it is there, and its items with weights, core ones first.
TEMPLATES: dict[str, tuple[list[str], dict[str, float], dict[str, float]]] = {
    "income_statement": (
        ["revenue", "cogs", "gross_profit", "net_income", "ebitda", "ebit"],
        {"revenue": 1.0, "cogs": 0.9, "gross_profit": 0.95, "ebitda": 0.85, "ebit": 0.8, "net_income": 0.95},
        {"depreciation": 0.6, "interest_expense": 0.7, "tax_expense": 0.65, "ebt": 0.6, "opex": 0.7},
    ),
    "balance_sheet": (
        ["total_assets", "total_liabilities", "total_equity", "current_assets"],
        {"total_assets": 1.0, "total_liabilities": 0.95, "total_equity": 0.95, "current_assets": 0.8, "cash": 0.85, "current_liabilities": 0.8},
        {"long_term_debt": 0.75, "accounts_receivable": 0.7, "accounts_payable": 0.7, "ppe": 0.65},
    ),
    "cash_flow": (["cfo", "cfi", "cff", "net_change_cash", "fcf"], {"cfo": 1.0, "cfi": 0.9, "cff": 0.9, "net_change_cash": 0.85, "capex": 0.8}, {"fcf": 0.75}),
    "project_finance": (["cfads", "cfae", "dscr", "debt_service", "equity_irr"], {"cfads": 1.0, "dscr": 0.95, "debt_service": 0.9, "cfae": 0.85}, {"llcr": 0.7, "plcr": 0.65, "dsra_balance": 0.6}),
    "debt_schedule": (
        ["debt_opening_balance", "debt_closing_balance", "debt_service", "interest_expense"],
        {"debt_opening_balance": 0.9, "debt_closing_balance": 0.9, "debt_service": 0.85, "interest_expense": 0.8},
        {"debt_drawdown": 0.7, "debt_mandatory_repayment": 0.7},
    ),
    "construction_budget": (
        ["total_investment", "development_costs", "equity_contribution", "construction_cost"],
        {"total_investment": 1.0, "development_costs": 0.9, "equity_contribution": 0.85, "construction_cost": 0.8},
        {"contingency": 0.6, "land_cost": 0.5},
    ),
    "covenant_compliance": (["dscr", "llcr", "plcr", "debt_covenants"], {"dscr": 1.0, "llcr": 0.9}, {"plcr": 0.85, "debt_covenants": 0.7}),
    "returns_analysis": (["equity_irr", "pre_tax_irr", "post_tax_irr", "equity_returns"], {"equity_irr": 1.0, "pre_tax_irr": 0.85}, {"post_tax_irr": 0.8, "equity_returns": 0.7}),
    "saas_metrics": (
        ["arr", "mrr", "net_revenue_retention"],
        {"arr": 1.0, "mrr": 0.9, "net_revenue_retention": 0.8},
        {"cac": 0.7, "ltv": 0.7, "burn_rate": 0.6, "churn_rate": 0.6, "customer_count": 0.5, "ltv_cac_ratio": 0.5, "cash_runway_months": 0.5},
    ),
}
#: Names that speak of each kind of model.
INDICATORS = {
    "saas": ["arr", "mrr", "churn_rate", "ltv", "cac", "net_revenue_retention", "burn_rate"],
    "pf": ["cfads", "cfae", "dscr", "debt_service", "equity_irr", "llcr", "plcr", "dsra_balance"],
    "income": ["revenue", "cogs", "gross_profit", "net_income", "ebitda", "ebit"],
    "construction": ["total_investment", "development_costs", "equity_contribution", "construction_cost", "contingency"],
}
#: Weights of mapping, validation, completeness, series and cells.
MODEL_WEIGHTS = {
    "corporate": (0.25, 0.20, 0.20, 0.15, 0.20),
    "project_finance": (0.20, 0.25, 0.15, 0.20, 0.20),
    "construction_only": (0.30, 0.15, 0.25, 0.10, 0.20),
    "mixed": (0.20, 0.20, 0.20, 0.20, 0.20),
    "saas": (0.20, 0.20, 0.25, 0.15, 0.20),
}
DIMENSIONS = ("mapping", "validation", "completeness", "series", "cells")


def template_rows() -> list[tuple[str, str, float | None, bool, bool]]:
    """statement, name, weight (null if the name only detects), core, detects."""
    out = []
    for statement, (detect, core, other) in TEMPLATES.items():
        out += [(statement, n, w, True, n in detect) for n, w in core.items()] + [(statement, n, w, False, n in detect) for n, w in other.items()]
        out += [(statement, n, None, False, True) for n in detect if n not in core and n not in other]
    return out


def model_type(names: Column, project_finance: Column | None = None) -> Column:
    """The kind of model that an array of names speaks of."""
    n = {k: F.size(F.array_intersect(names, F.array(*map(F.lit, v)))) for k, v in INDICATORS.items()}
    said = F.coalesce(project_finance, F.lit(False)) if project_finance is not None else F.lit(False)
    return (
        F.when((n["saas"] >= 2) & (n["pf"] >= 3), "mixed").when(n["saas"] >= 2, "saas")
        .when((said | (n["pf"] >= 2)) & (n["construction"] >= 2) & (n["income"] <= 1), "construction_only")
        .when((n["pf"] >= 3) & (n["income"] >= 2), "mixed").when((n["pf"] >= 3) | said, "project_finance").otherwise("corporate")
    )


def by_statement(facts: DataFrame, key: str = "entity_id", period: str = "period") -> DataFrame:
    """E: of each key's statements that are there: model type, found and expected items, raw, weighted and core coverage, coverage of periods, items in less than half of these, and the blend of weighted and period coverage.

    facts: key, period, canonical_name. Repeated facts count once. A construction-only model has no income statement.
    """
    spark: SparkSession = facts.sparkSession
    template = spark.createDataFrame(template_rows(), "statement string, canonical_name string, weight double, core boolean, detects boolean").withColumn("weight", F.col("weight").cast("decimal(4,2)"))
    size = template.where("weight is not null").groupBy("statement").agg(F.sum("weight").alias("weights"), F.count("*").alias("expected"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("core_weights"))
    fills = facts.groupBy(key, "canonical_name").agg(F.count_distinct(period).alias("fill"))
    keys = facts.groupBy(key).agg(F.count_distinct(period).alias("periods"), model_type(F.collect_set("canonical_name")).alias("model_type"))
    hits = fills.join(F.broadcast(template), "canonical_name").join(keys, key)  # the template has 80 rows
    w = F.coalesce(F.col("weight"), F.lit(0).cast("decimal(4,2)"))
    item = F.col("weight").isNotNull()
    rows = hits.groupBy(key, "statement").agg(
        F.first("model_type").alias("model_type"), F.first("periods").alias("periods"), F.count_if("detects").alias("n"), F.count_if(item).alias("found"), F.sum(w).alias("w"),
        F.sum(F.when(F.col("core"), w).otherwise(0)).alias("cw"), F.sum(F.when(item, F.col("fill")).otherwise(0)).alias("filled"), F.count_if(item & (F.col("fill") * 2 < F.col("periods"))).alias("sparse_items"),
    )
    rows = rows.where("n >= 2 and not (model_type = 'construction_only' and statement = 'income_statement')").join(F.broadcast(size), "statement")
    div = lambda a, b: double(F.try_divide(a.cast("double"), b.cast("double")), 4)
    c = F.col
    rows = rows.withColumns({"raw": div(c("found"), c("expected")), "weighted": div(c("w"), c("weights")), "core": div(c("cw"), c("core_weights")), "coverage": F.when(c("found") > 0, div(c("filled"), c("found") * c("periods")))})
    blend = double(F.lit(0.7) * c("weighted") + F.lit(0.3) * c("coverage"), 4)
    return rows.withColumn("blended", F.coalesce(blend, "weighted")).select(key, "statement", "model_type", "found", "expected", "raw", "weighted", "core", "coverage", "sparse_items", "blended")


def overall(facts: DataFrame, key: str = "entity_id", period: str = "period") -> DataFrame:
    """E: of each key: model type, statements found, items found and expected (each name once), overall score. A key without a statement has no row."""
    found = by_statement(facts, key, period)
    template = facts.sparkSession.createDataFrame([r[:2] for r in template_rows() if r[2] is not None], "statement string, canonical_name string")
    names = found.select(key, "statement").join(F.broadcast(template), "statement").select(key, "canonical_name").distinct()
    have = facts.select(key, "canonical_name", F.lit(True).alias("_has")).distinct()
    counts = names.join(have, [key, "canonical_name"], "left").groupBy(key).agg(F.count("*").alias("expected"), F.count("_has").alias("found"))
    score = F.sum(F.col("blended").cast("decimal(6,4)") * F.col("expected")).cast("double") / F.sum("expected").cast("double")
    rows = found.groupBy(key).agg(F.first("model_type").alias("model_type"), F.array_join(F.array_sort(F.collect_set("statement")), "|").alias("statements"), double(score, 4).alias("score"))
    return rows.join(counts, key)


def quality_by_model(rows: DataFrame, model: str = "model_type") -> DataFrame:
    """F: score, grade and label with the weights of each row's kind of model; an unknown kind counts as corporate. Without cells, their weight goes to the others in proportion."""
    weights = [F.coalesce(*[F.when(F.col(model) == k, w[i]) for k, w in MODEL_WEIGHTS.items()], F.lit(MODEL_WEIGHTS["corporate"][i])) for i in range(5)]
    held = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(d))) for d in DIMENSIONS]
    four = sum((h * w for h, w in zip(held[:4], weights[:4])), F.lit(0.0))
    rest = sum(weights[:4], F.lit(0.0))
    score = double(F.when(F.col("cells").isNull(), four / rest).otherwise(four + held[4] * weights[4]), 6)
    rank = F.when(F.col("score") >= 0.90, 5).when(F.col("score") >= 0.75, 4).when(F.col("score") >= 0.60, 3).when(F.col("score") >= 0.40, 2).otherwise(1)
    cap = F.least(F.when(F.col("cells") < 0.5, 2).otherwise(5), F.when(F.col("mismatch") > 0.3, 3).otherwise(5))
    label = F.when(F.col("score") >= 0.80, "trustworthy").when(F.col("score") >= 0.55, "needs_review").otherwise("unreliable")
    return rows.withColumn("score", score).withColumn("grade", F.element_at(F.array(*[F.lit(g) for g in "FDCBA"]), F.least(rank, cap))).withColumn("label", label)
