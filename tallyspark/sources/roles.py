"""Role views: trade tables read as financial facts, entities, jobs and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE, DISCOUNT, TAX, QUANTITY = "decimal(12,2)", "decimal(4,2)", "decimal(4,2)", "decimal(6,0)"

#: Canonical names in order, their category, and the aggregate over line items that plays each.
CANONICAL = [
    ("revenue", "income_statement", "p"),
    ("cogs", "income_statement", "p * d"),
    ("gross_profit", "income_statement", "p * (1 - d)"),
    ("tax_expense", "income_statement", "p * t"),
    ("net_income", "income_statement", "case when l_returnflag <> 'R' then p * (1 - d) else 0 end - p * t"),
    ("cash", "balance_sheet", "case when l_linestatus = 'O' then p else 0 end"),
    ("total_debt", "balance_sheet", "case when l_returnflag = 'A' then p else 0 end"),
    ("ebit", "income_statement", "p * (1 - d) - p * t"),
    ("interest_expense", "debt", "q * 10"),
    ("capex", "cash_flow", "case when q > 45 then p else 0 end"),
    ("cfo", "cash_flow", "case when l_linestatus = 'F' then p * (1 - d) else 0 end"),
    ("total_current_assets", "balance_sheet", "case when q <= 25 then p else 0 end"),
    ("total_current_liabilities", "balance_sheet", "case when d >= 0.08 then p else 0 end"),
    ("accounts_receivable", "balance_sheet", "case when l_returnflag = 'N' and q < 10 then p else 0 end"),
]
NAMES = [c[0] for c in CANONICAL]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with exact decimals p, d, t, q and the year of shipping."""
    return table(spark, sf_dir, "lineitem").withColumns({
        "p": F.col("l_extendedprice").cast(PRICE), "d": F.col("l_discount").cast(DISCOUNT), "t": F.col("l_tax").cast(TAX), "q": F.col("l_quantity").cast(QUANTITY),
        "yr": F.year("l_shipdate"),
    })


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, yr, n, last and one decimal column for each canonical name."""
    sums = [F.sum(F.expr(e).cast("decimal(20,4)")).cast("decimal(20,4)").alias(name) for name, _, e in CANONICAL]
    return items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("entity_id"), "yr").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("created_at"), *sums)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, period, canonical_name, value, confidence, category, created_at, k; about one in eleven facts is missing."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("canonical_name"), F.lit(cat).alias("category"), F.col(name).alias("value")) for k, (name, cat, _) in enumerate(CANONICAL)])
    long = wide(spark, sf_dir).select("entity_id", "yr", "n", "created_at", F.inline(rows))
    there = (F.col("entity_id") * 31 + F.col("yr") * 17 + F.col("k") * 7) % 11 != 0
    confidence = (50 + (F.col("n") * 7 + F.col("k") * 11) % 50).cast("double") / 100
    return long.where(there).select("entity_id", F.concat(F.lit("FY"), F.col("yr").cast("string")).alias("period"), "canonical_name", "value", confidence.alias("confidence"), "category", "created_at", "k", "yr")


#: Sums over an entity's line items of a year that the statement names below are made of.
BASES = {"s_p": "p", "s_d": "p * d", "s_t": "p * t", "s_q": "q", "s_r": "case when l_returnflag = 'R' then p else 0 end", "s_a": "case when l_returnflag = 'A' then p else 0 end", "s_o": "case when l_linestatus = 'O' then p else 0 end"}
#: A factor near one, so that identities hold here and fail there.
NEAR = "cast(case (entity_id * 7 + yr * 3 + {k}) % 6 when 0 then 0.88 when 1 then 0.98 when 2 then 1.02 else 1.00 end as decimal(4,2))"
#: Statement names and what plays each; c is an amount of the entity.
STATEMENT = {
    "cash": "s_o", "ending_cash": "s_o * near", "beginning_cash": "s_o - s_r", "net_change_cash": "s_r * near", "retained_earnings": "c * (yr - 1990) * 10", "net_income": "c * 12 * near", "net_income_cf": "c * 12",
    "dividends_paid": "case when yr % 4 <> 1 then c * -2 end", "total_equity": "c * (yr - 1980) * 10", "total_debt": "s_a + s_r", "senior_debt": "s_a * near", "term_loan_a": "s_r", "revolver_balance": "case when entity_id % 9 = 0 then s_q end",
    "depreciation_and_amortization": "s_t", "depreciation_cf": "s_t * near * -1", "depreciation": "case when yr % 2 = 0 then s_t else 0 end", "ppe": "c * (yr - 1970) * 100", "capex": "(c * 100 + s_t) * near * -1",
    "working_capital": "(s_p - s_d) * near", "current_assets": "s_p", "current_liabilities": "s_d", "interest_expense": "s_q", "total_interest": "s_q * near * -1",
    "debt_opening_balance": "s_p", "debt_drawdown": "case when yr % 5 <> 0 then s_d end", "principal_payment": "case when yr % 3 = 0 then 0 else s_t * -1 end", "debt_mandatory_repayment": "s_t * -1", "debt_closing_balance": "(s_p + s_d - s_t) * near",
    "interest_payment": "s_q * -1", "debt_service": "case when entity_id % 17 = 0 then 0 else (s_t + s_q) * near * -1 end", "cfads": "(s_t + s_q) * 2", "dscr_project_finance": "case when entity_id % 5 = 0 then 0 else 2 * near end", "dscr": "1.5 * near", "distribution_lock_up": "1.4",
    "cfo": "s_p", "fcf": "(s_p - c * 100 - s_t) * near", "revenue": "s_p", "product_revenue": "s_p - s_r", "service_revenue": "s_r * near", "total_assets": "s_p * 2", "total_current_assets": "s_p", "total_non_current_assets": "s_p * near",
    "total_liabilities": "s_d + s_t", "total_current_liabilities": "s_d * near", "total_non_current_liabilities": "s_t", "cfae": "(s_t + s_q) * near - s_r * 0.1", "equity_contribution": "s_p", "total_investment": "(s_p + s_a + s_r) * near",
    "llcr": "1.6 * near", "plcr": "1.6 * near", "dsra_balance": "(s_t + s_q) * near", "cogs": "case when entity_id % 4 <> 0 then s_d end", "gross_profit": "case when entity_id % 4 <> 0 then s_p - s_d end", "ebit": "case when entity_id % 4 <> 3 then s_p - s_t end", "ebitda": "case when entity_id % 8 = 1 then s_p end", "tax_expense": "s_t", "cfi": "case when yr % 2 = 0 then s_r * -1 end",
    "development_costs": "case when entity_id % 3 = 0 then s_d end", "construction_cost": "case when yr < 1995 then s_a end", "arr": "case when entity_id % 6 = 5 then s_p end", "mrr": "case when entity_id % 6 = 5 and yr > 1994 then s_q end", "long_term_debt": "case when entity_id % 2 = 0 then s_a end",
    "equity_irr": "case when entity_id % 2 = 0 then (entity_id + yr) % 50 else 0.01 * ((entity_id + yr) % 50) end",
}


#: Names that a third of the entities, or a fifth, don't have.
PROJECT = ["cfads", "cfae", "dscr", "dscr_project_finance", "debt_service", "equity_irr", "llcr", "plcr", "dsra_balance", "distribution_lock_up"]
INCOME = ["revenue", "cogs", "gross_profit", "net_income", "ebitda", "ebit"]


def statement_columns() -> dict[str, str]:
    """SQL of each statement name over entity_id, yr and the sums; about one in thirteen values is missing."""
    out = {}
    for k, (name, e) in enumerate(STATEMENT.items()):
        e = e.replace("near", NEAR.format(k=k)).replace("c * ", "cast(entity_id % 997 + 10 as decimal(6,0)) * ")
        lacks = " and entity_id % 3 <> 1" if name in PROJECT else " and entity_id % 5 <> 2" if name in INCOME else ""
        out[name] = f"cast(case when (entity_id * 31 + yr * 17 + {k} * 7) % 13 <> 0{lacks} then {e} end as decimal(20,4))"
    return out


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, yr and a decimal column for each statement name."""
    sums = [F.sum(F.expr(e).cast("decimal(20,4)")).cast("decimal(20,4)").alias(name) for name, e in BASES.items()]
    rows = items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("entity_id"), "yr").agg(*sums)
    return rows.select("entity_id", "yr", *[F.expr(e).alias(name) for name, e in statement_columns().items()])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, industry (region), nation, fiscal_year_end and currency."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("r_name").alias("industry"), F.col("n_name").alias("nation"),
        (F.col("n_nationkey") % 12 + 1).alias("fiscal_year_end"), F.element_at(F.array(*map(F.lit, ("USD", "EUR", "GBP", "JPY", "CHF"))), F.col("r_regionkey") + 1).alias("currency"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, entity_id, status, cost, grade, created_at."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(14,2)").alias("cost"), F.col("o_orderpriority").alias("grade"), F.col("o_orderdate").alias("created_at"))


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each line item: several for a key, so that the latest must be found; seq_* break ties."""
    return items(spark, sf_dir).select(
        F.col("l_suppkey").alias("entity_id"), F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("canonical_name"), F.concat(F.lit("FY"), F.col("yr").cast("string")).alias("period"),
        F.col("p").alias("value"), ((F.col("d") * 5 + F.lit(0.5).cast("decimal(2,1)")).cast("double")).alias("confidence"), F.col("l_shipdate").alias("created_at"),
        F.col("l_orderkey").alias("seq_1"), F.col("l_linenumber").alias("seq_2"), F.col("l_partkey").alias("seq_3"),
    )


def double(c: Column | str, scale: int = 2) -> Column:
    """Round half up at scale through decimals, as a double: equal in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(30,10)"), scale).cast("double")
