"""Checks between statements of one period, and with the period before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that add up to total debt, and to revenue.
DEBT = ["senior_debt", "subordinated_debt", "term_loan_a", "term_loan_b", "bonds_payable", "notes_payable", "revolver_balance", "revolving_credit", "long_term_debt", "short_term_debt", "unitranche", "delayed_draw_term_loan", "mezzanine_debt", "convertible_notes", "safe_notes"]
REVENUE = ["product_revenue", "service_revenue", "subscription_revenue", "license_revenue", "transaction_revenue", "recurring_revenue", "non_recurring_revenue", "rental_income", "interest_income", "other_revenue"]
#: Names whose value of the period before is read.
BEFORE = ["retained_earnings", "ppe", "total_equity"]


@dataclass(frozen=True)
class Check:
    """A rule about an item: whether it passed (null where an operand is missing, which leaves no row), actual and expected; hard: a failure is an error."""

    rule: str
    item: str
    passed: Column
    actual: Column
    expected: Column
    hard: bool = False


def apart(a: Column, b: Column, floor: float = 1.0) -> Column:
    """the difference relative to the larger amount, at least floor."""
    x, y = a.cast("double"), b.cast("double")
    return F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(floor))


def total(have: set[str], parts: list[str], least: int = 2) -> Column:
    """Sum of the parts that are there; null below least of them."""
    parts = [p for p in parts if p in have]
    n = sum(((F.col(p).isNotNull()).cast("int") for p in parts), F.lit(0))
    return F.when(n >= least, sum((F.coalesce(F.col(p), F.lit(0).cast("decimal(20,4)")) for p in parts), F.lit(0).cast("decimal(20,4)")))


def cross_checks(have: set[str]) -> list[Check]:
    """C: the 26 checks over columns named in have; a name that isn't there is null. Where two names stand for one, zero counts as missing in the first."""
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("decimal(20,4)")
    old = lambda name: F.col(f"_before_{name}") if name in have else F.lit(None).cast("decimal(20,4)")
    either = lambda a, b: F.coalesce(F.nullif(c(a), F.lit(0)), c(b))
    size = lambda x: F.abs(c(x) if isinstance(x, str) else x)
    zero = F.lit(0).cast("decimal(20,4)")
    number = lambda x: F.lit(x).cast("decimal(20,4)")
    out: list[Check] = []

    def same(rule: str, item: str, a: Column, b: Column, tolerance: float, hard: bool = False, show: tuple[Column, Column] | None = None, floor: float = 1.0) -> None:
        out.append(Check(rule, item, apart(a, b, floor) <= tolerance, *(show or (a, b)), hard))

    dividends = F.abs(F.coalesce(c("dividends_paid"), zero))
    worn, repaid = either("depreciation", "depreciation_and_amortization"), either("principal_payment", "debt_mandatory_repayment")
    service, cover = F.nullif(c("debt_service"), zero), either("dscr_project_finance", "dscr")
    same("cross_statement:cash_bs_cf", "cash", c("cash"), c("ending_cash"), 0.01)
    same("cross_statement:retained_earnings_ni", "retained_earnings", c("retained_earnings") - old("retained_earnings"), c("net_income") - dividends, 0.02)
    same("cross_statement:total_debt_schedule", "total_debt", c("total_debt"), total(have, DEBT), 0.02)
    same("cross_statement:depreciation_is_cf", "depreciation_and_amortization", size("depreciation_and_amortization"), size("depreciation_cf"), 0.03, show=(c("depreciation_and_amortization"), c("depreciation_cf")))
    bought = c("ppe") - old("ppe") + F.abs(worn)
    same("cross_statement:capex_ppe_change", "capex", size("capex"), bought, 0.10, show=(c("capex"), bought))
    same("cross_statement:working_capital", "working_capital", c("working_capital"), c("current_assets") - c("current_liabilities"), 0.01)
    same("cross_statement:interest_is_ds", "interest_expense", size("interest_expense"), size("total_interest"), 0.05, show=(c("interest_expense"), c("total_interest")))
    same("cross_statement:equity_reconciliation", "total_equity", c("total_equity"), old("total_equity") + c("net_income") - dividends, 0.02)
    same("cross_statement:net_income_cf_vs_is", "net_income_cf", c("net_income_cf"), c("net_income"), 0.02, True)
    same("cross_statement:cash_roll_forward", "ending_cash", c("ending_cash"), c("beginning_cash") + c("net_change_cash"), 0.01, True)
    same("cross_statement:debt_roll_forward", "debt_closing_balance", c("debt_closing_balance"), c("debt_opening_balance") + F.abs(F.coalesce(c("debt_drawdown"), zero)) - F.abs(repaid), 0.01, True)
    same("cross_statement:debt_service_identity", "debt_service", size("debt_service"), size("principal_payment") + size("interest_payment"), 0.01, True)
    ratio = size("cfads").cast("double") / F.abs(service).cast("double")
    same("cross_statement:dscr_pf_consistency", "dscr_project_finance", c("dscr_project_finance"), ratio, 0.03, floor=0.001, show=(c("dscr_project_finance"), F.round(ratio, 4)))
    same("cross_statement:fcf_consistency", "fcf", c("fcf"), c("cfo") - size("capex"), 0.02)
    parts = total(have, REVENUE)
    same("additivity:revenue_components", "revenue", c("revenue"), parts, 0.03, show=(parts, c("revenue")))
    for whole in ("assets", "liabilities"):
        same(f"additivity:total_{whole}", f"total_{whole}", c(f"total_{whole}"), c(f"total_current_{whole}") + c(f"total_non_current_{whole}"), 0.03)
    out.append(Check("pf_covenant:dscr_distribution_lock_up", "dscr_project_finance", cover >= c("distribution_lock_up"), cover, c("distribution_lock_up"), True))
    out.append(Check("pf_covenant:cfae_positive", "cfae", c("cfae") >= zero, c("cfae"), zero))
    sources = c("equity_contribution") + c("total_debt")
    same("pf_check:sources_uses", "total_investment", c("total_investment"), sources, 0.03, show=(sources, c("total_investment")))
    loan = c("total_debt").cast("double") / F.nullif(c("total_investment"), zero).cast("double")
    out.append(Check("pf_check:loan_to_cost_plausibility", "loan_to_cost", loan <= 0.90, loan, number("0.90")))
    left = c("cfads") - size("debt_service")
    same("pf_check:cfae_consistency", "cfae", c("cfae"), left, 0.02, show=(c("cfae"), F.round(left.cast("double"), 0)))
    out.append(Check("pf_check:llcr_vs_dscr", "llcr", c("llcr") >= cover, c("llcr"), cover))
    out.append(Check("pf_check:plcr_vs_llcr", "plcr", c("plcr") >= c("llcr"), c("plcr"), c("llcr")))
    out.append(Check("pf_check:dsra_adequacy", "dsra_balance", c("dsra_balance") >= F.abs(service) * number("0.95"), c("dsra_balance"), F.abs(service)))
    rate = F.when(size("equity_irr") > 1, c("equity_irr").cast("double") / 100).otherwise(c("equity_irr").cast("double"))
    out.append(Check("pf_check:equity_irr_plausibility", "equity_irr", rate.between(0.03, 0.40), rate, number(None)))
    return out


def cross_statement(wide: DataFrame, key: str = "entity_id", period: str = "yr") -> DataFrame:
    """C: key, period, rule, item, passed, severity, actual and expected of each check whose operands are there.

    wide: a row for each key and period, decimal columns by name. One window for the values of the period before, no other shuffle.
    """
    have = set(wide.columns)
    w = Window.partitionBy(key).orderBy(period)
    rows = wide.withColumns({f"_before_{n}": F.lag(n).over(w) for n in BEFORE if n in have})
    made = [
        F.struct(
            F.lit(x.rule).alias("rule"), F.lit(x.item).alias("item"), x.passed.alias("passed"), F.when(x.passed, "warning").otherwise("error" if x.hard else "warning").alias("severity"),
            F.round(x.actual.cast("double"), 4).alias("actual"), F.round(x.expected.cast("double"), 4).alias("expected"),
        )
        for x in cross_checks(have)
    ]
    return rows.select(key, period, F.inline(F.array(*made))).where("passed is not null")
