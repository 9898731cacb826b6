"""Rule text to Columns: arithmetic from left to right without precedence, and comparisons with a tolerance."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/])")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r} in {text!r}")
        out.append(m[1])
        at = m.end()
    if len(out) % 2 == 0 or any((x in "+-*/") != (i % 2 == 1) for i, x in enumerate(out)):
        raise ValueError(f"operands and operators don't alternate in {text!r}")
    return out


def operand(x: str, of) -> Column:
    return F.lit(float(x)) if x[0].isdigit() else of(x)


def left_to_right(text: str, of) -> Column:
    """a + b * c is (a + b) * c; division by zero gives null. of maps a name to its Column."""
    first, *rest = tokens(text)
    out = operand(first, of)
    for op, x in zip(rest[::2], rest[1::2]):
        y = operand(x, of)
        out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}[op](out, y)
    return out


def sql(text: str, of) -> str:
    """left_to_right as SQL text: building a long plan from text is much faster than from Columns."""
    first, *rest = tokens(text)
    put = lambda x: f"{float(x)}D" if x[0].isdigit() else of(x)
    out = put(first)
    for op, x in zip(rest[::2], rest[1::2]):
        out = f"try_divide({out}, {put(x)})" if op == "/" else f"({out} {op} {put(x)})"
    return out


def names(text: str) -> list[str]:
    return list(dict.fromkeys(x for x in tokens(text) if x[0].isalpha() or x[0] == "_"))


def divergence(a: Column, b: Column, floor: float = 1.0) -> Column:
    """|a - b| relative to the larger of both and floor."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def check(text: str, of, tolerance: float = 0.0) -> Column:
    """a == b (within tolerance), a >= b, a <= b, a <= b <= c. What can't be evaluated passes."""
    if "==" in text:
        a, b = (left_to_right(x, of) for x in text.split("=="))
        held = divergence(a, b) <= tolerance
    elif ">=" in text:
        a, b = (left_to_right(x, of) for x in text.split(">="))
        held = a >= b
    else:
        parts = [left_to_right(x, of) for x in text.split("<=")]
        held = F.lit(True)
        for a, b in zip(parts, parts[1:]):
            held &= a <= b
    return F.coalesce(held, F.lit(True))


@dataclass(frozen=True)
class Rule:
    """A derivation: target = formula. Products lose 5 % of confidence; the tolerance is that of the consistency check."""

    id: str
    target: str
    formula: str
    product: bool
    priority: int
    tolerance: float


#: The derivation rules.
RULES = [
    Rule("DR-001", "gross_profit", "revenue - cogs", False, 1, 0.03),
    Rule("DR-010", "net_debt", "total_debt - cash", False, 1, 0.03),
    Rule("DR-011", "net_working_capital", "total_current_assets - total_current_liabilities", False, 1, 0.03),
    Rule("DR-020", "fcf", "cfo - capex", False, 1, 0.03),
    Rule("DR-002a", "ebitda", "ebit + depreciation + amortization", False, 2, 0.03),
    Rule("DR-003", "ebt", "ebit - interest_expense", False, 2, 0.03),
    Rule("DR-030", "debt_to_ebitda", "total_debt / ebitda", True, 2, 0.02),
    Rule("DR-031", "interest_coverage", "ebit / interest_expense", True, 2, 0.02),
    Rule("DR-033", "gross_margin", "gross_profit / revenue", True, 2, 0.02),
    Rule("DR-040", "dscr_project_finance", "cfads / debt_service", True, 2, 0.03),
    Rule("DR-041", "cfae", "cfads + debt_service", False, 2, 0.03),
    Rule("DR-042", "dscr_corporate", "cfo / debt_service", True, 2, 0.03),
    Rule("DR-043", "loan_to_cost", "total_debt / total_investment", True, 2, 0.03),
    Rule("DR-050", "current_ratio", "total_current_assets / total_current_liabilities", True, 2, 0.02),
    Rule("DR-060", "days_sales_outstanding", "accounts_receivable / revenue * 365", True, 2, 0.03),
    Rule("DR-061", "days_payable_outstanding", "accounts_payable / cogs * 365", True, 2, 0.03),
    Rule("DR-002b", "ebitda", "ebit + depreciation_and_amortization", False, 3, 0.03),
    Rule("DR-004", "net_income", "ebt - tax_expense", False, 3, 0.03),
    Rule("DR-005", "ebitda_addbacks", "adjusted_ebitda - ebitda", False, 3, 0.03),
    Rule("DR-032", "net_debt_to_ebitda", "net_debt / ebitda", True, 3, 0.02),
    Rule("DR-034", "ebitda_margin", "ebitda / revenue", True, 3, 0.02),
    Rule("DR-044", "covenant_headroom", "dscr_project_finance - distribution_lock_up", False, 3, 0.03),
    Rule("DR-035", "net_margin_pct", "net_income / revenue", True, 4, 0.02),
]
