"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import accuracy, aggregates, cascade, checks, corrections, facts, formulas, gaps, governance, labels, layouts, lifecycle, lint, periods, records, results, rulebook, rules, sections, series, sheets, staged, texts, windows  # noqa: F401
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
