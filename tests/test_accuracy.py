"""Outcomes, causes and comparisons of mapped labels on small files."""

import pytest

from tallyspark.operators import accuracy as op

EXPECTED = [
    ("f", 0, "Income Statement", "Sales", "revenue"), ("f", 1, "Income Statement", "Costs", "cogs"), ("f", 2, "Balance", "Cash", "cash"),
    ("f", 3, "Notes", "Lost", "other"), ("f", 4, "Skipped", "Gone", "capex"), ("f", 5, None, "Twice", "debt"), ("f", 6, "Balance", "Wrong", "tax"),
    ("f", 7, "Balance", None, "tax"), ("f", 8, "Balance", "Sales", None),
]
ITEMS = [
    ("f", 0, "Sales", "net_revenue", "mapping"), ("f", 1, "Costs", "unmapped", None), ("f", 2, " Cash", "cash", "mapping"), ("f", 3, "Twice", "debt", "mapping"),
    ("f", 4, "Twice", "tax", "enhanced_mapping"), ("f", 5, "Wrong", "debt", "stage_4"), ("f", 6, "", "cash", "x"), ("f", 7, None, "cash", "x"), ("g", 8, "Lost", "other", "x"),
]
ALTERNATIVES = [("revenue", "net_revenue"), ("revenue", "revenue"), ("tax", "income_tax"), ("tax", "income_tax")]


@pytest.fixture(scope="module")
def given(spark):
    expected = spark.createDataFrame(EXPECTED, "file string, n long, sheet string, label string, canonical_name string")
    items = spark.createDataFrame(ITEMS, "file string, n long, label string, canonical_name string, stage string")
    return expected, items, spark.createDataFrame(ALTERNATIVES, "canonical_name string, acceptable string")


@pytest.fixture(scope="module")
def tiers(spark):
    of = "file string, n long, sheet string, tier int"
    return spark.createDataFrame([("f", 0, "Skipped", 1), ("f", 0, "Notes", 4), ("f", 0, "Balance", None)], of), spark.createDataFrame([("f", 0, "Skipped", 2), ("f", 1, "Skipped", 4), ("f", 0, "Notes", 4)], of)


def test_first_item_counts_and_blanks_only_count_untrimmed(given):
    found = lambda **how: {r.n: r.outcome for r in op.judged(*given, **how).collect()}
    assert found() == {0: "correct", 1: "unmapped", 2: "missing", 3: "missing", 4: "missing", 5: "correct", 6: "mismatch", 7: "missing", 8: "mismatch"}
    assert found(trim=True)[2] == "correct"
    assert found(keep="last")[5] == "mismatch"


def test_a_name_with_alternatives_accepts_only_these(spark, given):
    items = spark.createDataFrame([("f", 0, "Wrong", "tax", None), ("f", 0, "Sales", "revenue", None)], given[1].schema)
    got = {r.n: r.outcome for r in op.judged(given[0], items, given[2]).collect()}
    assert (got[0], got[6]) == ("correct", "mismatch")


def test_levels(given):
    got = {(r.level, r.name): (r.total, r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in op.by_level(op.judged(*given)).collect()}
    assert got["file", None] == (9, 2, 2, 7, 0.5, 0.2222, 0.3077)
    assert got["sheet", "Income Statement"] == got["category", "income_statement"] == (2, 1, 0, 1, 1.0, 0.5, 0.6667)
    assert got["sheet", "Unknown"] == (1, 1, 0, 0, 1.0, 1.0, 1.0)
    assert got["category", "balance_sheet"] == (4, 0, 2, 4, 0.0, 0.0, 0.0)
    assert sum(v[0] for (level, _), v in got.items() if level == "category") == 9


def test_causes_follow_the_ladder_and_the_last_item(given, tiers):
    rows = op.attributed(*given, *tiers)
    got = {r.n: r.cause for r in rows.collect()}
    assert got == {0: None, 1: "mapping", 2: "parsing", 3: "parsing", 4: "triage", 5: "enhanced_mapping", 6: "enhanced_mapping", 7: "parsing", 8: "mapping"}
    whole = [r for r in op.causes(rows).collect() if r.sheet is None]
    assert [(r.errors, r.parsing, r.triage, r.mapping, r.enhanced_mapping, r.validation, r.parsing_pct) for r in whole] == [(8, 3, 1, 2, 2, 0, 37.5)]


def test_tiers_of_sheets(tiers):
    assert [tuple(r) for r in op.triage_accuracy(*tiers).collect()] == [("f", 3, 1, 0.3333)]


def test_statements_and_changes(spark, given):
    now = op.judged(*given, trim=True)
    whole = [r for r in op.by_statement(now).collect() if r.sheet is None][0]
    assert (whole.total, whole.correct, whole.unmapped, whole.accuracy, whole.accuracy_of_matched) == (9, 3, 4, 0.3333, 0.6)
    items = spark.createDataFrame([("f", 0, "Wrong", "income_tax", None), ("f", 0, "Cash", "debt", None)], given[1].schema)
    before = op.judged(given[0], items, given[2], trim=True)
    # Sales is expected twice, once without a name
    assert {tuple(r) for r in op.mismatch_changes(now, before).collect()} == {("f", "Wrong", "new"), ("f", "Sales", "new"), ("f", "Cash", "resolved")}
    assert op.mismatch_changes(now, before.where("file = 'none'")).count() == 0


def test_differences_of_runs(spark):
    of = "file string, mapping_accuracy double, triage_accuracy double, quality_score double, completeness_score double, duration double, tokens long"
    now = spark.createDataFrame([("a", 0.5, None, 0.7, 0.25, 3.0, 10), ("b", 1.0, 1.0, 1.0, 1.0, 1.0, 7)], of)
    before = spark.createDataFrame([("a", 0.25, 1.0, 0.75, 0.25, 0.0, 4), ("c", 1.0, 1.0, 1.0, 1.0, 1.0, 5)], of)
    got = {r.file: tuple(r)[1:] for r in op.run_deltas(now, before).collect()}
    assert got == {"a": (0.25, None, -0.05, 0.0, None, 6), "b": (None,) * 5 + (7,), "c": (None,) * 5 + (-5,)}


def test_empty_tables(given, tiers):
    none = [x.where("false") for x in (*given, *tiers)]
    assert op.by_level(op.judged(*none[:3])).count() == op.causes(op.attributed(*none)).count() == op.triage_accuracy(*none[3:]).count() == 0
    assert {r.outcome for r in op.judged(given[0], *none[1:3]).collect()} == {"missing"}
