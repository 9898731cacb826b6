"""Layouts of small sheets written out by hand."""

import pytest

from tallyspark.operators import layouts

KIND = "sheet string, row_index int, c int, value string, is_number boolean"


def sheet(name, rows, first=1):
    return [(name, r, c, None if v is None else str(v), isinstance(v, (int, float))) for r, row in enumerate(rows, first) for c, v in enumerate(row, 1)]


SHEETS = {
    # rows, then layout, header rows, periods in order, dominant, confidence
    "plain": ([["Model", None, " "], ["", "FY2024E", "FY2022", "FY2023A"], ["Revenue", 1, 2, 3]], ("time_across_columns", "2", ["FY2022", "FY2023A", "FY2024E"], "fiscal_year", 1.0)),
    "mixed": ([["x", "y", "2021", "Q1 2022"], ["a", "b", "c"]], ("time_across_columns", "1", ["2021", "2022-Q1"], "year", 0.45)),
    # the text below a keyword and the number beside it are of two kinds, so the row by itself is better
    "under": ([["Fiscal Year", None, "Fiscal Year"], ["2022", 2023, "2024E"]], ("time_across_columns", "2", ["2022", "2023", "2024E"], "year", 1.0)),
    "under_only": ([["Item", "Ops"], ["3", "1", "2"]], ("time_across_columns", "1|2", ["Ops-Year1", "Ops-Year2", "Ops-Year3"], "phase", 1.0)),
    "under_tie": ([["FY"], ["2023", "2022"]], ("time_across_columns", "1|2", ["FY2022", "FY2023"], "fiscal_year", 1.0)),
    "numbers": ([["Item", 3, 1, 2], ["Cash", 500, 600, 700]], ("time_across_columns", "1", ["P1", "P2", "P3"], "numeric", 0.525)),
    "down": ([["Year", "Cash"], ["2021", 900], ["2022", 950], ["Q1 2022", 970]], ("time_down_rows", "2|3|4", ["2021", "2022", "2022-Q1"], "year", 0.54)),
    "late": ([["x"]] * 9 + [["2021", "2022"]], None),
    "scanned": ([["x"]] * 8 + [["2021", "2022"]], ("time_across_columns", "9", ["2021", "2022"], "year", 1.0)),
    "no periods": ([["a", None], ["b", 7]], None),
}


@pytest.mark.parametrize("name", list(SHEETS))
def test_layout_of_a_sheet(spark, name):
    rows, want = SHEETS[name]
    found, listed = layouts.period_layouts(spark.createDataFrame(sheet(name, rows), KIND))
    if want is None:
        assert found.count() == listed.count() == 0
        return
    (r,) = found.collect()
    assert (r.layout, r.header_rows, [x.normalized for x in listed.orderBy("place").collect()], r.dominant, r.confidence) == want


def test_warnings_need_two_sheets_with_periods(spark):
    layout = "book long, sheet string, layout string, dominant string"
    rows = [(1, "a", "time_across_columns", "year"), (1, "b", "time_down_rows", "fiscal_year"), (2, "c", "time_across_columns", "phase"), (2, "d", "time_across_columns", "stub"), (3, "e", "time_down_rows", "year")]
    years = [(1, "a", 2020), (1, "a", 2021), (1, "b", 2021), (2, "c", 1), (2, "d", None), (3, "e", 2020)]
    got = layouts.consistency(spark.createDataFrame(rows, layout), spark.createDataFrame(years, "book long, sheet string, year int"))
    assert sorted(map(tuple, got.fillna("").collect())) == [
        (1, "layout_inconsistency", "info", "", "a=time_across_columns, b=time_down_rows"),
        (1, "mismatched_period_type", "warning", "", "a=year, b=fiscal_year"),
        (1, "period_coverage_gap", "info", "b", "2020"),
    ]
