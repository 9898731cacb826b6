"""Sections of a sheet written out by hand."""

import pytest

from tallyspark.operators import sections

KIND = "sheet string, r int, c int, value string, is_number boolean, bold boolean, fill string, merge_origin string, formula string, subtotal boolean"


def row(r, label, number="1", bold=(False, False), fill=(None, None), merge=(None, None), formula=None, subtotal=None, sheet="s"):
    return [(sheet, r, 1, label, False, bold[0], fill[0], merge[0], None, subtotal), (sheet, r, 2, number, number is not None and number.isdigit(), bold[1], fill[1], merge[1], formula, None)]


def starts(spark, rows, known=None):
    cells = spark.createDataFrame([c for r in rows for c in r], KIND)
    told = None if known is None else spark.createDataFrame([("s", r) for r in known], "sheet string, r int")
    found = sections.cut(sections.row_features(cells), told)
    return sections.sections(found).orderBy("sheet", "section").collect()


PLAIN = [row(r, f"Item {r}") for r in range(1, 7)]


@pytest.mark.parametrize(("rows", "want"), [
    (PLAIN, [1]),
    ([*PLAIN, row(9, None)], [1, 9]),
    ([*PLAIN, row(8, "Item 8")], [1]),
    ([*PLAIN, row(8, "Item 8", bold=(True, False))], [1, 8]),
    ([*PLAIN, row(8, None, bold=(True, False))], [1]),
    ([*PLAIN, row(7, "Head", bold=(True, True))], [1, 7]),
    ([*PLAIN, row(7, "Head", bold=(True, False))], [1]),
    ([*PLAIN, row(7, "Head", fill=("red", None)), row(8, "Next", fill=("red", "red")), row(9, "Last", fill=("red", "blue"))], [1, 7]),
    ([*PLAIN, row(7, "Head", merge=("A7", "A7")), row(8, "Next", merge=("A8", "B8"))], [1, 7]),
    ([*PLAIN, row(7, "CASH FLOWS", None), row(8, "Loan", "5"), row(9, "The facility", "text")], [1, 7, 9]),
    ([*PLAIN[:4]], [1]),
    ([*PLAIN[:3], row(9, "Balance sheet", None)], [1]),
])
def test_where_sections_begin(spark, rows, want):
    assert [s.start_row for s in starts(spark, rows)] == want


def test_known_boundaries_names_and_counts(spark):
    rows = [row(1, "Income statement", None, bold=(True, True)), row(2, "Revenue", "5", formula="=B9"), row(3, " ", "6"), row(4, "Cost", bold=(True, False), subtotal=True), row(5, None, "7"), row(6, "Loan", "8", formula="=B2"), row(7, "P/L", None)]
    got = [tuple(s)[1:] for s in starts(spark, rows, [5, 99])]
    assert got == [
        (1, "Income statement", 1, 4, 4, "income_statement", "Income statement|Revenue|Cost", "Income statement|Cost", True, 1),
        (2, "Section 2", 5, 6, 2, None, "Loan", "", False, 1),
        (3, "P/L", 7, 7, 1, "income_statement", "P/L", "", False, 0),
    ]


def test_sheets_apart_and_without_labels(spark):
    rows = [row(r, None, sheet="t") for r in (1, 2)] + PLAIN
    assert [(s.sheet, s.label) for s in starts(spark, rows)] == [("s", "Item 1"), ("t", "(single section)")]
    assert starts(spark, [row(1, "a")], [1])[0].row_count == 1
