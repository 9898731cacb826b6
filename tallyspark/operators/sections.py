"""Sections of sheets: rows described by their cells' text and style, cut where a new statement begins, named and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a section's label holds, by statement; the first statement that fits counts.
KEYWORDS = {
    "income_statement": ["income statement", "profit & loss", "profit and loss", "p&l", "p/l", "pl statement", "i/s"],
    "balance_sheet": ["balance sheet", "statement of financial position", "financial position", "b/s"],
    "cash_flow": ["cash flow", "cash flows", "statement of cash", "c/f"],
    "debt_schedule": ["debt schedule", "debt service", "loan", "facility", "borrowing"],
}
#: Blank rows that cut by themselves and before a bold label, as steps of the row's number; rows of a sheet that is cut at all; labels shown.
GAP, BOLD_GAP, LEAST_ROWS, SAMPLES = 3, 2, 5, 5


def hint(label: Column) -> Column:
    """The statement whose keyword stands in the label, else null."""
    low, out = F.lower(label), F
    for kind, words in KEYWORDS.items():
        found = F.lit(False)
        for w in words:
            found |= low.contains(w)
        out = out.when(found, kind)
    return out


def row_features(cells: DataFrame, label_column: int = 1) -> DataFrame:
    """Of each row its label, whether that is bold, whether all cells are, the fill of at least half of them, whether they are one merged cell, and counts of numbers and formulas.

    cells: sheet, r, c, value (text), is_number, bold, fill, merge_origin (null if not merged), formula, subtotal; null flags are
    false. A label is a text that isn't blank in the label column. Of fills as frequent as each other the first counts. A row
    of a single cell is neither all bold nor merged.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    at_label = F.col("c") == label_column
    text = F.when(at_label & ~flag("is_number") & (F.trim("value") != ""), F.trim("value"))
    fills = cells.where("fill is not null").groupBy("sheet", "r", "fill").agg(F.count("*").alias("n"), F.min("c").alias("first"))
    fills = fills.groupBy("sheet", "r").agg(F.max_by("fill", F.struct("n", -F.col("first"))).alias("fill"), F.max("n").alias("fill_n"))
    rows = cells.groupBy("sheet", "r").agg(
        F.count("*").alias("n"), F.max(text).alias("label"), F.coalesce(F.bool_or(F.when(at_label, flag("bold"))), F.lit(False)).alias("bold_label"), F.bool_and(flag("bold")).alias("all_bold"), F.count_distinct("merge_origin").alias("origins"),
        F.count_if(flag("is_number") & F.col("value").isNotNull()).alias("numbers"), F.count("formula").alias("formulas"), F.bool_or(flag("subtotal")).alias("subtotal"),
    )
    rows = rows.join(fills, ["sheet", "r"], "left").withColumn("fill", F.when(F.col("fill_n") >= F.floor(F.col("n") / 2), F.col("fill")))
    several = F.col("n") >= 2
    return rows.select("sheet", "r", "label", "bold_label", (several & F.col("all_bold")).alias("full_bold"), "fill", (several & (F.col("origins") == 1)).alias("merged"), "numbers", "formulas", "subtotal")


def cut(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (row_features) with section, from 1 in each sheet. known: sheet, r of boundaries told by the parser.

    A section begins after two blank rows, at a bold label after one, at a labelled row that is all bold, filled unlike the row
    before or one merged cell, and at a statement's name without numbers. Sheets of fewer than LEAST_ROWS rows are one section.
    """
    w = Window.partitionBy("sheet").orderBy("r")
    gap, named = F.col("r") - F.lag("r").over(w), F.col("label").isNotNull()
    filled = F.col("fill").isNotNull() & ~F.col("fill").eqNullSafe(F.lag("fill").over(w))
    begins = (gap >= GAP) | (named & ((F.col("bold_label") & (gap >= BOLD_GAP)) | F.col("full_bold") | filled | F.col("merged"))) | (hint(F.col("label")).isNotNull() & (F.col("numbers") == 0))
    if known is not None:
        rows = rows.join(known.select("sheet", "r").distinct().withColumn("_known", F.lit(True)), ["sheet", "r"], "left")
        begins |= F.coalesce("_known", F.lit(False))
    first = F.row_number().over(w) == 1
    big = F.count("*").over(Window.partitionBy("sheet")) >= LEAST_ROWS
    marked = rows.withColumn("_begins", (first | (big & F.coalesce(begins, F.lit(False)))).cast("int"))
    return marked.withColumn("section", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_begins", *(["_known"] if known is not None else []))


def sections(rows: DataFrame) -> DataFrame:
    """Sheet, section, label, start_row, end_row, row_count, category_hint, sample_labels, bold_labels, has_subtotals, formula_count; rows: from cut. A section whose first row has no label gets a number for one."""
    labels = lambda if_: F.transform(F.array_sort(F.collect_list(F.when(if_, F.struct("r", "label")))), lambda x: x["label"])
    named = F.col("label").isNotNull()
    found = rows.groupBy("sheet", "section").agg(
        F.min_by(F.struct("label"), "r").alias("head"), F.min("r").alias("start_row"), F.max("r").alias("end_row"), F.count("*").alias("row_count"), F.array_join(F.slice(labels(named), 1, SAMPLES), "|").alias("sample_labels"),
        F.array_join(labels(named & F.col("bold_label")), "|").alias("bold_labels"), F.bool_or("subtotal").alias("has_subtotals"), F.sum("formulas").alias("formula_count"),
    )
    only = F.count("*").over(Window.partitionBy("sheet")) == 1
    label = F.coalesce("head.label", F.when(only, "(single section)").otherwise(F.concat(F.lit("Section "), F.col("section").cast("string"))))
    return found.select("sheet", "section", label.alias("label"), "start_row", "end_row", "row_count", hint(label).alias("category_hint"), "sample_labels", "bold_labels", "has_subtotals", "formula_count")


def categories(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Label and category_hint of the section of each labelled row."""
    return rows.where("label is not null").join(found.select("sheet", "section", "category_hint"), ["sheet", "section"]).select("sheet", "r", "label", "section", "category_hint")
