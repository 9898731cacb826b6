"""Sections of customers' orders as sheets, with names of statements, styles, blank rows and formulas here and there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sections as op
from ..sources import roles
from .base import query

#: Labels by o_orderkey % 16; all others are items.
NAMES = {0: "Balance Sheet", 3: "Cash Flows (USD)", 6: "Loan facility A", 9: " P&L ", 12: "", 13: None}
LABEL = "CASE k % 16 " + " ".join(f"WHEN {i} THEN {'NULL' if n is None else repr(n)}" for i, n in NAMES.items()) + " ELSE 'Item ' || k END"
#: Cells of a row by the order's key k and the customer s: label, number, note; the same texts for both engines.
STYLE = [
    (LABEL, "FALSE", "k % 5 = 0 OR k % 23 = 1", "CASE WHEN k % 13 < 2 THEN 'blue' WHEN k % 13 = 2 THEN 'grey' END", "CASE WHEN k % 19 < 2 THEN 'A' || r END", "CAST(NULL AS VARCHAR)", "k % 17 = 0"),
    ("CASE WHEN k % 4 = 0 THEN 'note' ELSE CAST(k AS VARCHAR) END", "k % 4 <> 0", "k % 23 = 1", "CASE WHEN k % 13 = 1 THEN 'grey' END", "CASE WHEN k % 19 = 0 THEN 'A' || r WHEN k % 19 = 1 THEN 'B' || r END", "CASE WHEN k % 3 = 0 THEN '=A1' END", "FALSE"),
    ("CASE WHEN k % 6 = 0 THEN 'more' END", "FALSE", "k % 23 = 1", "CASE WHEN k % 13 = 1 THEN 'blue' END", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "k % 29 = 0"),
]
COLUMNS = ("value", "is_number", "bold", "fill", "merge_origin", "formula", "subtotal")
STEP = "CASE WHEN k % 7 = 0 THEN 3 WHEN k % 5 = 0 THEN 2 ELSE 1 END"
HINT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in op.KEYWORDS.items()) + " END"
SECTIONS = f"""WITH steps AS (SELECT o_custkey AS sheet, o_orderkey AS k FROM orders), numbered AS (SELECT sheet, k, CAST(SUM({STEP}) OVER (PARTITION BY sheet ORDER BY k) AS INT) AS r FROM steps),
cells AS ({" UNION ALL ".join(f"SELECT sheet, k, r, {c} AS c, " + ", ".join(f"{e} AS {n}" for e, n in zip(style, COLUMNS)) + " FROM numbered" for c, style in enumerate(STYLE, 1))}),
fills AS (SELECT sheet, r, arg_max(fill, (n, -first)) AS fill, MAX(n) AS n FROM (SELECT sheet, r, fill, COUNT(*) AS n, MIN(c) AS first FROM cells WHERE fill IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
rows AS (SELECT sheet, r, MAX(CASE WHEN c = 1 AND trim(value) <> '' THEN trim(value) END) AS label, bool_or(c = 1 AND bold) AS bold_label, bool_and(bold) AS full_bold, MAX(f.fill) AS fill, COUNT(DISTINCT merge_origin) = 1 AS merged, COUNT(*) FILTER (is_number AND value IS NOT NULL) AS numbers, COUNT(formula) AS formulas, bool_or(subtotal) AS subtotal
 FROM cells LEFT JOIN (SELECT sheet, r, fill FROM fills WHERE n >= 1) f USING (sheet, r) GROUP BY 1, 2),
lagged AS (SELECT *, r - LAG(r) OVER w AS gap, LAG(fill) OVER w AS fill_before, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY sheet) AS n FROM rows WINDOW w AS (PARTITION BY sheet ORDER BY r)),
marked AS (SELECT *, CASE WHEN i = 1 OR n >= 5 AND (gap >= 3 OR label IS NOT NULL AND (bold_label AND gap >= 2 OR full_bold OR fill IS NOT NULL AND fill IS DISTINCT FROM fill_before OR merged) OR (({HINT.format('label')}) IS NOT NULL AND numbers = 0) OR r % 41 = 0) THEN 1 ELSE 0 END AS begins FROM lagged),
parts AS (SELECT *, CAST(SUM(begins) OVER (PARTITION BY sheet ORDER BY r) AS INT) AS section FROM marked),
grouped AS (SELECT sheet, section, MAX(label) FILTER (begins = 1) AS head, MIN(r) AS start_row, MAX(r) AS end_row, COUNT(*) AS row_count, array_to_string((list(label ORDER BY r) FILTER (label IS NOT NULL))[:5], '|') AS sample_labels, string_agg(label, '|' ORDER BY r) FILTER (bold_label) AS bold_labels, bool_or(subtotal) AS has_subtotals, CAST(SUM(formulas) AS BIGINT) AS formula_count FROM parts GROUP BY 1, 2),
named AS (SELECT *, COALESCE(head, CASE WHEN COUNT(*) OVER (PARTITION BY sheet) = 1 THEN '(single section)' ELSE 'Section ' || section END) AS label FROM grouped)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("sheet").orderBy("k")
    rows = roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("k")).withColumn("r", F.sum(F.expr(STEP)).over(by).cast("int"))
    spark_text = lambda e: e.replace("VARCHAR", "STRING")
    made = [F.struct(F.lit(c).alias("c"), *[F.expr(spark_text(e)).alias(n) for e, n in zip(style, COLUMNS)]) for c, style in enumerate(STYLE, 1)]
    return rows.select("sheet", "r", F.inline(F.array(*made)))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.row_features(_cells(spark, sf_dir))
    return op.cut(rows, rows.where("r % 41 = 0").select("sheet", "r"))


@query(SECTIONS + f" SELECT sheet, section, label, start_row, end_row, row_count, {HINT.format('label')} AS category_hint, COALESCE(sample_labels, '') AS sample_labels, COALESCE(bold_labels, '') AS bold_labels, has_subtotals, formula_count FROM named")
def sheet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each sheet."""
    return op.sections(_cut(spark, sf_dir))


@query(SECTIONS + f" SELECT p.sheet, p.r, p.label, p.section, {HINT.format('n.label')} AS category_hint FROM parts p JOIN named n ON n.sheet = p.sheet AND n.section = p.section WHERE p.label IS NOT NULL")
def section_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled row with the statement of its section."""
    rows = _cut(spark, sf_dir)
    return op.categories(rows, op.sections(rows))
