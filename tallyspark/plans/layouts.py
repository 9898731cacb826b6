"""Periods of sheets: each customer's orders as a sheet of one of five shapes, seven customers a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layouts as op
from ..sources import roles
from .base import query
from .periods import FORMS, _raw

#: Shapes by o_custkey % 5: periods in rows, a row of keywords above years or numbers, periods down, numbers, nothing.
WORDS = ["FY", "Calendar Year", "Operations", "Period"]
CELLS = FORMS + """, placed AS (SELECT f.*, o_custkey AS sheet, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS j, o_custkey % 5 AS shape, o_custkey // 5 % 4 AS word, o_custkey // 20 % 2 = 1 OR o_orderkey % 2 = 0 AS is_text,
 CAST(year(o_orderdate) AS INT) AS y, CAST(o_custkey % 40 + 1 AS INT) + o_orderkey % 3 AS n FROM forms f JOIN (SELECT o_orderkey, o_orderdate FROM orders) o USING (o_orderkey)),
cells AS (SELECT sheet, 2 + j % 3 AS r, j // 3 + 1 AS c, trim(raw) AS raw, normalized, kind, year, sub, confidence, CAST(NULL AS INT) AS num FROM placed WHERE shape = 0
 UNION ALL SELECT sheet, 4, j + 1, CASE word WHEN 2 THEN CAST(n AS VARCHAR) ELSE CAST(y AS VARCHAR) END, CASE WHEN word <> 2 THEN CAST(y AS VARCHAR) END, CASE WHEN word <> 2 THEN 'year' END, CASE WHEN word <> 2 THEN y END, NULL, CASE WHEN word <> 2 THEN 1.0 END, CASE WHEN word = 2 THEN n END FROM placed WHERE shape = 1
 UNION ALL SELECT sheet, 2, j + 1, ['FY', 'Calendar Year', 'Operations', 'Period'][word + 1], NULL, NULL, NULL, NULL, NULL, NULL FROM placed WHERE shape = 1
 UNION ALL SELECT sheet, j + 1, 1, CASE WHEN o_orderkey % 3 = 0 THEN 'item' ELSE trim(raw) END, CASE WHEN o_orderkey % 3 <> 0 THEN normalized END, CASE WHEN o_orderkey % 3 <> 0 THEN kind END, CASE WHEN o_orderkey % 3 <> 0 THEN year END, CASE WHEN o_orderkey % 3 <> 0 THEN sub END, CASE WHEN o_orderkey % 3 <> 0 THEN confidence END, NULL FROM placed WHERE shape = 2
 UNION ALL SELECT sheet, j + 1, 2, 'x', NULL, NULL, NULL, NULL, NULL, NULL FROM placed WHERE shape = 2
 UNION ALL SELECT sheet, 1, j + 1, CASE WHEN o_orderkey % 4 = 0 AND sheet % 3 = 0 THEN 'x' ELSE CAST(j + 1 + sheet % 9 AS VARCHAR) END, NULL, NULL, NULL, NULL, NULL, CASE WHEN o_orderkey % 4 = 0 AND sheet % 3 = 0 THEN NULL ELSE j + 1 + sheet % 9 END FROM placed WHERE shape = 3
 UNION ALL SELECT sheet, j + 1, 1, 'item ' || j, NULL, NULL, NULL, NULL, NULL, NULL FROM placed WHERE shape = 4),
under AS (SELECT sheet, 4 AS r, j + 1 AS c, CASE WHEN NOT is_text OR word = 3 THEN CASE word WHEN 2 THEN CAST(n AS VARCHAR) ELSE CAST(y AS VARCHAR) END ELSE ['FY', 'CY', 'Operations Year '][word + 1] || ' ' || CASE word WHEN 2 THEN CAST(n AS VARCHAR) ELSE CAST(y AS VARCHAR) END END AS raw,
 CASE WHEN word = 2 THEN CASE WHEN is_text THEN 'Ops-Year' || n END WHEN word = 3 OR NOT is_text THEN CAST(y AS VARCHAR) ELSE ['FY', 'CY'][word + 1] || y END AS normalized,
 CASE WHEN word = 2 THEN CASE WHEN is_text THEN 'phase' END WHEN word = 3 OR NOT is_text THEN 'year' ELSE ['fiscal_year', 'calendar_year'][word + 1] END AS kind, CASE WHEN word <> 2 THEN y WHEN is_text THEN 1 END AS year, CASE WHEN word = 2 AND is_text THEN n END AS sub, 0.8 AS confidence FROM placed WHERE shape = 1),
sizes AS (SELECT sheet, MIN(r) AS first, COUNT(DISTINCT r) AS n_rows FROM cells GROUP BY 1),
found AS (SELECT sheet, 'under' AS way, r AS spot, 2 AS top, c AS place, r, c, raw, normalized, kind, year, sub, confidence FROM under
 UNION ALL SELECT sheet, 'across', r, NULL, c, r, c, raw, normalized, kind, year, sub, confidence FROM cells JOIN sizes USING (sheet) WHERE r <= first + 8
 UNION ALL SELECT sheet, 'numbers', r, NULL, c, r, c, raw, 'P' || num, CASE WHEN num <= 100 THEN 'numeric' END, NULL, num, 0.7 FROM cells JOIN sizes USING (sheet) WHERE r <= first + 8
 UNION ALL SELECT sheet, 'down', 0, NULL, r, r, c, raw, normalized, kind, year, sub, confidence FROM cells WHERE c = 1),
grouped AS (SELECT sheet, way, spot, MAX(top) AS top, COUNT(*) AS filled, COUNT(kind) AS n, COUNT(DISTINCT kind) AS kinds, MAX(n_rows) AS n_rows, MAX(sub) - MIN(sub) + 1 AS span, COUNT(DISTINCT sub) AS different FROM found JOIN sizes USING (sheet) GROUP BY 1, 2, 3),
most AS (SELECT sheet, way, spot, arg_min(kind, (-c, first)) AS dominant FROM (SELECT sheet, way, spot, kind, COUNT(*) AS c, MIN(place) AS first FROM found WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3),
rated AS (SELECT *, CASE kinds WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS bonus, CAST(n AS DOUBLE) / CASE way WHEN 'down' THEN n_rows ELSE filled END AS ratio FROM grouped JOIN most USING (sheet, way, spot)),
fitting AS (SELECT *, ROUND(CASE way WHEN 'down' THEN LEAST(ratio, 1.0) * bonus * 0.8 WHEN 'numbers' THEN 0.7 * ratio ELSE ratio * bonus END, 4) AS trust, CASE way WHEN 'under' THEN 0 WHEN 'across' THEN 1 WHEN 'numbers' THEN 2 ELSE 3 END AS kind_of FROM rated
 WHERE CASE way WHEN 'down' THEN n >= 3 WHEN 'numbers' THEN n >= 3 AND span = n AND different = n AND ratio >= 0.4 ELSE n >= 2 AND ratio >= 0.4 END),
best AS (SELECT * FROM fitting QUALIFY ROW_NUMBER() OVER (PARTITION BY sheet ORDER BY CASE WHEN kind_of < 2 THEN 0 WHEN kind_of = 2 AND trust >= 0.3 THEN 1 ELSE 2 END, trust DESC, kind_of, spot) = 1),
listed AS (SELECT f.* FROM found f JOIN best b ON f.sheet = b.sheet AND f.way = b.way AND f.spot = b.spot WHERE f.kind IS NOT NULL),
layouts AS (SELECT b.sheet, CASE way WHEN 'down' THEN 'time_down_rows' ELSE 'time_across_columns' END AS layout, CASE way WHEN 'down' THEN (SELECT string_agg(DISTINCT l.r, '|' ORDER BY l.r) FROM listed l WHERE l.sheet = b.sheet) WHEN 'under' THEN top || '|' || spot ELSE CAST(spot AS VARCHAR) END AS header_rows, n AS periods, dominant, trust AS confidence FROM best b)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    s, k = F.col("sheet"), F.col("o_orderkey")
    p = _raw(spark, sf_dir).join(o, "o_orderkey").withColumnsRenamed({"o_custkey": "sheet"}).withColumn("j", F.row_number().over(Window.partitionBy("sheet").orderBy("o_orderkey")).cast("int") - 1)
    word, y, n = F.floor(s / 5) % 4, F.year("o_orderdate").cast("string"), ((s % 40 + 1) + k % 3).cast("string")
    is_text, jj = (F.floor(s / 20) % 2 == 1) | (k % 2 == 0), F.col("j")
    cell = lambda r, c, value, number=None: F.struct(r.cast("int").alias("row_index"), c.cast("int").alias("c"), value.alias("value"), (F.lit(False) if number is None else number).alias("is_number"))
    hole = (k % 4 == 0) & (s % 3 == 0)
    shapes = [
        F.array(cell(2 + jj % 3, F.floor(jj / 3) + 1, F.col("raw"))),
        F.array(cell(F.lit(2), jj + 1, F.element_at(F.array(*[F.lit(w) for w in WORDS]), (word + 1).cast("int"))), cell(F.lit(4), jj + 1, F.when(word == 2, n).otherwise(y), ~is_text)),
        F.array(cell(jj + 1, F.lit(1), F.when(k % 3 == 0, "item").otherwise(F.col("raw"))), cell(jj + 1, F.lit(2), F.lit("x"))),
        F.array(cell(F.lit(1), jj + 1, F.when(hole, "x").otherwise((jj + 1 + s % 9).cast("string")), ~hole)),
        F.array(cell(jj + 1, F.lit(1), F.concat(F.lit("item "), jj.cast("string")))),
    ]
    made = F.when(s % 5 == 0, shapes[0]).when(s % 5 == 1, shapes[1]).when(s % 5 == 2, shapes[2]).when(s % 5 == 3, shapes[3]).otherwise(shapes[4])
    return p.select("sheet", F.inline(made))


@query("WITH " + CELLS + " SELECT * FROM layouts")
def period_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: how each sheet lays its periods out."""
    return op.period_layouts(_cells(spark, sf_dir))[0]


@query("WITH " + CELLS + " SELECT sheet, CAST(r AS INT) AS row_index, CAST(c AS INT) AS c, raw, normalized, kind, year, CAST(sub AS INT) AS sub, confidence FROM listed")
def sheet_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: the periods of each sheet in its layout."""
    return op.period_layouts(_cells(spark, sf_dir))[1].drop("place")


@query("WITH " + CELLS + """, booked AS (SELECT *, sheet // 7 AS book FROM layouts), books AS (SELECT book, COUNT(*) AS sheets, COUNT(DISTINCT CASE WHEN dominant IN ('relative', 'phase', 'cod', 'stub') THEN 'project' ELSE dominant END) AS families, COUNT(DISTINCT layout) AS ways,
 string_agg(sheet || '=' || dominant, ', ' ORDER BY sheet) AS kinds, string_agg(sheet || '=' || layout, ', ' ORDER BY sheet) AS layouts FROM booked GROUP BY 1 HAVING COUNT(*) >= 2),
years AS (SELECT DISTINCT sheet // 7 AS book, sheet, year FROM listed WHERE year IS NOT NULL), missing AS (SELECT s.book, s.sheet, string_agg(e.year, ', ' ORDER BY e.year) AS details FROM (SELECT DISTINCT book, sheet FROM years) s JOIN (SELECT DISTINCT book, year FROM years) e ON s.book = e.book LEFT JOIN years y ON y.sheet = s.sheet AND y.year = e.year WHERE y.year IS NULL GROUP BY 1, 2)
SELECT book, 'mismatched_period_type' AS type, 'warning' AS severity, CAST(NULL AS BIGINT) AS sheet, kinds AS details FROM books WHERE families > 1
UNION ALL SELECT book, 'layout_inconsistency', 'info', NULL, layouts FROM books WHERE ways > 1 UNION ALL SELECT book, 'period_coverage_gap', 'info', sheet, details FROM missing WHERE book IN (SELECT book FROM books)""")
def period_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: where the sheets of a book don't agree."""
    book = F.floor(F.col("sheet") / 7).cast("long")
    layouts, listed = op.period_layouts(_cells(spark, sf_dir))
    return op.consistency(layouts.withColumn("book", book), listed.withColumn("book", book))
