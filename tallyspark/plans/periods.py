"""The whole period grammar over all orders, its order within each customer, and header rows found by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import sheets
from ..sources import roles
from .base import query

#: Raw form, normal form, kind, year, part, flags, confidence of each case, over yyyy, yy, q (quarter), h (half), mon, month, mm and n; k is its number.
CASES = [
    ("'FY ' || yyyy || 'E'", "'FY' || yyyy || 'E'", "fiscal_year", "yyyy", "NULL", "F", 1.0),
    ("'fy' || yy || '/' || right(CAST(y + 1 AS VARCHAR), 2)", "'FY' || yyyy || '/' || right(CAST(y + 1 AS VARCHAR), 2)", "fiscal_year", "yyyy", "NULL", "", 0.9),
    ("'FYE ' || mon || ' ''' || yy || 'a'", "'FYE-' || yyyy || '-' || mm || 'A'", "fiscal_year_end", "yyyy", "m", "A", 0.9),
    ("'FYE ' || month || '/' || yyyy", "'FYE-' || yyyy || '-' || mm", "fiscal_year_end", "yyyy", "m", "", 1.0),
    ("'CY''' || yy || ' P'", "'CY' || yyyy || 'P'", "calendar_year", "yyyy", "NULL", "F", 0.9),
    ("'TTM to ' || mon", "'TTM'", "trailing", "NULL", "NULL", "", 1.0),
    ("yyyy || ' F'", "yyyy || 'F'", "year", "yyyy", "NULL", "F", 1.0),
    ("'Q' || q || ' ''' || yy || 'E'", "yyyy || '-Q' || q", "quarter", "yyyy", "q", "F", 0.9),
    ("yyyy || 'q' || q || 'A'", "yyyy || '-Q' || q", "quarter", "yyyy", "q", "A", 1.0),
    ("'H' || h || ' ' || yyyy || 'A'", "yyyy || '-H' || h", "half", "yyyy", "h", "A", 1.0),
    ("h || 'S''' || yy", "yyyy || '-H' || h", "half", "yyyy", "h", "", 0.9),
    ("month || ' ' || yyyy", "yyyy || '-' || mm", "month", "yyyy", "m", "", 1.0),
    ("mon || '/''' || yy", "yyyy || '-' || mm", "month", "yyyy", "m", "", 0.9),
    ("yyyy || '/' || mm", "yyyy || '-' || mm", "month", "yyyy", "m", "", 1.0),
    ("' ' || yyyy || ' '", "yyyy", "year", "yyyy", "NULL", "", 1.0),
    ("'Const. Year ' || n", "'Const-Year' || n", "phase", "0", "n", "", 0.9),
    ("'Operations yr. ' || n", "'Ops-Year' || n", "phase", "1", "n", "", 0.9),
    ("'Yr. ' || n || 'A'", "'Year' || n || 'A'", "relative", "NULL", "n", "A", 0.9),
    ("'COD - ' || n", "'COD-' || n", "cod", "NULL", "-n", "", 0.95),
    ("'COD+' || n", "'COD+' || n", "cod", "NULL", "n", "", 0.95),
    ("'cod'", "'COD'", "cod", "NULL", "0", "", 0.95),
    ("'Post-COD'", "'PostCOD'", "cod", "NULL", "999", "", 0.95),
    ("n || '-month stub'", "'Stub-' || n || 'M'", "stub", "NULL", "n", "", 0.8),
    ("'Short Period'", "'Stub'", "stub", "NULL", "0", "", 0.8),
    ("'Mayhem ' || yy", None, None, "NULL", "NULL", "", None),
    ("mon || yy", None, None, "NULL", "NULL", "", None),
]
PARTS = "SELECT *, CAST(o_orderkey % {} AS INT) AS k, strftime(o_orderdate, '%Y') AS yyyy, strftime(o_orderdate, '%y') AS yy, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%b') AS mon, strftime(o_orderdate, '%B') AS month, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS h, o_custkey % 40 + 1 AS n FROM orders".format(len(CASES))


def _case(i: int, null: str) -> str:
    value = lambda x: null if x is None else x if i < 2 else f"CAST({x} AS INT)" if i in (3, 4) else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"
    return "CASE k " + " ".join(f"WHEN {k} THEN {value(c[i])}" for k, c in enumerate(CASES)) + " END"


FORMS = f"""parts AS ({PARTS}), forms AS (SELECT o_orderkey, o_custkey, k, {_case(0, 'NULL')} AS raw, {_case(1, 'NULL')} AS normalized, {_case(2, 'NULL')} AS kind, {_case(3, 'NULL')} AS year, {_case(4, 'NULL')} AS sub, {_case(5, 'NULL')} AS flag, {_case(6, 'NULL')} AS confidence FROM parts)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = roles.table(spark, sf_dir, "orders"), F.col("o_orderdate")
    y, n = F.year(d), (F.col("o_custkey") % 40 + 1).cast("string")
    yyyy, yy, mm, mon, month = (F.date_format(d, x) for x in ("yyyy", "yy", "MM", "MMM", "MMMM"))
    q, h, after = F.quarter(d).cast("string"), F.when(F.month(d) <= 6, "1").otherwise("2"), F.right((y + 1).cast("string"), F.lit(2))

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    forms = [
        text("FY ", yyyy, "E"), text("fy", yy, "/", after), text("FYE ", mon, " '", yy, "a"), text("FYE ", month, "/", yyyy), text("CY'", yy, " P"), text("TTM to ", mon), text(yyyy, " F"), text("Q", q, " '", yy, "E"), text(yyyy, "q", q, "A"),
        text("H", h, " ", yyyy, "A"), text(h, "S'", yy), text(month, " ", yyyy), text(mon, "/'", yy), text(yyyy, "/", mm), text(" ", yyyy, " "), text("Const. Year ", n), text("Operations yr. ", n), text("Yr. ", n, "A"), text("COD - ", n), text("COD+", n),
        text("cod"), text("Post-COD"), text(n, "-month stub"), text("Short Period"), text("Mayhem ", yy), text(mon, yy),
    ]
    k = (F.col("o_orderkey") % len(forms)).cast("int")
    return o.select("o_orderkey", "o_custkey", k.alias("k"), F.element_at(F.array(*forms), k + 1).alias("raw"))


@query("WITH " + FORMS + " SELECT o_orderkey, raw, normalized, kind, year, sub, CASE WHEN kind IS NOT NULL THEN flag = 'A' END AS is_actual, CASE WHEN kind IS NOT NULL THEN flag = 'F' END AS is_forecast, confidence FROM forms")
def period_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of the grammar, and two that are none."""
    rows = _raw(spark, sf_dir).withColumn("p", periods.normalize(F.col("raw")))
    return rows.select("o_orderkey", "raw", "p.*")


@query("WITH " + FORMS + """, keys AS (SELECT DISTINCT o_custkey, raw, CASE WHEN kind IS NULL THEN 1 ELSE 0 END AS a, CASE kind WHEN 'relative' THEN 2 WHEN 'phase' THEN 3 WHEN 'cod' THEN 4 WHEN 'stub' THEN 5 WHEN 'trailing' THEN 6 ELSE 1 END AS b, COALESCE(year, 0) AS c, CASE kind WHEN 'half' THEN 1 WHEN 'quarter' THEN 2 WHEN 'month' THEN 3 ELSE 0 END AS d, COALESCE(sub, 0) AS e, CASE WHEN flag = 'A' THEN 0 WHEN flag = 'F' THEN 2 ELSE 1 END AS f FROM forms)
SELECT o_custkey, raw, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY a, b, c, d, e, f, raw) AS INT) AS place FROM keys""")
def period_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each customer's orders in the order of time."""
    rows = _raw(spark, sf_dir).select("o_custkey", "raw").distinct()
    key = periods.sort_key(F.col("raw"), periods.normalize(F.col("raw")))
    return rows.withColumn("key", key).select("o_custkey", "raw", F.row_number().over(Window.partitionBy("o_custkey").orderBy("key")).alias("place"))


@query("SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%m-%d') IN ('12-31', '01-01') THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS normalized, CAST(year(o_orderdate) AS INT) AS year, CAST(CASE WHEN strftime(o_orderdate, '%m-%d') NOT IN ('12-31', '01-01') THEN month(o_orderdate) END AS INT) AS sub FROM orders")
def period_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as periods."""
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", periods.of_date(F.col("o_orderdate")).alias("p")).select("o_orderkey", "p.normalized", "p.year", "p.sub")


#: Each customer is a row of a sheet, its orders the cells: some hold a number instead of a text.
ROWS = FORMS + ", cells AS (SELECT o_custkey AS row_index, CASE WHEN o_custkey % 4 = 0 THEN CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_custkey % 9 + CASE WHEN o_custkey % 8 = 0 AND o_orderkey % 9 = 0 THEN 50 ELSE 0 END AS VARCHAR) WHEN o_orderkey % 17 <> 0 THEN raw END AS value, CASE WHEN o_custkey % 4 <> 0 AND o_orderkey % 17 <> 0 THEN kind END AS kind FROM forms)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + c % 9 + F.when((c % 8 == 0) & (k % 9 == 0), 50).otherwise(0)
    return _raw(spark, sf_dir).select(F.lit("s").alias("sheet"), c.alias("row_index"), F.when(c % 4 == 0, number.cast("string")).when(k % 17 != 0, F.col("raw")).alias("value"))


@query("WITH " + ROWS + """, n AS (SELECT row_index, COUNT(value) AS filled, COUNT(kind) AS periods, COUNT(DISTINCT kind) AS kinds FROM cells GROUP BY 1), t AS (SELECT row_index, kind FROM (SELECT row_index, kind, COUNT(*) AS c FROM cells WHERE kind IS NOT NULL GROUP BY 1, 2) QUALIFY ROW_NUMBER() OVER (PARTITION BY row_index ORDER BY c DESC, kind) = 1)
SELECT 's' AS sheet, row_index, periods, kind AS dominant, ROUND(CAST(periods AS DOUBLE) / filled * CASE kinds WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 ELSE 0.8 END, 4) AS confidence FROM n JOIN t USING (row_index) WHERE periods >= 2 AND CAST(periods AS DOUBLE) / filled >= 0.4""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of period cells, with the kind that most of them have."""
    return sheets.header_rows(_cells(spark, sf_dir))


@query("WITH " + ROWS + ", v AS (SELECT row_index, COUNT(value) AS filled, list(TRY_CAST(value AS INT)) FILTER (TRY_CAST(value AS INT) <= 100) AS ns FROM (SELECT row_index, CASE WHEN regexp_full_match(value, '[0-9]{1,3}') THEN value ELSE CASE WHEN value IS NOT NULL THEN 'x' END END AS value FROM cells) GROUP BY 1) SELECT 's' AS sheet, row_index, CAST(list_min(ns) AS INT) AS first, CAST(list_max(ns) AS INT) AS last, ROUND(0.7 * (CAST(len(ns) AS DOUBLE) / filled), 4) AS confidence FROM v WHERE len(ns) >= 3 AND len(list_distinct(ns)) = len(ns) AND list_max(ns) - list_min(ns) = len(ns) - 1 AND CAST(len(ns) AS DOUBLE) / filled >= 0.4")
def numeric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of consecutive numbers."""
    return sheets.numeric_rows(_cells(spark, sf_dir))
