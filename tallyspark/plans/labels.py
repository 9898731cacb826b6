"""Text functions over labels made of all orders, and rates looked up in the order cache, static table, inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rates, taxonomy
from ..operators.facts import first_wins, redirect
from ..sources import roles
from .base import query

#: A label of each kind, its kind, section and display name, over p (priority), y (year), n.
KINDS = [
    ("'Total ' || p", "subtotal"), ("p || ' (net)'", "subtotal"), ("'Gross profit'", "subtotal"), ("'network ' || n", "item"), ("'-----'", "separator"), ("' == '", "separator"), ("''", "item"),
    ("'Note ' || n", "note"), ("'(' || n || ') see below'", "note"), ("'FY ' || y", "year"), ("y || 'E'", "year"), ("'Q3 ' || y", "quarter"), ("p", "item"),
]
RAW = "SELECT o_orderkey, CASE o_orderkey % 13 {} END AS label, CASE o_orderkey % 13 {} END AS kind FROM (SELECT o_orderkey, o_orderpriority AS p, strftime(o_orderdate, '%Y') AS y, o_orderkey % 9 AS n FROM orders)".format(*[" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) for xs in ([k for k, _ in KINDS], [f"'{k}'" for _, k in KINDS])])


@query(RAW)
def row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10"""
    p, y, n = F.col("o_orderpriority"), F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 9).cast("string")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    labels = [join("Total ", p), join(p, " (net)"), join("Gross profit"), join("network ", n), join("-----"), join(" == "), join(""), join("Note ", n), join("(", n, ") see below"), join("FY ", y), join(y, "E"), join("Q3 ", y), p]
    rows = roles.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*labels), (F.col("o_orderkey") % 13 + 1).cast("int")).alias("label"))
    return rows.withColumn("kind", text.row_kind(F.col("label")))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'income_statement' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'cash_flow' WHEN 3 THEN 'debt' ELSE 'other' END AS section, ['Low Order', 'Net Income', 'Total Debt X', 'Ebitda'][o_orderkey % 4 + 1] AS display, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 26 + 1 ELSE (o_orderkey % 20 + 1) * 26 + o_orderkey % 26 + 1 END AS INT) AS column_number,
 'Sheet1!A' || (o_orderkey % 7 + 1) || '|B2' AS refs, CASE WHEN o_orderkey % 4 = 0 THEN 'formula' WHEN o_orderkey % 4 = 1 THEN 'input' WHEN o_orderkey % 4 = 2 THEN 'label' ELSE 'value' END AS cell FROM orders""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, columns, references, display names and cell types."""
    k = F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    letters = F.when(k % 3 == 0, F.char(65 + k % 26)).otherwise(F.concat(F.char(65 + k % 20), F.char(65 + k % 26)))
    formula = F.concat(F.lit("=SUM(Sheet1!$A$"), (k % 7 + 1).cast("string"), F.lit(",B2,B2)"))
    cell = text.cell_type(F.when(k % 4 == 0, formula), F.when(k % 4 == 2, "text").otherwise("12.5"), k % 4 == 1)
    return roles.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.section_category(pick("Profit and loss", "Total assets", "Cash flows", "Loan facility", "Cover")).alias("section"), text.display(pick("low_order", "net_income", "total_debt_x", "ebitda")).alias("display"),
        text.column_number(letters).alias("column_number"), F.array_join(text.references(formula), "|").alias("refs"), cell.alias("cell"),
    )


#: Rates that hold where none is cached.
STATIC = [("USD", "EUR", 0.92), ("USD", "GBP", 0.79), ("USD", "JPY", 149.5)]


@query("""WITH c AS (SELECT ['USD', 'EUR', 'CHF'][o_orderkey % 3 + 1] AS base, 'EUR' AS quote, CAST(o_orderdate AS DATE) AS day, MAX(CAST(o_orderkey % 50 + 50 AS DOUBLE) / 100) AS rate FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 1 GROUP BY ALL), newest AS (SELECT base, quote, arg_max(rate, (day, rate)) AS rate FROM c GROUP BY 1, 2),
r AS (SELECT o_orderkey, ['USD', 'EUR', 'CHF', 'GBP', 'SEK'][o_orderkey % 5 + 1] AS base, ['EUR', 'USD'][o_orderkey % 2 + 1] AS quote, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(14,2)) AS value FROM orders),
s(base, quote, rate) AS (VALUES ('USD', 'EUR', 0.92::DOUBLE), ('USD', 'GBP', 0.79::DOUBLE), ('USD', 'JPY', 149.5::DOUBLE)),
j AS (SELECT r.*, CASE WHEN r.base = r.quote THEN 1.0::DOUBLE END AS a, c.rate AS b, n.rate AS d, s.rate AS e, ROUND(1 / i.rate, 8) AS f FROM r LEFT JOIN c ON c.base = r.base AND c.quote = r.quote AND c.day = r.day LEFT JOIN newest n ON n.base = r.base AND n.quote = r.quote LEFT JOIN s ON s.base = r.base AND s.quote = r.quote LEFT JOIN s i ON i.quote = r.base AND i.base = r.quote)
SELECT o_orderkey, base, quote, COALESCE(a, b, d, e, f) AS rate, CASE WHEN a IS NOT NULL THEN 'same' WHEN b IS NOT NULL THEN 'exact' WHEN d IS NOT NULL THEN 'newest' WHEN e IS NOT NULL THEN 'static' WHEN f IS NOT NULL THEN 'inverse' END AS source FROM j""")
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of cached, static and inverse rates."""
    o, k = roles.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    day = F.to_date("o_orderdate").alias("day")
    cache = o.where("o_orderkey % 4 = 0 and o_orderkey % 3 <> 1").select(pick("USD", "EUR", "CHF").alias("base"), F.lit("EUR").alias("quote"), day, ((k % 50 + 50).cast("double") / 100).alias("rate"))
    rows = o.select("o_orderkey", pick("USD", "EUR", "CHF", "GBP", "SEK").alias("base"), pick("EUR", "USD").alias("quote"), day, F.col("o_totalprice").cast("decimal(14,2)").alias("value"))
    return rates.lookup(rows, cache, spark.createDataFrame(STATIC, "base string, quote string, rate double")).select("o_orderkey", "base", "quote", "rate", "source")


@query("WITH r AS (SELECT o_custkey AS job_id, o_orderpriority AS canonical_name, year(o_orderdate) AS period, o_orderkey AS seq, o_totalprice AS value FROM orders), f AS (SELECT * FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id, canonical_name, period ORDER BY seq) = 1) SELECT job_id, CASE canonical_name WHEN '5-LOW' THEN '4-NOT SPECIFIED' WHEN '1-URGENT' THEN '2-HIGH' ELSE canonical_name END AS canonical_name, period, seq, value FROM f")
def first_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first write of each job, name and period, with deprecated names redirected."""
    rows = roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("canonical_name"), F.year("o_orderdate").alias("period"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    gone = spark.createDataFrame([("5-LOW", "4-NOT SPECIFIED"), ("1-URGENT", "2-HIGH")], "name string, target string")
    return redirect(first_wins(rows, ["job_id", "canonical_name", "period"], "seq"), gone)


CASCADE = """p AS (SELECT p_name || ' ' || p_partkey % 700 AS label, p_brand AS canonical_name, p_partkey AS k FROM part), s AS (
 SELECT label, canonical_name, CAST(90 + k % 11 AS DOUBLE) / 100 AS confidence, 'pattern' AS method, 0 AS stage FROM p WHERE k % 3 = 0 AND 90 + k % 11 >= 95 UNION ALL
 SELECT label, 'e' || canonical_name, CAST(80 + k % 20 AS DOUBLE) / 100, 'embedding', 1 FROM p WHERE k % 4 = 0 AND 80 + k % 20 >= 92 UNION ALL
 SELECT label, 'm' || canonical_name, CAST(k % 100 AS DOUBLE) / 100, 'mapper', 2 FROM p WHERE k % 5 <> 0 AND k % 100 >= 30),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY stage, confidence DESC, canonical_name) = 1),
c AS (SELECT label, COALESCE(canonical_name, 'unmapped') AS canonical_name, COALESCE(confidence, 0.0) AS confidence, COALESCE(method, 'none') AS method FROM (SELECT DISTINCT label FROM p) LEFT JOIN b USING (label))"""


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    p = roles.table(spark, sf_dir, "part").withColumn("label", F.concat_ws(" ", "p_name", (k % 700).cast("string")))
    stage = lambda mark, low, n, keep: p.where(keep).select("label", F.concat(F.lit(mark), "p_brand").alias("canonical_name"), ((low + k % n).cast("double") / 100).alias("confidence"))
    stages = [("pattern", stage("", 90, 11, "p_partkey % 3 = 0"), 0.95), ("embedding", stage("e", 80, 20, "p_partkey % 4 = 0"), 0.92), ("mapper", stage("m", 0, 100, "p_partkey % 5 <> 0"), 0.30)]
    return p, taxonomy.cascade(p, stages)


@query("WITH " + CASCADE + " SELECT * FROM c")
def mapping_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q"""
    return _cascade(spark, sf_dir)[1]


@query("WITH " + CASCADE + ", n AS (SELECT label, CASE WHEN MIN(k) % 6 = 0 THEN 'unmapped' ELSE 'second' END AS name, CAST(MIN(k) % 90 AS DOUBLE) / 100 AS sure FROM p WHERE k % 2 = 0 GROUP BY 1) SELECT label, CASE WHEN sure > confidence AND name <> 'unmapped' THEN name ELSE canonical_name END AS canonical_name, CASE WHEN sure > confidence AND name <> 'unmapped' THEN sure ELSE confidence END AS confidence, CASE WHEN sure > confidence AND name <> 'unmapped' THEN 'remapped' ELSE method END AS method FROM c LEFT JOIN n USING (label)")
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q: a second pass accepts only higher confidence."""
    p, first = _cascade(spark, sf_dir)
    k = F.min("p_partkey")
    new = p.where("p_partkey % 2 = 0").groupBy("label").agg(F.when(k % 6 == 0, "unmapped").otherwise("second").alias("canonical_name"), ((k % 90).cast("double") / 100).alias("confidence"))
    return taxonomy.remapped(first, new)
