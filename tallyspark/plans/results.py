"""Results as JSON text: orders as jobs, their line items as what a result holds, with values of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import results as op
from ..sources import roles
from .base import query

#: Columns over line items, the same text for both engines; q is the quantity as a whole number.
NAME = "CASE l_linenumber WHEN 6 THEN NULL WHEN 7 THEN 'unmapped' ELSE 'item ' || (l_partkey % 20) END"
FIRST = "CASE l_partkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '\"n/a\"' WHEN 2 THEN '\" 12.5 \"' ELSE q || '.25' END"
SECOND = "CASE l_partkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN '[1]' ELSE CAST(q * 2 AS STRING) END"
PARSED = "CASE l_partkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{\"is_bold\": true, \"hierarchy_level\": ' || l_linenumber || '}' ELSE '{\"is_formula\": true, \"is_subtotal\": false}' END"
ROWS = """rows AS (SELECT *, CAST(l_quantity AS INT) AS q, year(l_shipdate) AS yr, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, year(l_shipdate)) - 1 AS pos FROM lineitem),
named AS (SELECT *, {0} AS name FROM rows WHERE l_linenumber < 6)""".format(NAME)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and its result; every third has its items under the name of a sample."""
    rows = roles.table(spark, sf_dir, "lineitem").withColumns({"q": F.col("l_quantity").cast("int"), "yr": F.year("l_shipdate")})
    name = F.coalesce(F.concat(F.lit('"'), F.expr(NAME), F.lit('"')), F.lit("null"))
    item = F.format_string('{"canonical_name": %s, "sheet": "s%d", "original_label": "l%d", "values": {"FY%d": %s, "FY%d": %s}, "provenance": {"parsing": %s}}', name, "l_linenumber", "l_partkey", "yr", F.expr(FIRST), F.col("yr") + 1, F.expr(SECOND), F.expr(PARSED))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "yr", item.alias("text"))))
    held = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("items"))
    return held.select("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, F.format_string('{"line_items": [], "sample_line_items": [%s]}', "items")).otherwise(F.format_string('{"line_items": [%s]}', "items")).alias("result"))


@query("WITH " + ROWS + """, j AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) QUALIFY rank <= 5),
v AS (SELECT o_custkey AS entity_id, rank, pos, n.* FROM j JOIN named n ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0),
a AS (SELECT entity_id, name AS canonical_name, 'FY' || yr AS period, rank, pos, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 12.5 ELSE q + 0.25 END AS value FROM v UNION ALL SELECT entity_id, name, 'FY' || (yr + 1), rank, pos, CASE l_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE q * 2 END FROM v)
SELECT entity_id, canonical_name, CASE WHEN CAST(substr(canonical_name, 6) AS INT) < 15 THEN 'category ' || (CAST(substr(canonical_name, 6) AS INT) % 3) END AS category, period, CAST(arg_min(value, (rank, pos)) AS DOUBLE) AS value FROM a WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4""")
def json_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each customer out of the results of its five newest completed jobs."""
    made = roles.table(spark, sf_dir, "orders").join(_results(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    jobs = made.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"), "result")
    known = roles.table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("i")).where("i < 15").distinct()
    return op.financials(jobs, known.selectExpr("'item ' || i AS canonical_name", "'category ' || (i % 3) AS category"))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What goes into the gold documents of orders: results by file, and mappings."""
    lines = roles.table(spark, sf_dir, "lineitem").where("l_linenumber < 6")
    maps = lines.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("n"), F.when(F.col("l_linenumber") < 5, F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))).alias("sheet"), F.concat(F.lit("l"), F.col("l_partkey").cast("string")).alias("original_label"), F.expr(NAME).alias("canonical_name"))
    return _results(spark, sf_dir).withColumnRenamed("l_orderkey", "file"), maps


def _read_back(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    results, maps = _gold(spark, sf_dir)
    return op.gold_tables(op.gold_written(maps, results))


@query("WITH " + ROWS + """, last AS (SELECT * FROM named QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, name ORDER BY pos DESC) = 1),
a AS (SELECT l_orderkey AS file, name AS canonical_name, 'FY' || yr AS period, CASE WHEN l_partkey % 5 >= 3 THEN CAST(q + 0.25 AS DOUBLE) END AS value FROM last UNION ALL SELECT l_orderkey, name, 'FY' || (yr + 1), CAST(CASE l_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE q * 2 END AS DOUBLE) FROM last)
SELECT *, 1::DOUBLE AS tolerance_pct, greatest(value * 0.01::DOUBLE, 0.5::DOUBLE) AS tolerance_abs FROM a WHERE value IS NOT NULL""")
def gold_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected values, through the documents and back."""
    return _read_back(spark, sf_dir)[1]


@query("WITH " + ROWS + " SELECT l_orderkey AS file, pos, name AS canonical_name, 's' || l_linenumber AS sheet, 'l' || l_partkey AS original_label, l_partkey % 3 = 1 AS is_bold, l_partkey % 3 = 2 AS is_formula, FALSE AS is_subtotal, CASE WHEN l_partkey % 3 = 1 THEN l_linenumber ELSE 0 END AS hierarchy_level FROM named WHERE l_partkey % 3 > 0")
def gold_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the items' cells look, through the documents and back."""
    return _read_back(spark, sf_dir)[2]


@query("WITH m AS (SELECT l_orderkey AS file, CASE WHEN l_linenumber < 5 THEN 's' || l_linenumber ELSE 'Unknown' END AS sheet FROM lineitem WHERE l_linenumber < 6) SELECT file, NULL AS sheet, COUNT(*) AS min_items, 75::DOUBLE AS min_coverage_pct FROM m GROUP BY 1 UNION ALL SELECT file, sheet, COUNT(*), 80::DOUBLE FROM m GROUP BY 1, 2")
def gold_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items asked of each statement and file, from the mappings that were read back."""
    return op.gold_completeness(_read_back(spark, sf_dir)[0])
