"""Records and small reports over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as op
from ..operators import sheets as sheet_op
from ..sources import roles
from .base import query
from .checks import CROSS, statement_checks
from .rules import DIMENSIONS as JOB_DIMENSIONS
from .rules import SCORED, job_dimensions, quality_score

#: Parts as taxonomy items, in one document for each type.
ITEMS = "items AS (SELECT p_type AS category, 'c' || p_partkey AS canonical_name, p_name AS display, CASE WHEN p_partkey % 3 <> 0 THEN [upper(p_brand), ' ' || p_name || ' '] END AS aliases, p_size AS priority, CASE WHEN p_partkey % 5 = 0 THEN ['r' || p_size] END AS rules FROM part)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    item = F.struct(
        F.concat(F.lit("c"), k.cast("string")).alias("canonical_name"), name.alias("display"), F.when(k % 3 != 0, F.array(F.upper("p_brand"), F.concat(F.lit(" "), name, F.lit(" ")))).alias("aliases"), F.col("p_size").alias("priority"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("r"), F.col("p_size").cast("string")))).alias("rules"),
    )
    by = roles.table(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_list(item).alias("items"))
    return by.select(F.to_json(F.struct(F.map_from_arrays(F.array("p_type"), F.array("items")).alias("categories"))).alias("content"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.taxonomy_items(_documents(spark, sf_dir))


@query("WITH " + ITEMS + " SELECT category, canonical_name, display, array_to_string(aliases, '|') AS aliases, priority, array_to_string(rules, '|') AS rules FROM items")
def taxonomy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items out of JSON documents."""
    return _items(spark, sf_dir).withColumns({"aliases": F.array_join("aliases", "|"), "rules": F.array_join("rules", "|")})


@query("WITH " + ITEMS + ", a AS (SELECT lower(trim(unnest(list_append(COALESCE(aliases, []), display)))) AS alias, canonical_name, priority FROM items) SELECT alias, canonical_name, MIN(priority) AS priority FROM a WHERE alias <> '' GROUP BY 1, 2")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11"""
    return op.alias_index(_items(spark, sf_dir))


@query("WITH " + ITEMS + " SELECT category, canonical_name, rules[1] AS rule FROM items WHERE len(rules) > 0")
def items_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12"""
    return op.with_rules(_items(spark, sf_dir)).select("category", "canonical_name", F.col("rules")[0].alias("rule"))


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = o_orderkey % 3000) THEN 'c' || o_orderkey % 3000 ELSE 'unmapped' END AS canonical_name, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = o_orderkey % 3000) THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM orders")
def validated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N08"""
    rows = roles.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), (F.col("o_orderkey") % 3000).cast("string")).alias("canonical_name"), F.lit(0.5).alias("confidence"))
    return op.validated_names(rows, _items(spark, sf_dir))


@query("WITH a AS (SELECT p_brand AS canonical_name, list_sort(list(DISTINCT p_name) FILTER (p_partkey % 2 = 0)) AS x, list_sort(list(DISTINCT p_name) FILTER (p_partkey % 2 = 1)) AS y FROM part GROUP BY 1) SELECT canonical_name, array_to_string(list_concat(COALESCE(x, []), list_filter(COALESCE(y, []), lambda v: NOT list_contains(COALESCE(x, []), v))), '|') AS aliases FROM a")
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of even parts, then those of odd ones."""
    part = roles.table(spark, sf_dir, "part")
    of = lambda r: part.where(f"p_partkey % 2 = {r}").groupBy(F.col("p_brand").alias("canonical_name")).agg(F.array_sort(F.collect_set("p_name")).alias("aliases"))
    return op.merged_aliases(of(0), of(1)).withColumn("aliases", F.array_join("aliases", "|"))


STAGES = ["signup", "view", "click", "purchase", "audit"]


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") * 100 + F.col("event_id") % 97).alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.col("event_id").alias("n"), (F.col("event_id") % 3 != 0).alias("completed"))


LINEAGE = "e AS (SELECT user_id * 100 + event_id % 97 AS job_id, event_type AS stage, ts, event_id AS n, event_id % 3 <> 0 AS completed FROM events)"


@query("WITH " + LINEAGE + " SELECT job_id, stage, ts AS at, n, CAST(ROW_NUMBER() OVER w AS INT) AS place, LAG(stage) OVER w AS before FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, n)")
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10"""
    return op.lineage_chain(_lineage(spark, sf_dir))


@query("WITH " + LINEAGE + f", g AS (SELECT job_id, COUNT(*) AS events, CAST(COUNT(DISTINCT stage) AS INT) AS stages, MIN(ts) AS first_at, MAX(ts) AS last_at, list(DISTINCT stage) AS s FROM e GROUP BY 1) SELECT job_id, events, stages, first_at, last_at, array_to_string(list_filter({STAGES!r}, lambda x: NOT list_contains(s, x)), '|') AS missing, len(list_filter({STAGES!r}, lambda x: NOT list_contains(s, x))) = 0 AS is_complete FROM g")
def lineage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R/U06"""
    return op.lineage_summary(_lineage(spark, sf_dir), STAGES)


@query("WITH " + LINEAGE + f" SELECT job_id, {STAGES!r}[COALESCE(MAX(list_position({STAGES!r}, stage)) FILTER (completed), 0) + 1] AS resume_from FROM e GROUP BY 1")
def next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R32"""
    return op.next_stage(_lineage(spark, sf_dir), STAGES)


@query(CROSS.replace(" SELECT * FROM found WHERE passed IS NOT NULL", "") + ", c AS (SELECT * FROM found WHERE passed IS NOT NULL), f AS (SELECT entity_id, item, COUNT(*) AS flags, string_agg(DISTINCT rule, '|' ORDER BY rule) AS rules, bool_or(severity = 'error') AS e FROM c WHERE NOT passed GROUP BY 1, 2) SELECT entity_id, item, COALESCE(flags, 0) AS flags, COALESCE(rules, '') AS rules, NOT COALESCE(e, FALSE) AS all_passed FROM (SELECT DISTINCT entity_id, item FROM c) LEFT JOIN f USING (entity_id, item)")
def validation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed statement checks as flags of their items."""
    found = statement_checks(spark, sf_dir)
    return op.validation_records(found.where("not passed"), found, ["entity_id", "item"])


@query(CROSS.replace(" SELECT * FROM found WHERE passed IS NOT NULL", "") + " SELECT DISTINCT entity_id, item FROM found WHERE passed EXCEPT SELECT entity_id, item FROM found WHERE NOT passed")
def passed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U09"""
    found = statement_checks(spark, sf_dir)
    return op.passed_patterns(found.where("passed"), found.where("not passed"), ["entity_id", "item"])


@query("""WITH a AS (SELECT l_orderkey AS job, l_linenumber AS label, MIN(l_returnflag) AS c, MIN(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT o_orderkey AS job_a, o_orderkey + 1 AS job_b FROM orders WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = orders.o_orderkey + 1)),
d AS (SELECT job_a, job_b, CASE WHEN x.label IS NULL THEN 'added' WHEN y.label IS NULL THEN 'removed' WHEN x.c <> y.c THEN 'mapping_changed' WHEN x.v <> y.v THEN 'value_changed' ELSE 'unchanged' END AS change FROM (SELECT p.*, unnest([1, 2, 3, 4, 5, 6, 7]) AS label FROM p) q LEFT JOIN a x ON x.job = job_a AND x.label = q.label LEFT JOIN a y ON y.job = job_b AND y.label = q.label WHERE x.label IS NOT NULL OR y.label IS NOT NULL)
SELECT d.job_a, d.job_b, COUNT(*) FILTER (change = 'added') AS added, COUNT(*) FILTER (change = 'removed') AS removed, COUNT(*) FILTER (change = 'mapping_changed') AS mapping_changed, COUNT(*) FILTER (change = 'value_changed') AS value_changed, COUNT(*) FILTER (change = 'unchanged') AS unchanged, e.o_custkey <> f.o_custkey AS cross_entity
FROM d JOIN orders e ON e.o_orderkey = job_a JOIN orders f ON f.o_orderkey = job_b GROUP BY ALL""")
def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against the next."""
    o, li = roles.table(spark, sf_dir, "orders"), roles.table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("label")).agg(F.min("l_returnflag").alias("c"), F.min("l_quantity").alias("v"))
    jobs = o.select(F.col("o_orderkey").alias("job_a")).join(o.select((F.col("o_orderkey") - 1).alias("job_a")), "job_a", "left_semi")
    a = jobs.join(lines.withColumnRenamed("job", "job_a"), "job_a").select("job_a", "label", F.col("c").alias("c_a"), F.col("v").alias("v_a"))
    b = jobs.join(lines.withColumn("job_a", F.col("job") - 1), "job_a").select("job_a", "label", F.col("c").alias("c_b"), F.col("v").alias("v_b"))
    change = F.when(F.col("c_a").isNull(), "added").when(F.col("c_b").isNull(), "removed").when(F.col("c_a") != F.col("c_b"), "mapping_changed").when(F.col("v_a") != F.col("v_b"), "value_changed").otherwise("unchanged")
    diff = a.join(b, ["job_a", "label"], "full").select("job_a", (F.col("job_a") + 1).alias("job_b"), change.alias("change"))
    return op.diff_report(diff, o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("entity_id")))


@query(SCORED + ", g AS (SELECT *, ['F', 'D', 'C', 'B', 'A'][rank] AS grade FROM r), l AS (SELECT job_id, grade, unnest(['mapping', 'validation', 'completeness', 'series', 'cells']) AS dimension, unnest([mapping, validation, completeness, series, cells]) AS value FROM g WHERE grade IN ('C', 'D', 'F')) SELECT job_id, grade, dimension, value, CAST(ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY value, dimension) AS INT) AS place FROM l WHERE value IS NOT NULL QUALIFY place <= 2")
def quality_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R26"""
    rows = job_dimensions(spark, sf_dir).join(quality_score(spark, sf_dir).select("job_id", "grade"), "job_id")
    return op.diagnostics(rows, ["mapping", "validation", "completeness", "series", "cells"])


PATTERNS = [("3", "debt"), ("7", "cash_flow")]


@query("""WITH r AS (SELECT 'sheet ' || o_custkey % 50 AS sheet, o_orderkey AS row_index, o_orderpriority AS label FROM orders), s AS (SELECT 'sheet ' || l_suppkey % 50 AS sheet, l_orderkey AS start, MIN(l_orderkey + l_partkey % 30) AS stop, MIN(l_returnflag) AS category FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 = 0 GROUP BY 1, 2)
SELECT sheet, row_index, label, COALESCE((SELECT CASE WHEN arg_max(stop, start) >= r.row_index THEN arg_max(category, start) END FROM s WHERE s.sheet = r.sheet AND s.start <= r.row_index), CASE WHEN sheet LIKE '%3%' THEN 'debt' WHEN sheet LIKE '%7%' THEN 'cash_flow' ELSE 'unknown' END) AS category FROM r""")
def category_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R19/R17"""
    name = lambda c: F.concat(F.lit("sheet "), (F.col(c) % 50).cast("string"))
    rows = roles.table(spark, sf_dir, "orders").select(name("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row_index"), F.col("o_orderpriority").alias("label"))
    li = roles.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_partkey % 3 = 0")
    sections = li.groupBy(name("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("start")).agg(F.min(F.col("l_orderkey") + F.col("l_partkey") % 30).alias("end"), F.min("l_returnflag").alias("category"))
    return op.category_context(rows, sections, PATTERNS)


@query("""WITH r AS (SELECT o_custkey AS sheet, o_orderkey AS row_index, CASE WHEN o_orderkey % 7 = 0 THEN 'Total ' || o_orderpriority WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS label, o_orderkey % 4 = 0 AS is_bold, o_orderkey % 5 AS formulas FROM orders)
SELECT sheet, COUNT(*) AS rows, CAST(SUM(formulas) AS BIGINT) AS formulas, COALESCE(bool_or(label LIKE 'Total%'), FALSE) AS has_subtotal, COALESCE(array_to_string(list(label ORDER BY row_index) FILTER (label IS NOT NULL)[1:5], '|'), '') AS first_labels, COALESCE(array_to_string(list(label ORDER BY row_index) FILTER (label IS NOT NULL AND is_bold)[1:10], '|'), '') AS bold_labels FROM r GROUP BY 1""")
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a sheet."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    label = F.when(k % 7 == 0, F.concat(F.lit("Total "), p)).when(k % 11 != 0, p)
    return op.sheet_summary(roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), k.alias("row_index"), label.alias("label"), (k % 4 == 0).alias("is_bold"), (k % 5).alias("formulas")))


@query("WITH r AS (SELECT o_custkey AS sheet, o_orderkey AS row_index, o_orderpriority AS label, o_totalprice AS v, o_orderkey % 3 AS k, o_custkey % 4 = 0 AND o_orderkey % 5 = 0 AS p FROM orders), s AS (SELECT sheet FROM r GROUP BY 1 HAVING COUNT(*) >= 3 AND NOT bool_or(p)) SELECT sheet, row_index, label, 'static' AS period, CASE WHEN k = 1 THEN v + 1 ELSE v END AS value FROM r JOIN s USING (sheet) WHERE k < 2")
def static_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14"""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    values = F.array(F.when(k % 3 == 0, v), F.when(k % 3 == 1, v + 1))
    return op.static_values(roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), k.alias("row_index"), F.col("o_orderpriority").alias("label"), values.alias("values"), ((F.col("o_custkey") % 4 == 0) & (k % 5 == 0)).alias("has_periods")))


@query("""WITH p AS (SELECT l_suppkey AS entity_id, 'label ' || l_partkey % 60 AS label, 'c' || MIN(l_partkey % 7) AS canonical_name, COUNT(*) AS count FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY count DESC, label) AS place FROM p QUALIFY place <= 20),
m AS (SELECT l_suppkey AS entity_id, 'label ' || l_partkey % 60 AS label, 'm' || MIN(l_partkey % 5) AS canonical_name, MAX(CAST(l_partkey % 100 AS DOUBLE) / 100) AS confidence FROM lineitem GROUP BY 1, 2), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY confidence DESC, label, canonical_name) AS place FROM m WHERE confidence >= 0.9 AND NOT EXISTS (SELECT 1 FROM a WHERE a.entity_id = m.entity_id AND a.label = m.label) QUALIFY place <= 10)
SELECT entity_id, label, canonical_name, 'pattern' AS source, CAST(place AS INT) AS place FROM a UNION ALL SELECT entity_id, label, canonical_name, 'mapping', CAST(place AS INT) FROM b""")
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R22"""
    k = F.col("l_partkey")
    li = roles.table(spark, sf_dir, "lineitem").withColumns({"entity_id": F.col("l_suppkey"), "label": F.concat(F.lit("label "), (k % 60).cast("string"))})
    name = lambda letter, n: F.concat(F.lit(letter), F.min(k % n).cast("string")).alias("canonical_name")
    patterns = li.where(k % 2 == 0).groupBy("entity_id", "label").agg(name("c", 7), F.count("*").alias("count"))
    return op.entity_context(patterns, li.groupBy("entity_id", "label").agg(name("m", 5), F.max((k % 100).cast("double") / 100).alias("confidence")))


@query("SELECT l_returnflag AS canonical_name, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2)) * CASE l_linenumber WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 1 END) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14"""
    n = F.col("l_linenumber")
    unit = F.when(n == 1, "thousands").when(n == 2, "millions").when(n == 3, "billions")
    value = op.scaled(F.col("l_quantity").cast("decimal(12,2)"), unit)
    return roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("canonical_name")).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("value"))


#: Cells with one merged range for each sheet.
@query("SELECT o_custkey AS sheet, k AS r, j AS c, CASE WHEN k <= 2 AND j <= 2 THEN first ELSE 'v' || k || j END AS value FROM (SELECT o_custkey, MIN(o_orderpriority) AS first FROM orders GROUP BY 1), (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS j)")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top left value of a range of two rows and columns in all its cells."""
    sheets = roles.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sheet")).agg(F.min("o_orderpriority").alias("first"))
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    cells = sheets.withColumn("r", F.explode(three)).withColumn("c", F.explode(three))
    value = F.when((F.col("r") == 1) & (F.col("c") == 1), F.col("first")).when((F.col("r") > 2) | (F.col("c") > 2), F.concat(F.lit("v"), F.col("r").cast("string"), F.col("c").cast("string")))
    merged = sheets.select("sheet", F.lit(1).alias("r1"), F.lit(1).alias("c1"), F.lit(2).alias("r2"), F.lit(2).alias("c2"))
    return sheet_op.spread_merged(cells.select("sheet", "r", "c", value.alias("value")), merged).select("sheet", "r", "c", "value")
