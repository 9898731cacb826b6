"""The mapping of labels of line items, in stages: patterns that fade, vectors, what a mapper said; then aliases, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade as op
from ..operators.score import decayed
from ..operators.vectors import hints
from ..sources import roles
from .base import query
from .gaps import COSINE

#: The vectors have no clusters, so a score that counts here lies lower than one that counts for labels.
NEAR = 0.25
SHEETS = ["P&L", "Balance Sheet", "Cash Flow", "Notes"]
SECTIONS = ["income_statement", "balance_sheet", "cash_flow"]
#: Names that are deprecated, and their targets.
REDIRECTS = [("brand_3", "brand_4"), ("brand_4", "brand_5"), ("brand_9", "brand_1")]

LABEL, BRAND = "p_name || ' ' || p_partkey % 60", "replace(lower(p_brand), '#', '_')"
CATEGORY = "['income_statement', 'balance_sheet', 'cash_flow'][CAST(regexp_extract({}, '[0-9]+$') AS INT) % 3 + 1]"
SQL = f"""WITH p AS (SELECT {LABEL} AS label, {BRAND} AS name, p_partkey AS k FROM part),
items AS (SELECT label, ['P&L', 'Balance Sheet', 'Cash Flow', 'Notes'][l_suppkey % 4 + 1] AS sheet, CASE WHEN l_linenumber = 7 THEN ['income_statement', 'balance_sheet', 'cash_flow'][l_orderkey % 3 + 1] END AS section, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN p ON k = l_partkey),
ctx AS (SELECT label, COALESCE(section, CASE sheet WHEN 'P&L' THEN 'income_statement' WHEN 'Balance Sheet' THEN 'balance_sheet' WHEN 'Cash Flow' THEN 'cash_flow' END) AS category, MIN(seq) AS pos FROM items GROUP BY ALL HAVING category IS NOT NULL),
labels AS (SELECT DISTINCT label FROM items),
vocabulary AS (SELECT DISTINCT name, {CATEGORY.format("name")} AS category FROM p WHERE name <> 'brand_7'),
pat AS (SELECT label, name, CASE WHEN k % 5 = 0 THEN c ELSE c * GREATEST(0.5::DOUBLE, 1 - CAST(k % 400 AS DOUBLE) / 365 * 0.3) END AS confidence FROM (SELECT *, CAST(94 + k % 7 AS DOUBLE) / 100 AS c FROM p WHERE k % 3 = 0)),
pattern AS (SELECT label, name, confidence, 'entity_pattern' AS method FROM pat WHERE confidence >= 0.95 AND label IN (FROM labels) QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY confidence DESC, name) = 1),
v AS (SELECT vec_id, label AS class, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings WHERE embedding IS NOT NULL),
asked AS (SELECT label, arg_min(vector, vec_id) AS vector FROM p JOIN v ON vec_id = k WHERE label IN (FROM labels) AND label NOT IN (SELECT label FROM pattern) GROUP BY 1),
dict AS (SELECT 'brand_' || (class + 10) AS name, arg_min(vector, vec_id) AS vector FROM v GROUP BY class),
embedding AS (SELECT label, d.name, {COSINE.format("a.vector", "d.vector")} AS confidence, 'embedding' AS method FROM asked a CROSS JOIN dict d WHERE confidence >= {NEAR} QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY confidence DESC, d.name) = 1),
best AS (SELECT label, name, CAST(k % 100 AS DOUBLE) / 100 AS confidence FROM p WHERE k % 4 <> 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY k % 100 DESC, name) = 1),
said AS (SELECT label, COALESCE(vocabulary.name, 'unmapped') AS name, CASE WHEN vocabulary.name IS NULL THEN 0 ELSE confidence END AS confidence FROM labels LEFT JOIN best USING (label) LEFT JOIN vocabulary ON vocabulary.name = best.name WHERE label NOT IN (SELECT label FROM pattern) AND label NOT IN (SELECT label FROM embedding)),
e AS (SELECT lower(label) AS alias, name, {CATEGORY.format("name")} AS category, CASE WHEN k % 8 <> 2 THEN k % 3 + 1 END AS priority, k AS seq FROM p WHERE k % 2 = 0 AND k % 11 <> 0),
r AS (SELECT *, COUNT(*) OVER (PARTITION BY alias) AS total, COUNT(*) OVER c AS n, COUNT(priority) OVER c AS known, COALESCE(MIN(priority) OVER (PARTITION BY alias, category, name), 999) AS p FROM e WINDOW c AS (PARTITION BY alias, category)),
w AS (SELECT *, MIN(p) OVER (PARTITION BY alias, category) AS least FROM r),
b AS (SELECT alias, category, MIN(n) AS n, MIN(total) AS total, CASE WHEN MIN(n) = 1 THEN MIN(name) END AS one, CASE WHEN MIN(known) > 0 AND COUNT(*) FILTER (p = least) = 1 THEN MIN(name) FILTER (p = least) END AS winner FROM w GROUP BY 1, 2),
m AS (SELECT s.*, c.pos, b.*, EXISTS (SELECT 1 FROM e JOIN ctx x ON x.category = e.category WHERE x.label = s.label AND e.alias = s.label AND e.name = s.name) AS fits FROM said s JOIN ctx c USING (label) JOIN b ON b.alias = lower(s.label) AND b.category = c.category),
o AS (SELECT label, pos, CASE WHEN name = 'unmapped' AND n = 1 THEN [one, 'rescued'] WHEN name = 'unmapped' AND winner IS NOT NULL THEN [winner, 'rescued_priority'] WHEN name <> 'unmapped' AND NOT fits AND n = 1 AND one <> name THEN [one, 'category'] WHEN name <> 'unmapped' AND n > 1 AND winner <> name THEN [winner, 'priority'] END AS choice, name = 'unmapped' OR n > 1 AS later FROM m),
first AS (SELECT label, choice FROM o WHERE choice IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY later, pos) = 1),
alone AS (SELECT alias, MIN(name) AS name FROM e GROUP BY 1 HAVING COUNT(*) = 1),
settled AS (SELECT s.label, COALESCE(choice[1], CASE WHEN s.name = 'unmapped' THEN alone.name END, s.name) AS name, confidence, 'mapper' AS method, COALESCE(choice[2], CASE WHEN s.name = 'unmapped' AND alone.name IS NOT NULL THEN 'rescued_global' END) AS resolved_by FROM said s LEFT JOIN first USING (label) LEFT JOIN alone ON alias = lower(s.label)),
a AS (SELECT *, NULL AS resolved_by FROM pattern UNION ALL SELECT *, NULL FROM embedding UNION ALL SELECT * FROM settled),
f AS (SELECT *, CASE name WHEN 'brand_3' THEN 'brand_4' WHEN 'brand_4' THEN 'brand_5' WHEN 'brand_9' THEN 'brand_1' ELSE name END AS target FROM a)
SELECT label, target AS canonical_name, ROUND(confidence, 6) AS confidence, method, resolved_by, CASE WHEN target <> f.name THEN f.name END AS redirected_from, COALESCE(category, 'unknown') AS category FROM f LEFT JOIN vocabulary ON vocabulary.name = target"""


def _mapped(spark: SparkSession, sf_dir: str, least: float | None) -> DataFrame:
    k, pick = F.col("k"), lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    p = roles.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 60).cast("string")).alias("label"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("canonical_name"), F.col("p_partkey").alias("k"))
    category = pick(SECTIONS, F.regexp_extract("canonical_name", "[0-9]+$", 0).cast("int") % 3).alias("category")
    lines = roles.table(spark, sf_dir, "lineitem").join(p, k == F.col("l_partkey"))
    section = F.when(F.col("l_linenumber") == 7, pick(SECTIONS, F.col("l_orderkey") % 3))
    items = lines.select("label", pick(SHEETS, F.col("l_suppkey") % 4).alias("sheet"), section.alias("section_category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    embedded = roles.table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("vector"))
    dictionary = embedded.groupBy("class").agg(F.min_by("vector", "vec_id").alias("vector")).select(F.concat(F.lit("brand_"), (F.col("class") + 10).cast("string")).alias("item"), "vector")

    def patterns(rest: DataFrame) -> DataFrame:
        sure = decayed((94 + k % 7).cast("double") / 100, k % 400, k % 5 == 0)
        return p.where("k % 3 = 0").select("label", "canonical_name", sure.alias("confidence")).join(rest, "label", "left_semi")

    def vectors(rest: DataFrame) -> DataFrame:
        asked = p.join(rest, "label", "left_semi").join(embedded, k == F.col("vec_id")).groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector"))
        return hints(asked.withColumnRenamed("label", "vec_id"), dictionary, NEAR, NEAR, 1).select(F.col("vec_id").alias("label"), F.col("item").alias("canonical_name"), F.col("score").alias("confidence"))

    def mapper(rest: DataFrame) -> DataFrame:
        return p.where("k % 4 <> 0").join(rest, "label", "left_semi").select("label", "canonical_name", ((k % 100).cast("double") / 100).alias("confidence"))

    vocabulary = p.where("canonical_name <> 'brand_7'").select("canonical_name", category).distinct()
    aliases = p.where("k % 2 = 0 and k % 11 <> 0").select(F.col("label").alias("alias"), "canonical_name", category, F.when(k % 8 != 2, k % 3 + 1).alias("priority"), k.alias("seq"))
    found = op.cascade(items, [("entity_pattern", patterns, 0.95), ("embedding", vectors, NEAR)], mapper, vocabulary, aliases, spark.createDataFrame(REDIRECTS, "name string, target string"), least)
    return found.withColumn("confidence", F.round("confidence", 6))


@query(SQL)
def mapping_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q/T07/N08/J18/J11: every label of the line items, without similarity, which has no SQL."""
    return _mapped(spark, sf_dir, None)


@query()
def mapping_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q/T03: the same, and what is still unmapped rescued by similarity."""
    return _mapped(spark, sf_dir, 80.0)
