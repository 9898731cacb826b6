"""Gaps of a taxonomy over vectors: users of events as unmapped labels, the first vector of each class as its item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates
from ..operators import gaps as op
from ..sources import roles
from .base import query

#: The vectors have no clusters, so scores that count here lie lower than those that count for labels.
ALIAS, NEW, ALIKE = 0.25, 0.15, 0.2
#: Line items whose parts one task joins in pairs.
ROWS = 50_000
COSINE = "round(list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform({0}, lambda p: p * p))) * sqrt(list_sum(list_transform({1}, lambda p: p * p)))), 6)"
REPORT = """v AS (SELECT vec_id, label AS class, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings WHERE embedding IS NOT NULL),
said AS (SELECT user_id, COUNT(*) AS total, COUNT(DISTINCT event_type) AS entities FROM events GROUP BY 1 HAVING COUNT(*) >= 2 AND COUNT(DISTINCT event_type) >= 2),
report AS (SELECT 'label ' || vec_id AS label, total, entities, vector, ROW_NUMBER() OVER (ORDER BY total DESC, 'label ' || vec_id) AS n FROM said JOIN v ON vec_id = user_id QUALIFY n <= 200),
items AS (SELECT 'item ' || class AS item, arg_min(vector, vec_id) AS vector FROM v GROUP BY class)"""


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = roles.table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("vector"))
    said = roles.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id"), F.col("event_type").alias("entity")).agg(F.count("*").alias("n"))
    groups = aggregates.label_groups(said.select(F.concat(F.lit("label "), F.col("vec_id").cast("string")).alias("label"), "entity", "n", F.lit("").alias("variant")), 2, 2).drop("variants")
    labels = op.frequent(groups.join(v.select(F.concat(F.lit("label "), F.col("vec_id").cast("string")).alias("label"), "vector"), "label"))
    return labels, v.groupBy("class").agg(F.min_by("vector", "vec_id").alias("vector")).select(F.concat(F.lit("item "), F.col("class").cast("string")).alias("item"), "vector")


@query(f"""WITH {REPORT}, s AS (SELECT r.label, item, {COSINE.format("r.vector", "i.vector")} AS score FROM report r CROSS JOIN items i),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY score DESC, item) AS place FROM s WHERE score >= {NEW} QUALIFY place <= 3),
b AS (SELECT label, MAX(score) AS best_score, arg_min(item, place) AS best, string_agg(item, '|' ORDER BY place) AS matches FROM k GROUP BY 1)
SELECT label, total, entities, COALESCE(best_score, 0) AS best_score, CASE WHEN best_score >= {ALIAS} THEN 'alias_candidate' WHEN best_score IS NULL THEN 'new_item_candidate' ELSE 'ambiguous' END AS classification,
 CASE WHEN best_score >= {ALIAS} THEN best END AS suggested, COALESCE(matches, '') AS matches FROM report LEFT JOIN b USING (label)""")
def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: the 200 most frequent labels by their best item."""
    labels, items = _report(spark, sf_dir)
    return op.analyse(labels, items, ALIAS, NEW)


@query(f"""WITH RECURSIVE {REPORT}, near AS (SELECT a.n AS a, b.n AS b FROM report a JOIN report b ON a.n < b.n WHERE {COSINE.format("a.vector", "b.vector")} >= {ALIKE}),
before AS (SELECT r.n, COALESCE(list(a) FILTER (a IS NOT NULL), []) AS earlier FROM report r LEFT JOIN near ON b = r.n GROUP BY 1),
run(step, seeds) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT step + 1, CASE WHEN list_has_any(seeds, earlier) THEN seeds ELSE list_append(seeds, step + 1) END FROM run JOIN before ON n = step + 1),
last AS (SELECT arg_max(seeds, step) AS seeds FROM run),
member AS (SELECT r.n, COALESCE(MIN(a) FILTER (list_contains(seeds, a)), r.n) AS seed FROM report r CROSS JOIN last LEFT JOIN near ON b = r.n AND list_contains(seeds, a) GROUP BY r.n),
best AS (SELECT r.n AS seed, MAX({COSINE.format("r.vector", "i.vector")}) AS score FROM report r CROSS JOIN items i GROUP BY 1)
SELECT arg_min(label, n) AS representative, string_agg(label, '|' ORDER BY n) AS labels, COUNT(*) AS cluster_size, CAST(SUM(total) AS BIGINT) AS total, MAX(entities) AS entities, MAX(score) AS best_score, CASE WHEN MAX(score) >= {ALIAS} THEN 'add_alias' ELSE 'add_new_item' END AS action
FROM member JOIN report USING (n) JOIN best USING (seed) GROUP BY seed""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L/J16: the same labels grouped greedily, the most frequent first."""
    labels, items = _report(spark, sf_dir)
    return op.clusters(labels, op.alike(labels, ALIKE), items, ALIAS)


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), size AS (SELECT s, COUNT(*) AS parts, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, s) AS n FROM m GROUP BY 1),
near AS (SELECT x.n AS a, y.n AS b FROM (SELECT * FROM m JOIN size USING (s)) x JOIN (SELECT * FROM m JOIN size USING (s)) y ON x.p = y.p AND x.n < y.n GROUP BY 1, 2 HAVING COUNT(*) * 10 >= LEAST(MIN(x.parts), MIN(y.parts))),
before AS (SELECT r.n, COALESCE(list(a) FILTER (a IS NOT NULL), []) AS earlier FROM size r LEFT JOIN near ON b = r.n GROUP BY 1),
run(step, seeds) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT step + 1, CASE WHEN list_has_any(seeds, earlier) THEN seeds ELSE list_append(seeds, step + 1) END FROM run JOIN before ON n = step + 1),
last AS (SELECT arg_max(seeds, step) AS seeds FROM run),
member AS (SELECT r.n, COALESCE(MIN(a), r.n) AS seed FROM size r CROSS JOIN last LEFT JOIN near ON b = r.n AND list_contains(seeds, a) GROUP BY r.n)
SELECT x.s, y.s AS seed FROM member JOIN size x USING (n) JOIN size y ON y.n = seed""")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: suppliers that share a tenth of the smaller one's parts, grouped greedily, those with most parts first."""
    lines = roles.table(spark, sf_dir, "lineitem")
    m = lines.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    size = m.groupBy("s").agg(F.count("*").alias("parts")).withColumn("n", F.row_number().over(Window.orderBy(F.desc("parts"), "s")))
    # a part's rows meet in pairs, so what looks small before the join isn't after it: tasks of bounded rows, which Spark doesn't merge
    parts = m.join(size, "s").repartition(lines.count() // ROWS + 1, "p")
    a, b = parts.select("p", F.col("n").alias("a"), F.col("parts").alias("x")), parts.select("p", F.col("n").alias("b"), F.col("parts").alias("y"))
    near = a.join(b, "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), F.min(F.least("x", "y")).alias("least")).where("both * 10 >= least").select("a", "b")
    found = op.greedy_clusters(size, near)
    return found.join(size.select("n", "s"), "n").join(size.select(F.col("n").alias("seed"), F.col("s").alias("_s")), "seed").select("s", F.col("_s").alias("seed"))
