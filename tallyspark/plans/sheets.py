"""Sheet, exchange, accuracy and dictionary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, rates, sheets, vectors
from ..sources import roles
from .base import ENTITIES, FACTS, ITEMS, dbl, query, with_


@query("""SELECT c.conv_id, c.turn, c.role, s.title AS section FROM conversations c LEFT JOIN (SELECT DISTINCT conv_id, turn AS start, turn + 2 AS stop, 'part ' || turn AS title FROM conversations WHERE turn % 4 = 0) s
 ON c.conv_id = s.conv_id AND c.turn BETWEEN s.start AND s.stop""")
def section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's section by range."""
    c = roles.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    found = c.where("turn % 4 = 0").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 2).alias("stop"), F.concat(F.lit("part "), F.col("turn").cast("string")).alias("title")).distinct()
    return sheets.in_section(c, found, ["conv_id"], "turn")


@query("""SELECT conv_id, turn, array_to_string(list(role || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), '|') AS context,
 last_value(CASE WHEN turn % 5 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS header FROM conversations""")
def row_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels around each row and the nearest header before it."""
    c = roles.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("label"), (F.col("turn") % 5).alias("level"))
    return sheets.context(c, ["conv_id"], "turn", "label", "level").select("conv_id", "turn", "context", "header")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day_no FROM events),
s AS (SELECT *, CASE WHEN day_no - LAG(day_no) OVER (PARTITION BY user_id ORDER BY day_no) >= 3 THEN 1 ELSE 0 END AS step FROM d)
SELECT user_id, region, MIN(day_no) AS first, MAX(day_no) AS last, COUNT(*) AS n FROM (SELECT *, CAST(SUM(step) OVER (PARTITION BY user_id ORDER BY day_no) AS BIGINT) AS region FROM s) GROUP BY 1, 2""")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands over each user's days."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return sheets.islands(roles.table(spark, sf_dir, "events").select("user_id", day.alias("at")).distinct(), ["user_id"], "at", 3)


#: Currency, first day and rate to the base currency of the example.
RATES = [(c, f"{y}-01-15", round(base * (1 + (y - 1994) * step), 4)) for c, base, step in (("EUR", 1.1, 0.01), ("GBP", 1.3, -0.02), ("JPY", 0.007, 0.03), ("CHF", 1.05, 0.02)) for y in range(1994, 2000)]


@query(with_(FACTS, ENTITIES) + f""", rates AS (SELECT * FROM (VALUES {", ".join(f"('{c}', DATE '{d}', CAST({r} AS DECIMAL(12,4)))" for c, d, r in RATES)}) v(currency, day, rate)),
f AS (SELECT entity_id, canonical_name, period, value, currency, CAST(created_at AS DATE) AS day FROM facts JOIN entities USING (entity_id))
SELECT f.entity_id, f.canonical_name, f.period, f.currency, CAST(f.value AS DOUBLE) AS value, CAST(r.rate AS DOUBLE) AS rate, {dbl('CAST(f.value AS DECIMAL(24,8)) * r.rate')} AS converted FROM f ASOF LEFT JOIN rates r ON f.currency = r.currency AND f.day >= r.day""")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact by the rate of its entity's currency that held when it was made."""
    listed = spark.createDataFrame(RATES, "currency string, day string, rate double").withColumn("rate", F.col("rate").cast("decimal(12,4)"))
    rows = roles.facts(spark, sf_dir).join(roles.entities(spark, sf_dir).select("entity_id", "currency"), "entity_id").select("entity_id", "canonical_name", "period", "currency", "value", "created_at")
    return rates.convert(rows, listed).select("entity_id", "canonical_name", "period", "currency", F.col("value").cast("double"), F.col("rate").cast("double"), "converted")


RATED = "SELECT lang, quality AS expected, CASE WHEN n_chars > 400 THEN 1 WHEN n_chars > 50 THEN 0 END AS predicted FROM labels JOIN documents USING (doc_id)"


@query(f"""WITH x AS ({RATED}), c AS (SELECT lang, COUNT(*) FILTER (predicted = expected) AS tp, COUNT(*) FILTER (predicted IS NOT NULL AND predicted IS DISTINCT FROM expected) AS fp, COUNT(*) AS n FROM x GROUP BY 1)
SELECT lang, tp, fp, n - tp AS fn, {dbl('CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)', 6)} AS precision, {dbl('CAST(tp AS DOUBLE) / NULLIF(n, 0)', 6)} AS recall, {dbl('2 * CAST(tp AS DOUBLE) / NULLIF(tp + fp + n, 0)', 6)} AS f1 FROM c""")
def accuracy_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against expected labels, by group."""
    d = roles.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = roles.table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("expected"), F.when(F.col("n_chars") > 400, 1).when(F.col("n_chars") > 50, 0).alias("predicted"))
    return aggregates.precision_recall(rows, ["lang"])


@query(with_(ITEMS) + f""", x AS (SELECT l_returnflag AS grp, CAST(p AS DOUBLE) AS e, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(p AS DOUBLE) + CASE WHEN l_linenumber % 3 = 0 THEN CAST(q AS DOUBLE) * 100 ELSE 0 END END AS a FROM items)
SELECT grp, COUNT(a) AS compared, COUNT(*) FILTER (abs(e - a) < 1e-9) AS exact, COUNT(*) FILTER (abs(e - a) <= greatest(abs(e) * 0.05, 1.0)) AS within, {dbl('CAST(SUM(CAST(abs(e - a) AS DECIMAL(30,8))) AS DOUBLE) / NULLIF(COUNT(a), 0)', 4)} AS mae,
 {dbl('CAST(SUM(CAST(abs(e - a) / NULLIF(abs(e), 0) * 100 AS DECIMAL(30,8))) AS DOUBLE) / NULLIF(COUNT(*) FILTER (a IS NOT NULL AND e <> 0), 0)', 4)} AS mape FROM x GROUP BY 1""")
def value_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of extracted values; every fifth is missing, every third is off."""
    e = F.col("p").cast("double")
    actual = F.when(F.col("l_linenumber") % 5 != 0, e + F.when(F.col("l_linenumber") % 3 == 0, F.col("q").cast("double") * 100).otherwise(0.0))
    return aggregates.value_errors(roles.items(spark, sf_dir).select(F.col("l_returnflag").alias("grp"), e.alias("expected"), actual.alias("actual")), ["grp"], 0.05, 1.0)


@query(with_(ITEMS) + """, s AS (SELECT DISTINCT l_orderkey FROM items)
SELECT s.l_orderkey AS sheet, 10 AS r, 1 AS c, CAST(SUM(q + p) AS DOUBLE) AS total FROM s LEFT JOIN items i ON i.l_orderkey = s.l_orderkey AND l_linenumber BETWEEN 1 AND 3 GROUP BY 1
UNION ALL SELECT s.l_orderkey, 11, 2, CAST(-SUM(p) AS DOUBLE) FROM s LEFT JOIN items i ON i.l_orderkey = s.l_orderkey AND l_linenumber BETWEEN 2 AND 5 GROUP BY 1""")
def formula_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sums over ranges of cells, as a join."""
    li = roles.items(spark, sf_dir)
    cells = li.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").cast("int").alias("r"), F.inline(F.array(F.struct(F.lit(1).alias("c"), F.col("q").cast("decimal(16,2)").alias("number")), F.struct(F.lit(2).alias("c"), F.col("p").cast("decimal(16,2)").alias("number")))))
    made = F.inline(F.array(F.struct(F.lit(10).alias("r"), F.lit(1).alias("c"), F.lit("=SUM(A1:B3)").alias("formula")), F.struct(F.lit(11).alias("r"), F.lit(2).alias("c"), F.lit("=-SUM($B$2:$B$5)").alias("formula"))))
    formulas = li.select(F.col("l_orderkey").alias("sheet")).distinct().select("sheet", made)
    return sheets.range_sums(formulas, cells).withColumn("total", F.col("total").cast("double"))


VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH v AS (SELECT vec_id, {VEC} AS vector FROM embeddings WHERE embedding IS NOT NULL), d AS (SELECT vec_id AS item, vector FROM v WHERE vec_id < 40),
s AS (SELECT v.vec_id, item, round(list_sum(list_transform(list_zip(v.vector, d.vector), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.vector, lambda p: p * p))) * sqrt(list_sum(list_transform(d.vector, lambda p: p * p)))), 6) AS score FROM v CROSS JOIN d),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY score DESC, item) AS rank FROM s WHERE score >= 0.80)
SELECT vec_id, item, score, CAST(rank AS INT) AS rank, score >= 0.92 AS accepted FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M/F16: the best of 40 dictionary items for each vector."""
    v = roles.table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return vectors.hints(v, v.where("vec_id < 40").select(F.col("vec_id").alias("item"), "vector"))
