"""Aggregation, join and governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as op
from ..operators.facts import page
from ..sources import roles
from ..sources.roles import double
from .base import ENTITIES, FACTS, ITEMS, JOBS, ORACLES, dbl, query, with_

NOW = "2001-08-02 00:00:00"


@query(f"""SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderdate AS created_at, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS BIGINT) AS age_days FROM orders
WHERE (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 30 DAY) OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 900 DAY)""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending and processing for longer than each may take; now is an argument."""
    now = F.to_timestamp_ntz(F.lit(NOW))
    old = lambda days: F.col("created_at") < now - F.expr(f"interval {days} day")
    rows = roles.jobs(spark, sf_dir).where(((F.col("status") == "P") & old(30)) | ((F.col("status") == "O") & old(900)))
    return rows.select("job_id", "status", "created_at", F.date_diff(F.to_date(now), F.to_date("created_at")).cast("long").alias("age_days"))


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'co') OR contains(lower(p_type), 'steel') OR len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'le'))) > 0""")
def taxonomy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring of name, display name or any alias."""
    part = roles.table(spark, sf_dir, "part")
    hit = F.lower("p_name").contains("co") | F.lower("p_type").contains("steel") | F.exists(F.split("p_name", " "), lambda x: F.lower(x).contains("le"))
    return part.where(hit).select("p_partkey", "p_name", "p_type")


PRIORITY = "(CASE WHEN m = 'unmapped' THEN 5 ELSE 0 END + CASE WHEN c >= 0.4 AND c <= 0.7 THEN 3 WHEN c > 0.7 AND c <= 0.8 THEN 1 ELSE 0 END + CASE WHEN flags > 0 THEN 2 ELSE 0 END + CASE WHEN method NOT IN ('pattern', 'user', '') THEN 1 ELSE 0 END)"
REVIEWED = "CASE WHEN l_partkey % 13 = 0 THEN 'unmapped' ELSE l_returnflag END AS m, CAST(d AS DOUBLE) * 10 AS c, l_linenumber % 2 AS flags, CASE l_linestatus WHEN 'O' THEN 'llm' ELSE 'pattern' END AS method"


@query(with_(ITEMS) + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m, score FROM (SELECT *, {PRIORITY} AS score FROM (SELECT *, {REVIEWED} FROM items)) WHERE score > 0 ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that most need a review; scores add up from mapping, confidence, flags and method."""
    method = F.when(F.col("l_linestatus") == "O", "llm").otherwise("pattern")
    mapped = F.when(F.col("l_partkey") % 13 == 0, "unmapped").otherwise(F.col("l_returnflag"))
    rows = roles.items(spark, sf_dir).select("*", mapped.alias("m"), (F.col("d").cast("double") * 10).alias("c"), (F.col("l_linenumber") % 2).alias("flags"), method.alias("method"))
    c = F.col("c")
    score = F.when(F.col("m") == "unmapped", 5).otherwise(0) + F.when(c.between(0.4, 0.7), 3).when((c > 0.7) & (c <= 0.8), 1).otherwise(0) + F.when(F.col("flags") > 0, 2).otherwise(0) + F.when(~F.col("method").isin("pattern", "user", ""), 1).otherwise(0)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return page(rows.withColumn("score", score).where("score > 0"), [F.desc("score"), *keys], 10).select(*keys, "m", "score")


@query(with_(ITEMS) + """, c AS (SELECT DISTINCT l_partkey AS label, l_suppkey, CASE WHEN l_partkey % 13 = 0 THEN 'unmapped' ELSE l_returnflag END AS m, CAST(d AS DOUBLE) * 10 AS conf, p FROM items WHERE yr = 1996),
e AS (SELECT l_returnflag AS m, MIN('rule_' || l_linestatus) AS rule FROM items WHERE l_discount = 0 AND l_quantity = 50 GROUP BY 1)
SELECT label, m, conf, reason FROM (SELECT c.*, CASE WHEN c.m = 'unmapped' THEN 'unmapped' WHEN conf < 0.8 THEN 'low_confidence' ELSE rule END AS reason, ROW_NUMBER() OVER (PARTITION BY label ORDER BY conf, c.m, p, l_suppkey) AS rn
 FROM c LEFT JOIN e ON c.m = e.m WHERE c.m = 'unmapped' OR conf < 0.8 OR rule IS NOT NULL) WHERE rn = 1""")
def remap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped, unsure or flagged by an error rule; one row for each label."""
    li = roles.items(spark, sf_dir)
    rows = li.where("yr = 1996").select(F.col("l_partkey").alias("label"), "l_suppkey", F.when(F.col("l_partkey") % 13 == 0, "unmapped").otherwise(F.col("l_returnflag")).alias("m"), (F.col("d").cast("double") * 10).alias("conf"), "p").distinct()
    errors = li.where("l_discount = 0 and l_quantity = 50").groupBy(F.col("l_returnflag").alias("m")).agg(F.min(F.concat(F.lit("rule_"), "l_linestatus")).alias("rule"))
    reason = F.when(F.col("m") == "unmapped", "unmapped").when(F.col("conf") < 0.8, "low_confidence").otherwise(F.col("rule"))
    found = rows.join(F.broadcast(errors), "m", "left").withColumn("reason", reason).where("reason is not null")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("conf", "m", "p", "l_suppkey"))
    return found.withColumn("rn", rank).where("rn = 1").select("label", "m", "conf", "reason")


@query(with_(JOBS) + f""", r AS (SELECT entity_id, CAST(created_at AS DATE) AS day, cost FROM jobs)
SELECT CASE WHEN grouping(entity_id) = 1 AND grouping(day) = 1 THEN 'total' WHEN grouping(day) = 1 THEN 'entity' ELSE 'day' END AS level, entity_id, day, COUNT(*) AS n, CAST(SUM(cost) AS DOUBLE) AS total, {dbl('CAST(SUM(cost) AS DOUBLE) / COUNT(*)')} AS average
FROM r GROUP BY GROUPING SETS ((), (entity_id), (day))""")
def cost_totals_by_entity_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.costs(roles.jobs(spark, sf_dir))


@query(with_(ENTITIES) + "SELECT a.entity_id, b.entity_id AS other_id, b.name AS other, a.industry FROM entities a JOIN entities b ON a.industry = b.industry AND a.entity_id <> b.entity_id WHERE a.entity_id <= 5")
def industry_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the same industry, but not the entity itself."""
    e = roles.entities(spark, sf_dir)
    a = e.where("entity_id <= 5").select("entity_id", "industry")
    b = e.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other"), "industry")
    return a.join(b, "industry").where("entity_id <> other_id").select("entity_id", "other_id", "other", "industry")


@query(with_(ITEMS) + f"""SELECT p_brand AS category, COUNT(*) AS total, COUNT(*) FILTER (n IS NULL) AS never_mapped, {dbl('CAST(COUNT(n) AS DOUBLE) / COUNT(*) * 100')} AS coverage_pct FROM part LEFT JOIN (SELECT l_partkey, COUNT(*) AS n FROM items WHERE yr = 1996 AND q > 25 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1""")
def taxonomy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of items of each category that were ever mapped."""
    part = roles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("category"))
    used = roles.items(spark, sf_dir).where("yr = 1996 and q > 25").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return part.join(used, "l_partkey", "left").groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.expr("n is null")).alias("never_mapped"), double(F.count("n").cast("double") / F.count("*") * 100).alias("coverage_pct"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def never_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a mapping (anti join)."""
    used = roles.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return roles.table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(with_(FACTS) + f""", c AS (SELECT DISTINCT user_id AS entity_id, CAST(json_extract(props, '$.k') AS INT) % 14 AS k FROM events WHERE event_type = 'error'),
f AS (SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, c.k IS NULL AS correct FROM facts LEFT JOIN c USING (entity_id, k))
SELECT b.bin, CAST(COUNT(f.bin) AS BIGINT) AS total, CAST(COUNT(*) FILTER (correct) AS BIGINT) AS correct, {dbl('CAST(COUNT(*) FILTER (correct) AS DOUBLE) / NULLIF(COUNT(f.bin), 0)', 6)} AS accuracy FROM (SELECT CAST(range AS INT) AS bin FROM range(10)) b LEFT JOIN f USING (bin) GROUP BY 1""")
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact is correct if it wasn't corrected; corrections are made distinct before the join."""
    e = roles.table(spark, sf_dir, "events").where("event_type = 'error'")
    fixed = e.select(F.col("user_id").alias("entity_id"), (F.get_json_object("props", "$.k").cast("int") % 14).alias("k")).distinct().withColumn("fixed", F.lit(True))
    rows = roles.facts(spark, sf_dir).join(fixed, ["entity_id", "k"], "left").select("confidence", F.col("fixed").isNull().alias("correct"))
    return op.histogram(rows)


@query(with_(JOBS) + "SELECT g.grade, CAST(COUNT(job_id) AS BIGINT) AS n FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS grade) g LEFT JOIN jobs ON jobs.grade = g.grade AND status <> 'P' GROUP BY 1")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = roles.jobs(spark, sf_dir).where("status <> 'P' and grade is not null").groupBy("grade").agg(F.count("*").alias("n"))
    return op.zero_filled(counts, "grade", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"])


@query("""SELECT lower(trim(p_name)) AS label, CAST(SUM(n) AS BIGINT) AS total, COUNT(DISTINCT entity) AS entities, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS variants FROM (SELECT p_name, p_brand, l_suppkey % 7 AS entity, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY 1 HAVING SUM(n) >= 10 AND COUNT(DISTINCT entity) >= 2""")
def unmapped_label_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = roles.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", (F.col("l_suppkey") % 7).alias("entity")).agg(F.count("*").alias("n"))
    part = roles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.trim("p_name")).alias("label"), F.col("p_brand").alias("variant"))
    return op.label_groups(li.join(part, "l_partkey"), 10, 2)


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS sheet, COUNT(*) FILTER (l_linestatus = 'O') AS mapped, COUNT(*) FILTER (l_linestatus = 'F') AS unmapped, COUNT(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def cell_mapping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses by sheet with the grand total from one rollup."""
    rows = roles.table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.grouping("l_returnflag").alias("g"), F.count_if(F.expr("l_linestatus = 'O'")).alias("mapped"), F.count_if(F.expr("l_linestatus = 'F'")).alias("unmapped"), F.count("*").alias("total"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("l_returnflag")).alias("sheet"), "mapped", "unmapped", "total")


@query(with_(FACTS, JOBS) + f"""SELECT (SELECT COUNT(DISTINCT entity_id) FROM facts) AS entities, (SELECT COUNT(*) FROM facts) AS n_facts, (SELECT COUNT(*) FROM jobs WHERE status = 'F') AS jobs_completed,
 NULLIF((SELECT {dbl('CAST(SUM(CAST(confidence AS DECIMAL(10,4))) AS DOUBLE) / COUNT(confidence)', 4)} FROM facts), 0) AS avg_confidence""")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals; an average of zero counts as missing."""
    f = roles.facts(spark, sf_dir).agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("n_facts"), F.nullif(double(F.sum(F.col("confidence").cast("decimal(10,4)")).cast("double") / F.count("confidence"), 4), F.lit(0.0)).alias("avg_confidence"))
    j = roles.jobs(spark, sf_dir).agg(F.count_if(F.expr("status = 'F'")).alias("jobs_completed"))
    return f.crossJoin(j).select("entities", "n_facts", "jobs_completed", "avg_confidence")


@query(with_(ITEMS) + f"""SELECT {dbl("CAST(COUNT(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / COUNT(*)", 6)} AS mapping_success, {dbl("CAST(COUNT(DISTINCT l_partkey) AS DOUBLE) / (SELECT COUNT(*) FROM part)", 6)} AS utilization, coalesce({dbl("CAST(COUNT(*) FILTER (q > 50) AS DOUBLE) / NULLIF(COUNT(*) FILTER (q > 100), 0)", 6)}, 0) AS acceptance, COUNT(DISTINCT l_suppkey) AS sources FROM items""")
def taxonomy_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = roles.table(spark, sf_dir, "part").agg(F.count("*").alias("size"))
    found = roles.items(spark, sf_dir).agg(F.count_if(F.expr("l_returnflag <> 'R'")).alias("ok"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("used"), F.count_if(F.expr("q > 50")).alias("yes"), F.count_if(F.expr("q > 100")).alias("asked"), F.count_distinct("l_suppkey").alias("sources"))
    c = F.col
    return found.crossJoin(size).select(op.ratio(c("ok"), c("n")).alias("mapping_success"), op.ratio(c("used"), c("size")).alias("utilization"), op.ratio(c("yes"), c("asked")).alias("acceptance"), "sources")


@query("""SELECT 'items' AS what, COUNT(*) AS n FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT 'entities', COUNT(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT 'orders', COUNT(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = 7
UNION ALL SELECT 'same_brand', COUNT(*) FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 7) UNION ALL SELECT 'same_name', COUNT(*) FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 7)""")
def impact_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on one name; each table is read once."""
    li = roles.table(spark, sf_dir, "lineitem").where("l_partkey = 7").agg(F.count("*").alias("items"), F.count_distinct("l_suppkey").alias("entities"), F.count_distinct("l_orderkey").alias("orders"))
    part = roles.table(spark, sf_dir, "part")
    one = part.where("p_partkey = 7").select(F.col("p_brand").alias("b"), F.col("p_name").alias("n"))
    same = part.join(F.broadcast(one), (F.col("p_brand") == F.col("b")) | (F.col("p_name") == F.col("n"))).agg(F.count_if(F.expr("p_brand = b")).alias("same_brand"), F.count_if(F.expr("p_name = n")).alias("same_name"))
    return li.crossJoin(same).selectExpr("stack(5, 'items', items, 'entities', entities, 'orders', orders, 'same_brand', same_brand, 'same_name', same_name) as (what, n)")


@query(f"""SELECT p_type AS created_by, COUNT(*) FILTER (p_size > 20) AS active, COUNT(*) FILTER (p_size <= 20) AS inactive, {dbl('CAST(SUM(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*)')} AS avg_price, CAST(SUM(p_size) AS BIGINT) AS uses, CAST(SUM(p_size) AS BIGINT) * 50 * 3.0 / 1e6 AS savings FROM part GROUP BY 1""")
def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and inactive patterns with what their uses saved (50 tokens at 3 per million each)."""
    return roles.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("created_by")).agg(F.count_if(F.expr("p_size > 20")).alias("active"), F.count_if(F.expr("p_size <= 20")).alias("inactive"), double(F.sum(F.col("p_retailprice").cast("decimal(12,2)")).cast("double") / F.count("*")).alias("avg_price"), F.sum("p_size").alias("uses")).withColumn("savings", F.col("uses").cast("double") * 50 * 3.0 / 1e6)


@query("SELECT event_type, " + ", ".join(f"arg_max(CAST(value AS DOUBLE), (ts, event_id)) FILTER (strftime(ts, '%Y%m%d') = '202401{d:02d}') AS d202401{d:02d}" for d in range(1, 11)) + " FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def category_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by day; a later run of the same day overwrites."""
    return _heatmap(roles.table(spark, sf_dir, "events").where("user_id % 3 = 0"))


@query(ORACLES["category_heatmap"].replace(" WHERE user_id % 3 = 0", ""))
def category_heatmap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category_heatmap over all users."""
    return _heatmap(roles.table(spark, sf_dir, "events"))


def _heatmap(events: DataFrame) -> DataFrame:
    days = [f"202401{d:02d}" for d in range(1, 11)]
    rows = events.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    out = rows.groupBy("event_type").pivot("day", days).agg(F.max_by("value", F.struct("ts", "event_id")))
    return out.select("event_type", *[F.col(d).alias(f"d{d}") for d in days])


@query(with_(FACTS) + f"SELECT entity_id, {dbl('CAST(SUM(CAST(CAST(n AS DOUBLE) / m AS DECIMAL(20,10))) AS DOUBLE) / COUNT(*)', 6)} AS coverage FROM (SELECT entity_id, canonical_name, COUNT(DISTINCT period) AS n FROM facts GROUP BY 1, 2) JOIN (SELECT entity_id, COUNT(DISTINCT period) AS m FROM facts GROUP BY 1) USING (entity_id) GROUP BY 1")
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over items of the share of the entity's periods that have a value."""
    f = roles.facts(spark, sf_dir)
    each = f.groupBy("entity_id", "canonical_name").agg(F.count_distinct("period").alias("n"))
    every = f.groupBy("entity_id").agg(F.count_distinct("period").alias("m"))
    share = (F.col("n").cast("double") / F.col("m")).cast("decimal(20,10)")
    return each.join(every, "entity_id").groupBy("entity_id").agg(double(F.sum(share).cast("double") / F.count("*"), 6).alias("coverage"))


INDICATORS = {"project_finance": ["cfads", "total_debt", "interest_expense", "capex"], "saas": ["arr", "cfo", "accounts_receivable"], "corporate": ["revenue", "cogs"]}


@query(with_(FACTS) + "SELECT entity_id, period, CASE " + " ".join(f"WHEN COUNT(DISTINCT canonical_name) FILTER (canonical_name IN ({', '.join(map(repr, names))})) >= {least} THEN '{model}'" for (model, names), least in zip(INDICATORS.items(), (3, 2, 2))) + " ELSE 'unknown' END AS model_type FROM facts GROUP BY 1, 2")
def model_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first model type with enough of its indicators."""
    out = F
    for (model, names), least in zip(INDICATORS.items(), (3, 2, 2)):
        out = out.when(F.count_distinct(F.when(F.col("canonical_name").isin(names), F.col("canonical_name"))) >= least, model)
    return roles.facts(spark, sf_dir).groupBy("entity_id", "period").agg(out.otherwise("unknown").alias("model_type"))


@query(with_(JOBS) + "SELECT o.o_custkey AS entity_id, o.o_orderkey AS job_id, o.o_orderdate AS created_at, COUNT(l_orderkey) AS n_facts, COUNT(*) FILTER (l_discount > 0.05) AS n_sensitive FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') o LEFT JOIN lineitem ON l_orderkey = o.o_orderkey WHERE rn = 1 GROUP BY ALL")
def covenant_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each entity's newest completed job, with the sensitive ones counted."""
    newest = op.latest_per_entity(roles.jobs(spark, sf_dir).where("status = 'F'"))
    li = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_discount")
    return newest.join(li, "job_id", "left").groupBy("entity_id", "job_id", "created_at").agg(F.count("l_discount").alias("n_facts"), F.count_if(F.expr("l_discount > 0.05")).alias("n_sensitive"))


@query(with_(FACTS) + "SELECT entity_id, y.period FROM (SELECT DISTINCT entity_id FROM facts WHERE canonical_name = 'cash') e CROSS JOIN (SELECT DISTINCT period FROM facts) y WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND f.period = y.period AND f.canonical_name = 'cash')")
def missing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that others have and an entity lacks; the period list is small and distinct."""
    f = roles.facts(spark, sf_dir)
    own = f.where("canonical_name = 'cash'").select("entity_id", "period").distinct()
    return own.select("entity_id").distinct().crossJoin(F.broadcast(f.select("period").distinct())).join(own, ["entity_id", "period"], "left_anti")
