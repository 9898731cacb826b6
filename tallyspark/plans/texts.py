"""Text, period, taxonomy and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods, text
from ..operators import taxonomy as op
from ..operators.facts import resolve_conflicts
from ..sources import roles
from ..sources.store import settled
from .base import query


@query("SELECT p_partkey, trim(p_name) AS label, lower(trim(p_name)) AS comparable, array_to_string(list_sort(string_split(lower(trim(p_name)), ' ')), ' ') AS tokens FROM part")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names dressed up as spreadsheet labels and brought back."""
    part = roles.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    dressed = F.concat(F.when(k == 0, "- ").when(k == 1, "1.2) ").when(k == 2, "(a) ").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("  ")), F.when(k == 0, " ($M)").when(k == 1, " (excl. leases)").when(k == 2, " (in thousands)").otherwise(""), F.when(k < 2, ":").otherwise(""))
    bare = text.label(dressed)
    return part.select("p_partkey", bare.alias("label"), text.comparable(bare).alias("comparable"), text.sorted_tokens(bare).alias("tokens"))


@query("SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x, i: CASE WHEN i > 1 AND regexp_full_match(x, '[0-9]+') THEN '{id}' ELSE x END), '/') AS path, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS file_name FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "pages").select("page_id", text.url_path(F.col("url")).alias("path"), text.file_name(F.col("url")).alias("file_name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'none' AS missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON inside other text, read by path with a default."""
    e = roles.table(spark, sf_dir, "events")
    v = text.lenient_json(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" ok"))))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(v, "$.no.such", "string"), F.lit("none")).alias("missing"))


FORMS = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'FY' || yy WHEN 1 THEN 'Q' || q || '''' || yy WHEN 2 THEN yyyy || ' Q' || q WHEN 3 THEN mon || '-' || yy WHEN 4 THEN yyyy || 'E' WHEN 5 THEN h || 'H' || yy WHEN 6 THEN 'CY' || yy || 'A' ELSE 'see note ' || q END AS raw,
 CASE o_orderkey % 8 WHEN 0 THEN 'FY' || yyyy WHEN 1 THEN yyyy || '-Q' || q WHEN 2 THEN yyyy || '-Q' || q WHEN 3 THEN yyyy || '-' || mm WHEN 4 THEN yyyy || 'E' WHEN 5 THEN yyyy || '-H' || h WHEN 6 THEN 'CY' || yyyy || 'A' END AS normalized,
 CASE o_orderkey % 8 WHEN 0 THEN 'fiscal_year' WHEN 1 THEN 'quarter' WHEN 2 THEN 'quarter' WHEN 3 THEN 'month' WHEN 4 THEN 'year' WHEN 5 THEN 'half' WHEN 6 THEN 'calendar_year' END AS kind, CASE WHEN o_orderkey % 8 < 7 THEN CAST(yyyy AS INT) END AS year, CASE WHEN o_orderkey % 8 < 7 THEN o_orderkey % 8 = 4 END AS is_forecast,
 CASE WHEN o_orderkey % 8 IN (2, 4) THEN 1.0::DOUBLE WHEN o_orderkey % 8 < 7 THEN 0.9::DOUBLE END AS confidence
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS yyyy, strftime(o_orderdate, '%y') AS yy, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%b') AS mon, CAST(quarter(o_orderdate) AS VARCHAR) AS q, CASE WHEN month(o_orderdate) <= 6 THEN '1' ELSE '2' END AS h FROM orders)"""


def _raw_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d, k = roles.table(spark, sf_dir, "orders"), F.col("o_orderdate"), F.col("o_orderkey") % 8
    yyyy, yy, q = F.date_format(d, "yyyy"), F.date_format(d, "yy"), F.quarter(d).cast("string")
    h = F.when(F.month(d) <= 6, "1").otherwise("2")
    raw = F.when(k == 0, F.concat(F.lit("FY"), yy)).when(k == 1, F.concat(F.lit("Q"), q, F.lit("'"), yy)).when(k == 2, F.concat(yyyy, F.lit(" Q"), q)).when(k == 3, F.concat(F.date_format(d, "MMM"), F.lit("-"), yy)).when(k == 4, F.concat(yyyy, F.lit("E"))).when(k == 5, F.concat(h, F.lit("H"), yy)).when(k == 6, F.concat(F.lit("CY"), yy, F.lit("A"))).otherwise(F.concat(F.lit("see note "), q))
    return o.select("o_orderkey", raw.alias("raw"))


@query(FORMS)
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw_periods(spark, sf_dir).withColumn("p", periods.normalize(F.col("raw")))
    return rows.select("o_orderkey", "raw", "p.normalized", "p.kind", "p.year", "p.is_forecast", "p.confidence")


#: In the order of time: numbers, periods by year with the year's parts after it, forecasts behind, equal ones by their text; other text.
ORDERED = ["3.5", "2022", "FY2022", "H1 2022", "Q1 2022", "Q4 2022", "Jan-22", "2023", "FY2023", "FY2023E", "Q1 2023", "Jan-23", "Year 1", "foo"]


@query(f"SELECT CAST(i AS INT) AS place, x AS raw FROM (SELECT unnest({ORDERED!r}) AS x, unnest(range(1, {len(ORDERED) + 1})) AS i)")
def period_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O02 on a small list that holds each kind."""
    rows = spark.createDataFrame([(x,) for x in sorted(ORDERED)], "raw string").withColumn("p", periods.normalize(F.col("raw")))
    return rows.withColumn("k", periods.sort_key(F.col("raw"), F.col("p"))).select(F.row_number().over(Window.orderBy("k")).alias("place"), "raw")


@query("""WITH a AS (SELECT lower(p_name) AS alias, p_brand AS canonical_name, MIN(p_type) AS own, MIN(p_size) AS priority FROM part GROUP BY 1, 2), r AS (SELECT DISTINCT lower(p_name) AS label, p_type AS category FROM part),
m AS (SELECT *, COUNT(*) FILTER (own = category) OVER w AS n_same, MIN(priority) OVER w AS lowest FROM r JOIN a ON label = alias WINDOW w AS (PARTITION BY label, category)), n AS (SELECT *, COUNT(*) FILTER (priority = lowest) OVER (PARTITION BY label, category) AS n_low FROM m)
SELECT label, category, MAX(CASE WHEN n_same = 1 AND own = category THEN canonical_name WHEN n_same <> 1 AND n_low = 1 AND priority = lowest THEN canonical_name END) AS canonical_name, MAX(CASE WHEN n_same = 1 THEN 'category' WHEN n_low = 1 THEN 'priority' ELSE 'unresolved' END) AS resolved_by, COUNT(*) AS candidates FROM n GROUP BY 1, 2""")
def disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = roles.table(spark, sf_dir, "part")
    aliases = part.groupBy(F.lower("p_name").alias("alias"), F.col("p_brand").alias("canonical_name")).agg(F.min("p_type").alias("category"), F.min("p_size").alias("priority"))
    return op.disambiguate(part.select(F.lower("p_name").alias("label"), F.col("p_type").alias("category")).distinct(), aliases)


@query("SELECT lower(p_name) AS alias, COUNT(DISTINCT p_brand) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS names FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_brand) > 1")
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.alias_conflicts(roles.table(spark, sf_dir, "part").select(F.lower("p_name").alias("alias"), F.col("p_brand").alias("canonical_name")))


@query("""WITH a AS (SELECT p_name AS canonical_name, MIN(p_type) AS d, list(DISTINCT p_brand) AS x FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), b AS (SELECT p_name AS canonical_name, MIN(p_type) AS d, list(DISTINCT p_brand) AS x FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1)
SELECT canonical_name, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.d IS DISTINCT FROM b.d OR list_sort(a.x) <> list_sort(b.x) THEN 'changed' ELSE 'same' END AS change,
 array_to_string(list_sort(list_filter(coalesce(b.x, []), lambda v: NOT list_contains(coalesce(a.x, []), v))), '|') AS aliases_added, array_to_string(list_sort(list_filter(coalesce(a.x, []), lambda v: NOT list_contains(coalesce(b.x, []), v))), '|') AS aliases_removed FROM a FULL JOIN b USING (canonical_name)""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = roles.table(spark, sf_dir, "part")
    version = lambda k: part.where(F.col("p_partkey") % k != 0).groupBy(F.col("p_name").alias("canonical_name")).agg(F.min("p_type").alias("display"), F.collect_set("p_brand").alias("aliases"))
    return op.version_diff(version(3), version(4))


TREE = "SELECT r_name AS node, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (roles.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    none = F.lit(None).cast("string")
    edges = r.select(F.col("r_name").alias("node"), none.alias("parent")).unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))).unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("node"), F.col("n_name").alias("parent")))
    return op.levels(edges)


@query(f"WITH RECURSIVE e AS ({TREE}), t AS (SELECT node, parent, 0 AS level, node AS root, node AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.node, e.parent, level + 1, root, path || '/' || e.node FROM e JOIN t ON e.parent = t.node) SELECT * FROM t")
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).drop("ancestors")


@query(f"""WITH RECURSIVE e AS ({TREE}), v AS (SELECT s_name AS node, CAST(s_acctbal AS DECIMAL(14,2)) AS value FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT n_name, CAST(1000 AS DECIMAL(14,2)) FROM nation WHERE n_nationkey % 6 = 0),
u AS (SELECT node AS ancestor, node AS start, value FROM v UNION ALL SELECT e.parent, u.start, u.value FROM u JOIN e ON e.node = u.ancestor WHERE e.parent IS NOT NULL AND e.parent NOT IN (SELECT node FROM v))
SELECT ancestor AS node, CAST(SUM(value) AS DOUBLE) AS value, bool_or(ancestor = start) AS own FROM u GROUP BY 1""")
def statement_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = roles.table(spark, sf_dir, "supplier"), roles.table(spark, sf_dir, "nation")
    values = s.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("node"), F.col("s_acctbal").cast("decimal(14,2)").alias("value")).unionByName(n.where("n_nationkey % 6 = 0").select(F.col("n_name").alias("node"), F.lit(1000).cast("decimal(14,2)").alias("value")))
    return op.subtotals(_tree(spark, sf_dir), values).withColumn("value", F.col("value").cast("double"))


@query()
def fuzzy_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names against all names by token-sort ratio (no SQL form; tested against brute force)."""
    part = roles.table(spark, sf_dir, "part")
    labels = part.select(F.regexp_replace(F.reverse(F.split("p_name", " ")).cast("string"), r"[\[\],]", "").alias("label")).distinct()
    return op.fuzzy(labels, part.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical_name")))


@query()
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns, taxonomy and learned aliases as ranked sources (no SQL form of their scores)."""
    part = roles.table(spark, sf_dir, "part")
    labels = part.select(F.concat("p_name", F.lit("s")).alias("label")).distinct()
    scores = settled(op.fuzzy_scores(labels, part.select(F.col("p_name").alias("alias")), 60.0))  # once for the three sources
    best = lambda c: F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "alias", c))
    named = lambda c: scores.join(part.select(F.col("p_name").alias("alias"), F.col(c).alias("canonical_name")).distinct(), "alias")
    scored = lambda c: named(c).withColumn("n", best("canonical_name")).where("n = 1").select("label", "canonical_name", (F.col("score") / 100).alias("score"))
    return op.suggestions([(scored("p_brand"), 0.95), (scored("p_type"), 0.9), (scored("p_name"), 0.85)])


PATTERNS = "SELECT source AS entity, lang AS label, CAST(1 + doc_id % 7 AS VARCHAR) AS canonical_name, CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence, 1 AS count, doc_id + 1 AS seq FROM documents"


@query(f"WITH p AS ({PATTERNS}) SELECT entity, label, arg_min(canonical_name, (-confidence, seq)) AS canonical_name, MAX(confidence) AS confidence, CAST(SUM(count) AS BIGINT) AS occurrences FROM p GROUP BY 1, 2")
def pattern_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("entity"), F.col("lang").alias("label"), (F.col("doc_id") % 7 + 1).cast("string").alias("canonical_name"), ((F.col("doc_id") % 100).cast("double") / 100).alias("confidence"), F.lit(1).alias("count"), (F.col("doc_id") + 1).alias("seq"))
    return op.fold_patterns(rows, ["entity", "label"])


ALIASES = "SELECT lang AS canonical_name, 'a' || doc_id % 50 AS alias, CAST(SUM(CASE WHEN doc_id % 9 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS occurrences, list_sort(list(DISTINCT source)) AS entities FROM documents GROUP BY 1, 2"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents")
    return op.fold_aliases(d.select(F.col("lang").alias("canonical_name"), F.concat(F.lit("a"), (F.col("doc_id") % 50).cast("string")).alias("alias"), F.when(F.col("doc_id") % 9 == 0, 3).otherwise(1).alias("weight"), F.col("source").alias("entity")))


@query(f"SELECT canonical_name, alias, occurrences, array_to_string(entities, '|') AS entities FROM ({ALIASES})")
def alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir).withColumn("entities", F.array_join("entities", "|"))


@query(f"SELECT canonical_name, alias, occurrences, CAST(len(entities) AS INT) AS n_entities FROM ({ALIASES}) WHERE occurrences >= 5 AND len(entities) >= 2")
def auto_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.promotable(_aliases(spark, sf_dir), 5, 2).select("canonical_name", "alias", "occurrences", F.size("entities").alias("n_entities"))


@query("SELECT user_id, CASE WHEN MAX(ts) FILTER (event_type = 'signup') IS NULL OR date_diff('day', CAST(MAX(ts) FILTER (event_type = 'signup') AS DATE), DATE '2024-01-31') > 7 THEN TRUE ELSE FALSE END AS stale FROM events GROUP BY 1")
def stale_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.max(F.when(F.col("event_type") == "signup", F.col("ts")))).alias("seen"))
    return e.select("user_id", op.stale(F.col("seen"), F.lit("2024-01-31").cast("date"), 7).alias("stale"))


@query("SELECT sha256(text) AS content_hash, MIN(doc_id) AS doc_id, COUNT(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of each content; texts are hashed before the shuffle."""
    return roles.table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, lang, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY (lang = 'en') DESC, n_chars DESC, doc_id) = 1 AS is_active FROM documents")
def pattern_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pattern of each source stays active."""
    d = roles.table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return resolve_conflicts(d, ["source"], [(F.col("lang") == "en").desc(), F.desc("n_chars"), F.col("doc_id")]).drop("n_chars")


@query("SELECT n_name, r_name, CAST(coalesce(list_position(['EUROPE', 'ASIA', 'AFRICA'], r_name), 99) AS INT) AS place FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY place, r_name, n_name")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names in their order, all others behind by name."""
    listed = spark.createDataFrame([("EUROPE", 1), ("ASIA", 2), ("AFRICA", 3)], "r_name string, place int")
    n, r = roles.table(spark, sf_dir, "nation"), roles.table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(listed), "r_name", "left")
    return rows.select("n_name", "r_name", F.coalesce("place", F.lit(99)).alias("place")).orderBy("place", "r_name", "n_name")
