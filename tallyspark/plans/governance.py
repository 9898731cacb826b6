"""State and change over the trade tables: labels, cells, patterns, suggestions, aliases, deprecations, rates, jobs, values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as op
from ..sources import roles
from .base import query

LABELS = """rows AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE '  ' || lower(o_orderpriority) END AS label, CASE WHEN o_custkey % 20 <> 0 THEN o_custkey % 20 END AS entity_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS sheet, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || o_orderstatus END AS hint, o_orderkey % 97 = 0 AS old FROM orders),
n AS (SELECT *, lower(trim(label)) AS label_normalized FROM rows)"""


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = roles.table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit("  "), F.lower("o_orderpriority"))).alias("label"), F.when(F.col("o_custkey") % 20 != 0, F.col("o_custkey") % 20).alias("entity_id"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("sheet"), F.when(k % 3 == 0, F.concat(F.lit("h"), F.col("o_orderstatus"))).alias("hint"), (k % 97 == 0).alias("old"),
    )
    none = spark.createDataFrame([], "label_normalized string, entity_id long, occurrences long, labels array<string>, sheets array<string>, hint string")
    return op.unmapped_labels(none, rows.where("old")), rows.where("not old")


@query("WITH " + LABELS + """ SELECT label_normalized, entity_id, COUNT(*) AS occurrences, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels, COALESCE(array_to_string(list_sort(list(DISTINCT sheet) FILTER (sheet IS NOT NULL)), '|'), '') AS sheets,
 CASE WHEN bool_or(old) THEN (SELECT hint FROM n m WHERE m.label_normalized = n.label_normalized AND m.entity_id IS NOT DISTINCT FROM n.entity_id AND m.old ORDER BY seq LIMIT 1) ELSE (SELECT hint FROM n m WHERE m.label_normalized = n.label_normalized AND m.entity_id IS NOT DISTINCT FROM n.entity_id ORDER BY seq LIMIT 1) END AS hint FROM n GROUP BY 1, 2""")
def unmapped_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of most orders come to a state made of the others."""
    return op.unmapped_labels(*_labels(spark, sf_dir)).withColumns({"labels": F.array_join("labels", "|"), "sheets": F.array_join("sheets", "|")})


#: Each order is an item with three cells; the third has the reference of the first.
CELLS = """items AS (SELECT o_custkey AS job_id, o_orderkey AS seq, o_orderpriority AS label, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS sheet, CASE WHEN o_orderkey % 4 = 0 THEN 'unmapped' WHEN o_orderkey % 4 <> 1 THEN 'c' || o_orderkey % 9 END AS canonical_name, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence FROM orders),
cells AS (SELECT i.*, pos, CASE WHEN pos = 1 THEN 'S' || seq % 3 ELSE sheet END AS own, CASE WHEN (seq + pos) % 11 = 0 THEN '?' || seq WHEN pos = 2 THEN 'a' || (seq % 30 + 1) ELSE chr(CAST(65 + seq % 26 AS INT)) || chr(CAST(65 + seq % 5 AS INT)) || (seq % 30 + 1) END AS ref, CASE WHEN pos > 0 THEN 'FY' || (1990 + seq % 10) END AS period, CASE WHEN seq % 7 = 0 THEN '=A1' END AS formula FROM items i, (SELECT unnest([0, 1, 2]) AS pos))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    row = s(k % 30 + 1)

    def cell(pos: int):
        ref = F.concat(F.lit("a"), row) if pos == 2 else F.concat(F.char(65 + k % 26), F.char(65 + k % 5), row)
        return F.struct(
            (F.concat(F.lit("S"), s(k % 3)) if pos == 1 else F.lit(None).cast("string")).alias("sheet"), F.when((k + pos) % 11 == 0, F.concat(F.lit("?"), s(k))).otherwise(ref).alias("cell_ref"),
            (F.concat(F.lit("FY"), s(1990 + k % 10)) if pos else F.lit(None).cast("string")).alias("period"), F.lit(None).cast("string").alias("raw"), F.when(k % 7 == 0, "=A1").alias("formula"),
        )

    name = F.when(k % 4 == 0, "unmapped").when(k % 4 != 1, F.concat(F.lit("c"), s(k % 9)))
    return roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), k.alias("seq"), F.col("o_orderpriority").alias("label"), F.when(k % 6 != 0, F.col("o_orderstatus")).alias("sheet"), name.alias("canonical_name"), ((k % 10).cast("double") / 10).alias("confidence"), F.array(cell(0), cell(1), cell(2)).alias("cells"))


@query("WITH " + CELLS + """, first AS (SELECT * FROM cells WHERE own IS NOT NULL AND ref IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id, own, ref ORDER BY seq, pos) = 1), good AS (SELECT *, upper(ref) AS cell, canonical_name IS NOT NULL AND canonical_name <> 'unmapped' AS mapped FROM first WHERE regexp_full_match(upper(ref), '[A-Z]+[0-9]+')),
facts AS (SELECT o_custkey AS job_id, o_orderstatus AS sheet, 'A' || (o_orderkey % 30 + 1) AS cell, MAX(o_orderkey) AS fact FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT g.job_id, own AS sheet, g.cell AS cell_ref, CAST(regexp_extract(g.cell, '[0-9]+') AS INT) AS row_index, CAST(CASE WHEN length(regexp_extract(g.cell, '[A-Z]+')) = 1 THEN ascii(g.cell) - 65 ELSE (ascii(g.cell) - 64) * 26 + ascii(substr(g.cell, 2)) - 65 END AS INT) AS col_index,
 CASE WHEN period IS NOT NULL THEN 'value' ELSE 'label' END AS role, CASE WHEN mapped THEN canonical_name END AS canonical_name, label, period, CASE WHEN mapped THEN 'mapped' ELSE 'unmapped' END AS status, CASE WHEN mapped THEN confidence END AS confidence, formula IS NOT NULL AS has_formula, CASE WHEN period IS NOT NULL THEN fact END AS fact_id
FROM good g LEFT JOIN facts f ON f.job_id = g.job_id AND f.sheet = g.own AND f.cell = g.cell""")
def cell_mapping_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M03"""
    facts = roles.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("sheet"), F.concat(F.lit("a"), (F.col("o_orderkey") % 30 + 1).cast("string")).alias("cell_ref"))
    return op.cell_mappings(_cells(spark, sf_dir), facts)


MAPPINGS = "SELECT l_suppkey AS entity_id, CASE WHEN l_partkey % 13 <> 0 THEN 'label ' || l_partkey % 20 ELSE '' END AS label, CASE WHEN l_linenumber % 5 = 0 THEN 'unmapped' ELSE 'c' || l_partkey % 7 END AS canonical_name, CAST(60 + l_partkey % 40 AS DOUBLE) / 100 AS confidence, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey + 1 AS seq FROM lineitem"


@query(f"WITH m AS ({MAPPINGS}), s AS (SELECT entity_id, label, canonical_name, confidence, seq FROM m WHERE confidence >= 0.8 AND canonical_name <> 'unmapped' AND label <> '' AND canonical_name <> 'c6' UNION ALL SELECT DISTINCT entity_id, 'label 3', 'c1', 0.9::DOUBLE, 0 FROM m) SELECT entity_id, label, first(canonical_name ORDER BY confidence DESC, seq) AS canonical_name, MAX(confidence) AS confidence, CAST(COUNT(*) AS BIGINT) AS occurrences FROM s GROUP BY 1, 2")
def bulk_pattern_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as mappings; c6 isn't a known name."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    rows = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.when(k % 13 != 0, F.concat(F.lit("label "), (k % 20).cast("string"))).otherwise("").alias("label"), F.when(n % 5 == 0, "unmapped").otherwise(F.concat(F.lit("c"), (k % 7).cast("string"))).alias("canonical_name"),
        ((60 + k % 40).cast("double") / 100).alias("confidence"), (F.col("l_orderkey") * 1000000 + n * 100000 + k + 1).alias("seq"),
    )
    state = rows.select("entity_id").distinct().select("entity_id", F.lit("label 3").alias("label"), F.lit("c1").alias("canonical_name"), F.lit(0.9).alias("confidence"), F.lit(1).cast("long").alias("count"))
    return op.bulk_patterns(state, rows, spark.createDataFrame([(f"c{i}",) for i in range(6)], "canonical_name string"))


TAXONOMY = "taxonomy AS (SELECT p_name AS canonical_name, p_name = 'none' AS none, list_sort(list(DISTINCT p_brand)) AS aliases, MIN(p_partkey) % 9 = 0 AS deprecated, MIN(p_type) AS category FROM part GROUP BY 1, 2)"
ASKED = "asked AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'nothing' ELSE p_name END AS canonical_name, CASE WHEN o_orderkey % 40 = 3 THEN '' WHEN o_orderkey % 3 = 0 THEN upper(p_brand) ELSE 'alias ' || o_orderkey % 25 END AS alias FROM orders JOIN part ON p_partkey = o_orderkey % 200)"


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = roles.table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("canonical_name")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"), (F.min("p_partkey") % 9 == 0).alias("deprecated"), F.min("p_type").alias("category"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = roles.table(spark, sf_dir, "orders").withColumn("p_partkey", k % 200).join(roles.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    alias = F.when(k % 40 == 3, "").when(k % 3 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit("alias "), (k % 25).cast("string")))
    return rows.select(k.alias("id"), F.when(k % 50 == 0, "nothing").otherwise(F.col("p_name")).alias("canonical_name"), alias.alias("alias"))


#: Decisions on the aliases as suggestions: two for some, some on what isn't there.
DECIDED = "suggestions AS (SELECT id, canonical_name, alias AS text, CASE WHEN id % 4 = 0 THEN 'new_item' ELSE 'new_alias' END AS kind, CASE WHEN id % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM asked), decisions AS (SELECT id + 7 AS id, n, (id + n) % 3 <> 0 AS accept FROM asked, (SELECT unnest([1, 2]) AS n) WHERE (id + n) % 2 = 0 OR id % 10 = 1), one AS (SELECT id, arg_min(accept, n) AS accept FROM decisions GROUP BY 1), resolved AS (SELECT o.id, kind, canonical_name, text, CASE WHEN s.id IS NULL THEN 'failed' WHEN status <> 'pending' THEN 'already_resolved' WHEN accept THEN 'accepted' ELSE 'rejected' END AS outcome FROM one o LEFT JOIN suggestions s USING (id))"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, k = _asked(spark, sf_dir), F.col("id")
    suggestions = asked.select("id", "canonical_name", F.col("alias").alias("text"), F.when(k % 4 == 0, "new_item").otherwise("new_alias").alias("kind"), F.when(k % 5 == 0, "rejected").otherwise("pending").alias("status"))
    decisions = asked.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where("(id + n) % 2 = 0 or id % 10 = 1").select((k + 7).alias("id"), "n", ((k + F.col("n")) % 3 != 0).alias("accept"))
    return op.resolve_suggestions(suggestions, decisions)


@query(f"WITH {ASKED}, {DECIDED} SELECT * FROM resolved")
def suggestion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18"""
    return _resolved(spark, sf_dir)


@query(f"WITH {TAXONOMY}, {ASKED}, {DECIDED}, new AS (SELECT canonical_name, list_sort(list(DISTINCT text)) AS texts FROM resolved WHERE outcome = 'accepted' AND kind = 'new_alias' AND canonical_name IS NOT NULL GROUP BY 1) SELECT canonical_name, array_to_string(list_concat(aliases, list_filter(COALESCE(texts, []), lambda x: NOT list_contains(aliases, x))), '|') AS aliases FROM taxonomy LEFT JOIN new USING (canonical_name)")
def accepted_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18/M21"""
    return op.accepted_aliases(_taxonomy(spark, sf_dir), _resolved(spark, sf_dir)).select("canonical_name", F.array_join("aliases", "|").alias("aliases"))


ADDED = f"WITH {TAXONOMY}, {ASKED}, added AS (SELECT id AS n, a.canonical_name, alias, aliases, CASE WHEN alias = '' THEN 'missing field' WHEN aliases IS NULL THEN 'item not found' WHEN list_contains(list_transform(aliases, lambda x: lower(x)), lower(alias)) OR EXISTS (SELECT 1 FROM asked b WHERE b.canonical_name = a.canonical_name AND lower(b.alias) = lower(a.alias) AND b.id < a.id) THEN 'duplicate' ELSE 'added' END AS outcome FROM asked a LEFT JOIN taxonomy USING (canonical_name))"


@query(ADDED + " SELECT n, canonical_name, alias, outcome FROM added")
def bulk_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19"""
    return op.add_aliases(_taxonomy(spark, sf_dir), _asked(spark, sf_dir).withColumnRenamed("id", "n"))


@query(ADDED + ", g AS (SELECT n, canonical_name, aliases, list(alias) OVER (PARTITION BY canonical_name ORDER BY n) AS upto FROM added WHERE outcome = 'added') SELECT n, canonical_name, 'aliases' AS field, array_to_string(list_concat(aliases, upto[:-2]), '|') AS old_value, array_to_string(list_concat(aliases, upto), '|') AS new_value FROM g")
def alias_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxonomy = _taxonomy(spark, sf_dir)
    return op.alias_changes(taxonomy, op.add_aliases(taxonomy, _asked(spark, sf_dir).withColumnRenamed("id", "n")))


REDIRECTS = f"WITH {TAXONOMY}, requests AS (SELECT DISTINCT p_name AS canonical_name, CASE WHEN p_partkey % 4 = 0 THEN 'nothing' WHEN p_partkey % 4 <> 1 THEN first(p_name) OVER (ORDER BY p_partkey ROWS BETWEEN 7 PRECEDING AND 7 PRECEDING) END AS redirect FROM part UNION SELECT 'unknown', NULL), judged AS (SELECT r.canonical_name, r.redirect, CASE WHEN i.canonical_name IS NULL THEN 'item_not_found' WHEN r.redirect IS NOT NULL AND t.canonical_name IS NULL THEN 'target_not_found' WHEN r.redirect IS NOT NULL AND t.deprecated THEN 'target_deprecated' ELSE 'deprecated' END AS outcome FROM requests r LEFT JOIN taxonomy i ON i.canonical_name = r.canonical_name LEFT JOIN taxonomy t ON t.canonical_name = r.redirect)"


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = roles.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    before = part.select((F.col("p_partkey") + 7).alias("p_partkey"), F.col("p_name").alias("before"))
    k = F.col("p_partkey") % 4
    rows = part.join(before, "p_partkey", "left").select(F.col("p_name").alias("canonical_name"), F.when(k == 0, "nothing").when(k != 1, F.col("before")).alias("redirect")).distinct()
    unknown = spark.range(1).select(F.lit("unknown").alias("canonical_name"), F.lit(None).cast("string").alias("redirect"))
    return op.deprecate(_taxonomy(spark, sf_dir), rows.unionByName(unknown))


@query(REDIRECTS + " SELECT * FROM judged")
def deprecations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20"""
    return _redirects(spark, sf_dir)


@query(REDIRECTS + " SELECT canonical_name, 'deprecated' AS field, 'false' AS old_value, 'true' AS new_value FROM judged WHERE outcome = 'deprecated' UNION ALL SELECT canonical_name, 'deprecated_redirect', NULL, redirect FROM judged WHERE outcome = 'deprecated' AND redirect IS NOT NULL")
def taxonomy_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.taxonomy_changes(_redirects(spark, sf_dir))


@query(f"""WITH {TAXONOMY}, items AS (SELECT category, sha256(category || chr(9) || canonical_name || chr(9) || array_to_string(aliases, '|')) AS h FROM taxonomy), by_category AS (SELECT category, COUNT(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM items GROUP BY 1)
SELECT CAST(SUM(n) AS BIGINT) AS items, sha256(string_agg(h, '' ORDER BY category)) AS checksum, string_agg(category || ':' || n, '|' ORDER BY category) AS categories FROM by_category""")
def taxonomy_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M23"""
    return op.taxonomy_version(_taxonomy(spark, sf_dir))


@query("WITH r AS (SELECT event_type AS base, 'USD' AS quote, CAST(ts AS DATE) AS date, value AS rate, ts AS fetched_at FROM events) SELECT base, quote, date, arg_max(rate, (fetched_at, rate)) AS rate, MAX(fetched_at) AS fetched_at FROM r GROUP BY 1, 2, 3")
def rate_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are the state, odd ones come to it."""
    e = roles.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("base"), F.lit("USD").alias("quote"), F.to_date("ts").alias("date"), F.col("value").alias("rate"), F.col("ts").alias("fetched_at"), (F.col("event_id") % 2 == 0).alias("old"))
    return op.cache_rates(rows.where("old").drop("old"), rows.where("not old").drop("old"))


@query("WITH e AS (SELECT user_id AS job_id, ts AS w, event_id AS n, ['pending', 'processing', 'completed', 'failed'][event_id % 4 + 1] AS status, CAST(event_id % 101 AS INT) AS progress, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS gate_passed FROM events) SELECT job_id, arg_max(CASE WHEN status = 'completed' AND NOT COALESCE(gate_passed, TRUE) THEN 'needs_review' ELSE status END, (w, n)) AS status, MAX(progress) AS progress, MAX(w) AS updated_at, COUNT(*) AS events FROM e GROUP BY 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15"""
    return op.job_states(_job_events(spark, sf_dir))


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (k % 4 + 1).cast("int"))
    return roles.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), k.alias("n"), status.alias("status"), (k % 101).cast("int").alias("progress"), F.when(k % 3 != 0, k % 2 == 0).alias("gate_passed"))


#: Each user's day as a job, walked event by event.
WALK = """WITH RECURSIVE e AS (SELECT user_id * 1000 + dayofyear(ts) AS job_id, ts AS at_, event_id AS n, ['pending', 'processing', CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 1 THEN 'needs_review' ELSE 'completed' END, 'failed'][event_id % 7 % 4 + 1] AS status,
 ROW_NUMBER() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts, event_id) AS i FROM events),
walk(job_id, i, at_, n, before, status, accepted, state) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT), '', '', FALSE, 'pending' FROM e UNION ALL
 SELECT e.job_id, e.i, e.at_, e.n, state, e.status, e.status = state OR COALESCE(list_contains(f, e.status), FALSE), CASE WHEN COALESCE(list_contains(f, e.status), FALSE) THEN e.status ELSE state END
 FROM (SELECT *, CASE state WHEN 'pending' THEN ['processing', 'failed'] WHEN 'processing' THEN ['completed', 'failed', 'needs_review'] WHEN 'needs_review' THEN ['completed', 'failed'] END AS f FROM walk) w JOIN e ON e.job_id = w.job_id AND e.i = w.i + 1)"""


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (k % 7 % 4 + 1).cast("int"))
    events = roles.table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("job_id"), F.col("ts").alias("at"), k.alias("n"), status.alias("status"), F.when(k % 3 != 0, k % 2 == 0).alias("gate_passed"))
    return op.job_transitions(events)


@query(WALK + " SELECT job_id, at_ AS at, n, before, status, accepted FROM walk WHERE i > 0")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the state it met and whether it could follow."""
    return _transitions(spark, sf_dir)


@query(WALK + " SELECT job_id, COALESCE(arg_max(status, (at_, n)) FILTER (accepted), 'pending') AS status, MAX(at_) FILTER (accepted) AS updated_at, COUNT(*) FILTER (accepted) AS accepted, COUNT(*) FILTER (NOT accepted) AS refused FROM walk WHERE i > 0 GROUP BY 1")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where jobs end, and how many events were refused."""
    return op.job_outcomes(_transitions(spark, sf_dir))


@query("WITH f AS (SELECT o_orderkey AS fact_id, o_custkey AS job_id, 'FY' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS period, CASE WHEN o_orderkey % 3 = 0 THEN 'FY' || year(o_orderdate) END AS normalized FROM orders), k AS (SELECT job_id, period, MIN(normalized) AS n FROM f WHERE normalized IS NOT NULL GROUP BY 1, 2) SELECT fact_id, f.job_id, f.period, COALESCE(normalized, n) AS normalized FROM f LEFT JOIN k ON k.job_id = f.job_id AND k.period = f.period")
def period_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the facts know their period; the others of their job learn it."""
    o, y = roles.table(spark, sf_dir, "orders"), F.year("o_orderdate").cast("string")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("job_id"), F.concat(F.lit("FY"), F.right(y, F.lit(2))).alias("period"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("FY"), y)).alias("normalized"))
    return op.backfill_periods(facts, facts.where("normalized is not null"))


@query("WITH a AS (SELECT o_custkey % 30 AS entity_id, o_orderpriority AS label, 'c' || o_orderkey % 7 AS canonical_name, o_orderkey AS n FROM orders), p AS (SELECT DISTINCT entity_id, label, 'known' AS canonical_name FROM a WHERE entity_id % 3 = 0 AND label < '3') SELECT entity_id, label, canonical_name, 0.9::DOUBLE AS confidence, 4::BIGINT AS count FROM p UNION ALL SELECT entity_id, label, arg_min(canonical_name, n), 0.85::DOUBLE, 1 FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.entity_id = a.entity_id AND p.label = a.label) GROUP BY 1, 2")
def accepted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M30"""
    a = roles.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("entity_id"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("c"), (F.col("o_orderkey") % 7).cast("string")).alias("canonical_name"), F.col("o_orderkey").alias("n"))
    p = a.where("entity_id % 3 = 0 and label < '3'").select("entity_id", "label").distinct().select("entity_id", "label", F.lit("known").alias("canonical_name"), F.lit(0.9).alias("confidence"), F.lit(4).cast("long").alias("count"))
    return op.accept_label(p, a)


@query("WITH l AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 11 = 0 THEN ts END AS replayed_at FROM events WHERE event_type = 'error'), r AS (SELECT event_id - event_id % 3 AS id, MIN(ts) AS w FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT l.id, user_id, COALESCE(replayed_at, w) AS replayed_at FROM l LEFT JOIN r USING (id) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 500 = 1)")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M27/ST5: error events are letters, other events replays; the letters of some users are deleted."""
    e = roles.table(spark, sf_dir, "events")
    letters = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_id") % 11 == 0, F.col("ts")).alias("replayed_at"))
    replays = e.where("event_type <> 'error'").select((F.col("event_id") - F.col("event_id") % 3).alias("id"), F.col("ts").alias("at"))
    return op.without(op.replay(letters, replays), e.where("event_id % 500 = 1"), ["user_id"])


@query("WITH c AS (SELECT o_custkey AS entity_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'name ' || o_orderkey END AS name, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS industry, o_orderkey AS n FROM orders), n AS (SELECT entity_id, arg_max(name, n) AS name, arg_max(industry, n) AS industry FROM c GROUP BY 1), s AS (SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS industry FROM customer) SELECT COALESCE(s.entity_id, n.entity_id) AS entity_id, COALESCE(n.name, s.name) AS name, COALESCE(n.industry, s.industry) AS industry FROM s FULL JOIN n ON n.entity_id = s.entity_id")
def entity_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M28"""
    k = F.col("o_orderkey")
    changes = roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.when(k % 3 != 0, F.concat(F.lit("name "), k.cast("string"))).alias("name"), F.when(k % 4 == 0, F.col("o_orderpriority")).alias("industry"), k.alias("n"))
    return op.entities(roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry")), changes)


@query("""WITH c AS (SELECT l_suppkey AS key, CASE WHEN l_linenumber % 6 = 5 THEN 'unmapped' ELSE l_returnflag END AS canonical_name, year(l_shipdate) AS period, CAST(CASE WHEN l_partkey % 3 = 0 THEN l_quantity ELSE 7 END AS DECIMAL(12,2)) * CASE WHEN l_partkey % 4 = 0 THEN 1000 ELSE 1 END AS value, 'sheet ' || l_partkey % 4 AS sheet, l_partkey % 5 AS tier, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq FROM lineitem),
r AS (SELECT *, first(value) OVER (PARTITION BY key, canonical_name, period ORDER BY seq) AS f FROM c WHERE tier <= 3 AND canonical_name <> 'unmapped'), g AS (SELECT *, abs(value - f) > 0.01 AND CAST(abs(value - f) AS DOUBLE) / CAST(greatest(abs(f), 1) AS DOUBLE) > 0.001 AS apart FROM r)
SELECT key, canonical_name, period, CAST(CASE WHEN bool_or(apart) THEN arg_min(value, (tier, seq)) ELSE arg_min(value, seq) END AS DECIMAL(28,4)) AS value, CASE WHEN bool_or(apart) THEN arg_min(sheet, (tier, seq)) ELSE arg_min(sheet, seq) END AS sheet, COUNT(*) AS candidates, bool_or(apart) AS is_conflict FROM g GROUP BY 1, 2, 3""")
def extracted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: line items as candidates on sheets of five tiers, one of four of them in thousands."""
    k = F.col("l_partkey")
    rows = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.when(F.col("l_linenumber") % 6 == 5, "unmapped").otherwise(F.col("l_returnflag")).alias("canonical_name"), F.year("l_shipdate").alias("period"), F.when(k % 3 == 0, F.col("l_quantity")).otherwise(7).cast("decimal(12,2)").alias("value"),
        F.when(k % 4 == 0, F.lit(1000).cast("decimal(10,0)")).alias("unit"), F.concat(F.lit("sheet "), (k % 4).cast("string")).alias("sheet"), (k % 5).alias("tier"), (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + k).alias("seq"),
    )
    return op.extracted_values(rows)


RUNS = "SELECT c_custkey AS fixture, 'v' || CASE WHEN {} THEN 1 ELSE 2 END AS version, m AS metric, CASE WHEN (c_custkey + i) % 13 <> 0 THEN CAST((c_custkey * 7 + i * 3) % 50 + 50 AS DOUBLE) / 100 + {} END AS value FROM customer, (SELECT unnest(['mapping', 'triage', 'f1', 'recall']) AS m, unnest([0, 1, 2, 3]) AS i)"


def _runs(spark: SparkSession, sf_dir: str, version, shift) -> DataFrame:
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("i")) for i, m in enumerate(("mapping", "triage", "f1", "recall"))])
    rows = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fixture"), F.inline(metrics))
    k = F.col("fixture")
    value = F.when((k + F.col("i")) % 13 != 0, ((k * 7 + F.col("i") * 3) % 50 + 50).cast("double") / 100 + shift)
    return rows.select("fixture", F.concat(F.lit("v"), F.when(version, "1").otherwise("2")).alias("version"), "metric", value.alias("value"))


@query(f"""WITH b AS ({RUNS.format('TRUE', '0.0::DOUBLE')}), c AS ({RUNS.format('c_custkey % 3 = 0', '((c_custkey + i) % 9 - 6)::DOUBLE / 100')}), t AS (SELECT c.fixture, c.metric, CAST(ROUND(CAST(c.value - b.value AS DECIMAL(20,10)), 6) AS DOUBLE) AS delta, c.version <> b.version AS changed,
 COALESCE(CASE WHEN c.fixture % 5 = 0 AND c.metric = 'mapping' THEN 0.03 END, CASE c.metric WHEN 'mapping' THEN 0.02 WHEN 'triage' THEN 0.0 WHEN 'f1' THEN 0.02 ELSE 0.03 END)::DOUBLE AS usual, CASE c.metric WHEN 'triage' THEN 0.02 ELSE 0.05 END::DOUBLE AS looser FROM c JOIN b USING (fixture, metric) WHERE c.value IS NOT NULL AND b.value IS NOT NULL)
SELECT fixture, metric, delta, CASE WHEN changed THEN greatest(usual, looser) ELSE usual END AS threshold, delta < -CASE WHEN changed THEN greatest(usual, looser) ELSE usual END AS failed FROM t""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: four metrics of each customer as a fixture."""
    k = F.col("fixture")
    base = _runs(spark, sf_dir, F.lit(True), F.lit(0.0))
    now = _runs(spark, sf_dir, k % 3 == 0, ((k + F.col("i")) % 9 - 6).cast("double") / 100)
    own = base.where("metric = 'mapping' and fixture % 5 = 0").select("fixture", "metric", F.lit(0.03).alias("threshold"))
    return op.regression_gate(base, now, own)
