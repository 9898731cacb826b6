"""Corrections over all orders: line items read as mapped items, each order with three corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corrections as op
from ..sources import roles
from .base import query, with_

MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
SHEETS = ["COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN"]
NAMES = ["A_F", "N_F", "N_O", "R_F", "X_X"]
STATE = f"""items AS (SELECT l_orderkey AS job_id, l_orderkey % 50 AS entity_id, l_linenumber * 1000000000000000 + l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS seq, {MODES!r}[l_partkey % 7 + 1] AS label, CASE WHEN l_suppkey % 9 <> 0 THEN {SHEETS!r}[l_suppkey % 4 + 1] END AS sheet, CASE WHEN l_partkey % 10 <> 0 THEN l_returnflag || '_' || l_linestatus END AS canonical_name, CAST(50 + l_partkey % 50 AS DOUBLE) / 100 AS confidence FROM lineitem),
corrections AS (SELECT o_orderkey AS job_id, n, {MODES!r}[CASE WHEN n = 3 THEN (o_orderkey + 1) % 7 ELSE o_orderkey % 7 END + 1] AS label, {NAMES!r}[(o_orderkey * 3 + n) % 5 + 1] AS new_name, CASE WHEN (o_orderkey + n) % 3 = 0 THEN {SHEETS!r}[(o_orderkey + n) % 4 + 1] END AS sheet FROM orders, (SELECT unnest([1, 2, 3]) AS n)),
matched AS (SELECT i.*, n, new_name FROM items i JOIN corrections c ON i.job_id = c.job_id AND i.label = c.label AND (c.sheet IS NULL OR c.sheet = i.sheet)),
step AS (SELECT *, COALESCE(canonical_name, 'unmapped') AS first_name, COALESCE(LAG(new_name) OVER (PARTITION BY job_id, seq ORDER BY n), canonical_name, 'unmapped') AS old_name FROM matched),
history AS (SELECT job_id, entity_id, n, seq, label, sheet, old_name, new_name, CASE WHEN COALESCE(MAX((old_name <> new_name)::INT) OVER (PARTITION BY job_id, seq ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 1.0 ELSE confidence END::DOUBLE AS old_confidence FROM step),
changes AS (SELECT * FROM history WHERE old_name <> new_name)"""


def _pick(of: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_partkey") % 10 != 0, F.concat_ws("_", "l_returnflag", "l_linestatus"))
    return roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") % 50).alias("entity_id"), (F.col("l_linenumber") * 1000000000000000 + F.col("l_partkey") * 1000000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("seq"), _pick(MODES, F.col("l_partkey")).alias("label"), F.when(F.col("l_suppkey") % 9 != 0, _pick(SHEETS, F.col("l_suppkey"))).alias("sheet"), name.alias("canonical_name"), ((50 + F.col("l_partkey") % 50).cast("double") / 100).alias("confidence"))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    job, n = F.col("job_id"), F.col("n")
    rows = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    return rows.withColumns({"label": _pick(MODES, job + (n == 3).cast("int")), "new_name": _pick(NAMES, job * 3 + n), "sheet": F.when((job + n) % 3 == 0, _pick(SHEETS, job + n))})


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _items(spark, sf_dir), _corrections(spark, sf_dir)


@query(with_(STATE) + "SELECT job_id, n, seq, label, sheet, first_name AS old_name, new_name, confidence AS old_confidence FROM step WHERE first_name <> new_name")
def correction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13"""
    return op.preview(*_both(spark, sf_dir))


@query(with_(STATE) + "SELECT *, 1.0::DOUBLE AS new_confidence FROM changes")
def correction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of all orders."""
    return op.history(*_both(spark, sf_dir))


@query(with_(STATE) + "SELECT i.job_id, i.seq, COALESCE(c.new_name, i.canonical_name) AS canonical_name, CASE WHEN c.new_name IS NULL THEN confidence ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN c.new_name IS NOT NULL THEN 'user_correction' END AS method FROM items i LEFT JOIN (SELECT job_id, seq, arg_max(new_name, n) AS new_name FROM changes GROUP BY 1, 2) c USING (job_id, seq)")
def corrected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items afterwards."""
    return op.apply(*_both(spark, sf_dir)).select("job_id", "seq", "canonical_name", "confidence", "method")


@query(with_(STATE) + "SELECT job_id, n, label, 'not_found' AS why FROM corrections c WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.job_id = c.job_id AND m.n = c.n) UNION ALL SELECT job_id, n, label, 'no_change' FROM step WHERE old_name = new_name")
def correction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.warnings(*_both(spark, sf_dir))


@query(with_(STATE) + "SELECT c.* FROM corrections c JOIN (SELECT job_id FROM corrections c GROUP BY job_id HAVING bool_and(new_name <> 'X_X' AND EXISTS (SELECT 1 FROM matched m WHERE m.job_id = c.job_id AND m.n = c.n))) USING (job_id)")
def bulk_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X_X isn't a valid name."""
    names = spark.createDataFrame([(n,) for n in NAMES[:-1]], "canonical_name string")
    return op.bulk(*_both(spark, sf_dir), names).select("job_id", "n", "label", "new_name", "sheet")


#: Facts follow a change only if their name is the old one at that moment: one recursive step for each change of the label.
RELABEL = """, steps AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id, label ORDER BY n, seq) AS k FROM changes), walk AS (
 SELECT job_id, seq, label, canonical_name, confidence, CAST(NULL AS VARCHAR) AS method, 0::BIGINT AS k FROM items UNION ALL
 SELECT w.job_id, w.seq, w.label, CASE WHEN w.canonical_name = s.old_name THEN s.new_name ELSE w.canonical_name END, CASE WHEN w.canonical_name = s.old_name THEN 1.0::DOUBLE ELSE w.confidence END, CASE WHEN w.canonical_name = s.old_name THEN 'user_correction' ELSE w.method END, s.k FROM walk w JOIN steps s ON s.job_id = w.job_id AND s.label = w.label AND s.k = w.k + 1)
SELECT job_id, seq, arg_max(COALESCE(canonical_name, '?'), k) AS canonical_name, arg_max(confidence, k) AS confidence, arg_max(COALESCE(method, '?'), k) AS method FROM walk GROUP BY 1, 2"""


@query(with_(STATE).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + RELABEL)
def relabelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's fact after all changes of its label."""
    items, corrections = _both(spark, sf_dir)
    facts = op.relabel(items.withColumn("method", F.lit(None).cast("string")), op.history(items, corrections))
    return facts.select("job_id", "seq", F.coalesce("canonical_name", F.lit("?")).alias("canonical_name"), "confidence", F.coalesce("method", F.lit("?")).alias("method"))


PAST = ", past AS (SELECT *, job_id || '-' || n || '-' || seq AS id, (job_id + n) % 4 = 0 AS reverted FROM changes), asked AS (SELECT id FROM past WHERE (job_id + n) % 3 <> 0 UNION SELECT '?'), judged AS (SELECT a.id, p.job_id, label, sheet, old_name, old_confidence, CASE WHEN p.id IS NULL THEN 'not_found' WHEN reverted THEN 'already_reverted' WHEN EXISTS (SELECT 1 FROM past o WHERE o.job_id = p.job_id AND o.label = p.label AND o.sheet IS NOT DISTINCT FROM p.sheet AND NOT o.reverted AND o.id <> p.id) THEN 'other_active' ELSE 'undone' END AS outcome FROM asked a LEFT JOIN past p USING (id))\n"


def _undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = op.history(*_both(spark, sf_dir)).withColumns({"id": F.concat_ws("-", "job_id", "n", "seq"), "reverted": (F.col("job_id") + F.col("n")) % 4 == 0})
    return op.undo(past, past.where("(job_id + n) % 3 <> 0").select("id").unionByName(spark.range(1).select(F.lit("?").alias("id"))))


@query(with_(STATE).rstrip() + PAST + "SELECT id, outcome, job_id, label, sheet, CASE WHEN outcome = 'undone' THEN old_name END AS old_name, CASE WHEN outcome = 'undone' THEN old_confidence END AS old_confidence FROM judged")
def correction_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three changes are asked to be undone, a fourth of which was before."""
    return _undone(spark, sf_dir)


@query(with_(STATE).rstrip() + PAST + """SELECT i.job_id, i.seq, COALESCE(old_name, canonical_name) AS canonical_name, COALESCE(old_confidence, confidence) AS confidence FROM items i
LEFT JOIN (SELECT job_id, seq, arg_min(old_name, id) AS old_name, arg_min(old_confidence, id) AS old_confidence FROM (SELECT j.*, (SELECT MIN(seq) FROM items x WHERE x.job_id = j.job_id AND x.label = j.label AND (j.sheet IS NULL OR x.sheet = j.sheet)) AS seq FROM judged j WHERE outcome = 'undone') GROUP BY 1, 2) USING (job_id, seq)""")
def restored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.restore(_items(spark, sf_dir), _undone(spark, sf_dir)).select("job_id", "seq", "canonical_name", "confidence")


@query(with_(STATE) + "SELECT entity_id, label, first(new_name ORDER BY job_id, n, seq) AS canonical_name, 1.0::DOUBLE AS confidence, COUNT(*) AS count FROM changes GROUP BY 1, 2")
def correction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pattern_delta(op.history(*_both(spark, sf_dir)))


@query(with_(STATE) + "SELECT new_name AS canonical_name, label AS alias, COUNT(*) * 3 AS weight, array_to_string(list_sort(list(DISTINCT entity_id)), '|') AS entities FROM changes GROUP BY 1, 2")
def correction_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M08"""
    return op.alias_delta(op.history(*_both(spark, sf_dir))).withColumn("entities", F.array_join(F.transform("entities", lambda x: x.cast("string")), "|"))


@query(with_(STATE) + f"""SELECT s.text, status, CASE WHEN hit AND s.canonical_name IS NULL THEN name ELSE s.canonical_name END AS canonical_name, CASE WHEN hit AND s.canonical_name IS NULL THEN 'new_alias' ELSE 'new_item' END AS kind, 5 + CASE WHEN hit THEN n ELSE 0 END AS evidence, 1 + CASE WHEN hit THEN jobs ELSE 0 END AS n_jobs
FROM (SELECT *, status = 'pending' AND n IS NOT NULL AS hit FROM (SELECT m AS text, CASE WHEN i % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN i % 2 = 0 THEN 'N_O' END AS canonical_name FROM (SELECT unnest({MODES!r}) AS m, unnest([0, 1, 2, 3, 4, 5, 6]) AS i)) LEFT JOIN (SELECT label AS text, COUNT(*) AS n, COUNT(DISTINCT job_id) AS jobs, first(new_name ORDER BY job_id, n, seq) AS name FROM changes GROUP BY 1) USING (text)) s""")
def suggestion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M09"""
    rows = [(m, "accepted" if i % 3 == 0 else "pending", None if i % 2 else "N_O", "new_item", 5, [-1]) for i, m in enumerate(MODES)]
    state = spark.createDataFrame(rows, "text string, status string, canonical_name string, kind string, evidence long, jobs array<long>")
    return op.evidence(state, op.history(*_both(spark, sf_dir))).select("text", "status", "canonical_name", "kind", "evidence", F.size("jobs").alias("n_jobs"))
