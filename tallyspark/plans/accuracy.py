"""Accuracy of mapped labels: suppliers' line items as expected rows, those of two return flags as what a run and the run before mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy as op
from ..sources import roles
from .base import query

#: Columns over line items, the same text for both engines.
SHEET = """CASE l_linenumber WHEN 1 THEN 'Income Statement' WHEN 2 THEN 'P&L 2' WHEN 3 THEN 'Balance Sheet' WHEN 4 THEN 'Cash and Debt' WHEN 5 THEN 'Working Capital' WHEN 6 THEN 'Assumptions'
 ELSE CASE WHEN l_partkey % 5 > 0 THEN 'Summary' END END"""
EXPECTED = {"file": "l_suppkey", "n": "l_orderkey * 10 + l_linenumber", "sheet": SHEET, "label": "CASE WHEN l_linenumber = 2 THEN '  ' ELSE '' END || 'line ' || l_partkey", "canonical_name": "'name ' || (l_partkey % 13)"}
ITEMS = {
    "file": "l_suppkey", "n": "l_orderkey * 10 + l_linenumber", "label": "CASE WHEN l_linenumber = 3 THEN '  ' WHEN l_quantity = 7 THEN NULL ELSE '' END || CASE WHEN l_quantity = 8 THEN '' ELSE 'line ' || l_partkey END",
    "canonical_name": "CASE l_linenumber WHEN 4 THEN NULL WHEN 5 THEN 'unmapped' WHEN 6 THEN 'name ' || ((l_partkey + 1) % 13) ELSE 'name ' || (l_partkey % 13) END",
    "stage": "CASE WHEN l_quantity < 10 THEN 'enhanced_mapping' WHEN l_quantity < 20 THEN 'stage_4_retry' WHEN l_quantity < 45 THEN 'mapping' END",
}
NOW, BEFORE = "l_returnflag <> 'R'", "l_returnflag <> 'N' AND l_suppkey % 7 <> 3"
TRIAGE = {"expected": "1 + (file + length(sheet)) % 4", "first": "1 + (file * 3 + length(sheet)) % 4", "last": "CASE WHEN length(sheet) % 3 > 0 THEN 1 + (file + length(sheet) * 5) % 4 END"}
#: What a file's run measured beside accuracies; null: not at all.
RUN = {"quality_score": "CASE WHEN file % 4 <> {0} THEN (file * {1} % 100) / 100e0 END", "completeness_score": "(file * {1} % 77) / 77e0", "duration": "(file * {1} % 5) * 15e-1", "tokens": "CASE WHEN file % 6 <> {0} THEN file * {1} % 1000 END"}


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in of.items())


def _judged(name: str, items: str, pick: str, trim: bool = False) -> str:
    label = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')" if trim else "{0}"
    return f"""{name}_one AS (SELECT file, {label.format("label")} AS label, {pick}(canonical_name, (n, canonical_name, stage)) AS actual, {pick}(stage, (n, canonical_name, stage)) AS stage FROM (SELECT file, n, label, COALESCE(canonical_name, 'unmapped') AS canonical_name, COALESCE(stage, '') AS stage FROM {items}) WHERE {label.format("label")} <> '' GROUP BY 1, 2),
{name} AS (SELECT *, CASE WHEN actual IS NULL THEN 'missing' WHEN actual = 'unmapped' THEN 'unmapped' WHEN fine THEN 'correct' ELSE 'mismatch' END AS outcome FROM (
 SELECT e.file, e.n, COALESCE(sheet, 'Unknown') AS sheet, o.label AS found, {label.format("e.label")} AS label, e.canonical_name AS expected, actual, stage,
  CASE WHEN EXISTS (SELECT 1 FROM alternatives a WHERE a.canonical_name = e.canonical_name) THEN EXISTS (SELECT 1 FROM alternatives a WHERE a.canonical_name = e.canonical_name AND acceptable = actual) ELSE COALESCE(actual = e.canonical_name, FALSE) END AS fine
 FROM expected e LEFT JOIN {name}_one o ON o.file = e.file AND o.label = {label.format("e.label")}))"""


BASE = f"""WITH expected AS (SELECT {_columns(EXPECTED)} FROM lineitem), now_items AS (SELECT {_columns(ITEMS)} FROM lineitem WHERE {NOW}), before_items AS (SELECT {_columns(ITEMS)} FROM lineitem WHERE {BEFORE}),
alternatives AS (SELECT DISTINCT 'name ' || (p_partkey % 13) AS canonical_name, 'name ' || ((p_partkey + k) % 13) AS acceptable FROM part, (VALUES (0), (1)) v(k) WHERE p_partkey % 13 BETWEEN 2 AND 4 AND (k = 1 OR p_partkey % 13 <> 4)),
sheets AS (SELECT DISTINCT file, sheet FROM expected WHERE sheet IS NOT NULL), wanted AS (SELECT file, sheet, {TRIAGE["expected"]} AS tier FROM sheets),
triaged AS (SELECT file, sheet, COALESCE({TRIAGE["last"]}, 0) AS tier FROM sheets WHERE (file + length(sheet)) % 5 = 0 UNION ALL SELECT file, sheet, {TRIAGE["first"]} FROM sheets WHERE (file + length(sheet)) % 5 > 1),
"""  # fmt: skip


def _share(top: str, bottom: str, scale: int = 4) -> str:
    return f"COALESCE(CAST(ROUND(CAST(CAST({top} AS DOUBLE) / NULLIF({bottom}, 0) AS DECIMAL(30,10)), {scale}) AS DOUBLE), 0.0)"


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in EXPECTED.items()])


def _items(spark: SparkSession, sf_dir: str, which: str = NOW) -> DataFrame:
    return roles.table(spark, sf_dir, "lineitem").where(which).selectExpr(*[f"{v} AS {k}" for k, v in ITEMS.items()])


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = roles.table(spark, sf_dir, "part").select((F.col("p_partkey") % 13).alias("i")).where("i between 2 and 4").distinct()
    return parts.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("k = 1 or i <> 4").selectExpr("'name ' || i AS canonical_name", "'name ' || ((i + k) % 13) AS acceptable")


def _triage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tiers as expected and as found: a fifth of the sheets has none, another fifth two, of which the last counts."""
    sheets = _expected(spark, sf_dir).select("file", "sheet").where("sheet is not null").distinct()
    found = sheets.selectExpr("file", "sheet", "(file + length(sheet)) % 5 AS m", f"{TRIAGE['first']} AS _first", f"{TRIAGE['last']} AS _last")
    found = found.where("m <> 1").select("file", "sheet", F.inline(F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("tier"), F.lit(n == 1).alias("again"), "m") for n, c in enumerate(("_first", "_last"))]), lambda x: ~x["again"] | (x["m"] == 0))))
    return sheets.selectExpr("file", "0 AS n", "sheet", f"{TRIAGE['expected']} AS tier"), found.select("file", "n", "sheet", "tier")


COUNTS = "COUNT(*) AS total, COUNT(*) FILTER (outcome = 'correct') AS tp, COUNT(*) FILTER (outcome = 'mismatch') AS fp, COUNT(*) FILTER (outcome <> 'correct') AS fn, COUNT(*) FILTER (outcome IN ('missing', 'unmapped')) AS unmapped"


@query(BASE + _judged("j", "now_items", "arg_min") + f""", c AS (SELECT *, CASE WHEN sheet IN ('Income Statement', 'P&L 2') THEN 'income_statement' WHEN sheet = 'Balance Sheet' THEN 'balance_sheet' WHEN sheet = 'Cash and Debt' THEN 'cash_flow' WHEN sheet = 'Working Capital' THEN 'working_capital' WHEN sheet = 'Assumptions' THEN 'assumptions' ELSE 'other' END AS category FROM j),
l AS (SELECT file, 'file' AS level, NULL AS name, {COUNTS} FROM c GROUP BY 1 UNION ALL SELECT file, 'sheet', sheet, {COUNTS} FROM c GROUP BY 1, 3 UNION ALL SELECT file, 'category', category, {COUNTS} FROM c GROUP BY 1, 3),
m AS (SELECT *, {_share("tp", "tp + fp")} AS precision, {_share("tp", "tp + fn")} AS recall, {_share("tp", "total")} AS accuracy FROM l)
SELECT *, CASE WHEN level = 'sheet' THEN {_share("2 * precision * recall", "(precision + recall)")} ELSE {_share("2 * tp", "(2 * tp + fp + fn)")} END AS f1 FROM m""")
def mapping_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file, sheet and category."""
    return op.by_level(op.judged(_expected(spark, sf_dir), _items(spark, sf_dir), _alternatives(spark, sf_dir)))


@query(BASE + "x AS (SELECT 1) SELECT file, COUNT(*) AS total, COUNT(*) FILTER (t.tier = w.tier) AS correct, " + _share("COUNT(*) FILTER (t.tier = w.tier)", "COUNT(*)") + " AS accuracy FROM wanted w LEFT JOIN triaged t USING (file, sheet) GROUP BY 1")
def triage_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: tiers of sheets."""
    return op.triage_accuracy(*_triage(spark, sf_dir))


ATTRIBUTED = BASE + _judged("j", "now_items", "arg_max") + f""", a AS (SELECT file, n, sheet, label, expected, actual, CASE WHEN fine THEN NULL WHEN found IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM triaged t WHERE t.file = j.file AND t.sheet = j.sheet AND t.tier >= {op.SKIPPED})
 AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.file = j.file AND w.sheet = j.sheet AND w.tier >= {op.SKIPPED}) THEN 'triage' ELSE 'parsing' END WHEN actual = 'unmapped' THEN 'mapping' WHEN regexp_matches(stage, 'enhanced|stage_4') THEN 'enhanced_mapping' ELSE 'mapping' END AS cause FROM j)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.attributed(_expected(spark, sf_dir), _items(spark, sf_dir), _alternatives(spark, sf_dir), *_triage(spark, sf_dir))


@query(ATTRIBUTED + " SELECT * FROM a WHERE cause IS NOT NULL")
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: every error with its cause."""
    return _attributed(spark, sf_dir).where("cause is not null")


CAUSED = "COUNT(cause) AS errors, " + ", ".join(f"COUNT(*) FILTER (cause = '{c}') AS {c}" for c in op.CAUSES) + ", " + ", ".join(f"{_share(f'100 * COUNT(*) FILTER (cause = {chr(39)}{c}{chr(39)})', 'COUNT(cause)', 1)} AS {c}_pct" for c in op.CAUSES)


@query(ATTRIBUTED + f" SELECT file, NULL AS sheet, {CAUSED} FROM a GROUP BY 1 UNION ALL SELECT file, sheet, {CAUSED} FROM a GROUP BY 1, 2")
def error_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: errors by cause, of files and their sheets."""
    return op.causes(_attributed(spark, sf_dir))


STATED = f"COUNT(*) AS total, COUNT(*) FILTER (outcome = 'correct') AS correct, COUNT(*) FILTER (outcome IN ('missing', 'unmapped')) AS unmapped, {_share(*['COUNT(*) FILTER (outcome = ' + chr(39) + 'correct' + chr(39) + ')', 'COUNT(*)'])} AS accuracy, " + _share("COUNT(*) FILTER (outcome = 'correct')", "COUNT(*) FILTER (outcome IN ('correct', 'mismatch'))") + " AS accuracy_of_matched"


@query(BASE + _judged("j", "now_items", "arg_min", True) + f" SELECT file, NULL AS sheet, {STATED} FROM j GROUP BY 1 UNION ALL SELECT file, sheet, {STATED} FROM j GROUP BY 1, 2")
def statement_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without the blanks of their indentation."""
    return op.by_statement(_trimmed(spark, sf_dir))


def _trimmed(spark: SparkSession, sf_dir: str, which: str = NOW) -> DataFrame:
    return op.judged(_expected(spark, sf_dir), _items(spark, sf_dir, which), _alternatives(spark, sf_dir), trim=True)


BOTH = BASE + _judged("j", "now_items", "arg_min", True) + ", " + _judged("b_all", "before_items", "arg_min", True) + ", b AS (SELECT * FROM b_all WHERE file % 7 <> 3)"


@query(BOTH + """, n AS (SELECT DISTINCT file, label FROM j WHERE outcome = 'mismatch'), o AS (SELECT DISTINCT file, label FROM b WHERE outcome = 'mismatch')
SELECT *, 'new' AS change FROM (SELECT * FROM n WHERE file IN (SELECT file FROM b) EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def mismatch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches that came and went since the run before, which a seventh of the files doesn't have."""
    return op.mismatch_changes(_trimmed(spark, sf_dir), _trimmed(spark, sf_dir, BEFORE).where("file % 7 <> 3"))


def _runs(alias: str, source: str, k: int, f: int) -> str:
    return f"{alias} AS (SELECT file, {_share('COUNT(*) FILTER (outcome = ' + chr(39) + 'correct' + chr(39) + ')', 'COUNT(*)')} AS mapping_accuracy, {_columns({c: e.format(k, f) for c, e in RUN.items()})} FROM {source} GROUP BY file)"


def _delta(c: str, places: int, of: str = "{}") -> str:
    return f"CAST(ROUND(CAST(CAST({of.format('x.' + c)} AS DOUBLE) - CAST({of.format('y.' + c)} AS DOUBLE) AS DECIMAL(30,10)), {places}) AS DOUBLE) AS {c}_delta"


@query(BOTH + ", t AS (SELECT file, " + _share("COUNT(*) FILTER (t.tier = w.tier)", "COUNT(*)") + " AS triage_accuracy FROM wanted w LEFT JOIN triaged t USING (file, sheet) GROUP BY 1), " + _runs("x", "j", 1, 37) + ", " + _runs("y", "b", 2, 41)
    + f" SELECT COALESCE(x.file, y.file) AS file, {_delta('mapping_accuracy', 4)}, CAST(ROUND(CAST(t.triage_accuracy - CASE WHEN y.file IS NOT NULL THEN 0.5 END AS DECIMAL(30,10)), 4) AS DOUBLE) AS triage_accuracy_delta, {_delta('quality_score', 4)}, {_delta('completeness_score', 4)}, {_delta('duration', 2, 'NULLIF({}, 0)')}, CAST(COALESCE(x.tokens, 0) - COALESCE(y.tokens, 0) AS BIGINT) AS token_delta FROM x FULL JOIN y ON x.file = y.file LEFT JOIN t ON t.file = x.file")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run against the run before, file by file; the run before had half of all tiers right."""

    def measured(rows: DataFrame, triage: DataFrame | None, k: int, f: int) -> DataFrame:
        of = op.by_statement(rows).where("sheet is null").select("file", F.col("accuracy").alias("mapping_accuracy"))
        of = of.join(triage.select("file", F.col("accuracy").alias("triage_accuracy")), "file", "left") if triage is not None else of.withColumn("triage_accuracy", F.lit(0.5))
        return of.withColumns({c: F.expr(e.format(k, f)).cast("long" if c == "tokens" else "double") for c, e in RUN.items()})

    now = measured(_trimmed(spark, sf_dir), op.triage_accuracy(*_triage(spark, sf_dir)), 1, 37)
    return op.run_deltas(now, measured(_trimmed(spark, sf_dir, BEFORE).where("file % 7 <> 3"), None, 2, 41))
