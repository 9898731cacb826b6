"""Mapped labels against expected ones: outcomes by sheet and category, causes of errors, statements, and one run against another (A17, N, R34).

Expected rows: file, n (order), sheet, label, canonical_name. Items: file, n, label, canonical_name, stage. Alternatives:
canonical_name, acceptable. Nulls: an item without a name is unmapped, one without a label or with an empty one isn't there, a sheet
without a name is Unknown, an expected row without a name is never right. Repeated expected rows are judged each; of repeated
items the first or the last by n counts, of equal n the least or largest by name and stage. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.roles import double

#: What the name of a sheet holds, and the category it stands for; the first one that it holds counts.
SHEET_WORDS = [
    ("income", "income_statement"), ("p&l", "income_statement"), ("profit", "income_statement"), ("balance", "balance_sheet"), ("cash", "cash_flow"),
    ("debt", "debt_schedule"), ("working capital", "working_capital"), ("assumption", "assumptions"),
]
#: Where errors can come from; none is laid to validation, which leaves names as they are.
CAUSES = ["parsing", "triage", "mapping", "enhanced_mapping", "validation"]
SKIPPED = 4  # sheets of this tier or above aren't read


def sheet_category(sheet: Column) -> Column:
    """The category that a sheet's name stands for, other if none."""
    name, out = F.lower(sheet), F.lit("other")
    for word, category in reversed(SHEET_WORDS):
        out = F.when(name.contains(word), category).otherwise(out)
    return out


def judged(expected: DataFrame, items: DataFrame, alternatives: DataFrame, keep: str = "first", trim: bool = False) -> DataFrame:
    """file, n, sheet, label, expected, actual (null: no such item), stage, right (an acceptable name), outcome (missing, unmapped, correct, mismatch).

    A name with alternatives accepts only these, so itself only if listed. Items are reduced to one a label before they are joined."""
    clean = (lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) if trim else F.col
    told = F.struct("n", F.coalesce("canonical_name", F.lit("unmapped")).alias("actual"), F.coalesce("stage", F.lit("")).alias("stage"))
    one = items.select("file", clean("label").alias("label"), told.alias("_told")).where("label <> ''").groupBy("file", "label").agg((F.min if keep == "first" else F.max)("_told").alias("_told"))
    accepted = alternatives.groupBy(F.col("canonical_name").alias("expected")).agg(F.collect_set("acceptable").alias("_accepted"))
    rows = expected.select("file", "n", F.coalesce("sheet", F.lit("Unknown")).alias("sheet"), clean("label").alias("label"), F.col("canonical_name").alias("expected"))
    rows = rows.join(one, ["file", "label"], "left").join(accepted, "expected", "left")
    right = F.coalesce(F.array_contains(F.coalesce("_accepted", F.array("expected")), F.col("_told.actual")), F.lit(False))
    outcome = F.when(F.col("_told").isNull(), "missing").when(F.col("_told.actual") == "unmapped", "unmapped").when(right, "correct").otherwise("mismatch")
    return rows.select("file", "n", "sheet", "label", "expected", "_told.actual", "_told.stage", right.alias("right"), outcome.alias("outcome"))


def _part(top: Column, bottom: Column, scale: int = 4) -> Column:
    return F.coalesce(double(F.try_divide(top.cast("double"), bottom.cast("double")), scale), F.lit(0.0))


def by_level(rows: DataFrame) -> DataFrame:
    """File, level (file, sheet, category), name, and over judged rows total, tp, fp, fn, unmapped, precision, recall, f1, accuracy.

    One pass by grouping sets. A mismatch is a false positive and a false negative. The f1 of a sheet is made of rounded parts, as there."""
    n = lambda *which: F.count_if(F.col("outcome").isin(*which))
    sets = rows.withColumn("category", sheet_category(F.col("sheet"))).groupingSets([["file"], ["file", "sheet"], ["file", "category"]], "file", "sheet", "category")
    found = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("total"), n("correct").alias("tp"), n("mismatch").alias("fp"), n("mismatch", "missing", "unmapped").alias("fn"), n("missing", "unmapped").alias("unmapped"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _part(tp, tp + fp), _part(tp, tp + fn)
    level = F.when(F.col("g") == 3, "file").when(F.col("g") == 1, "sheet").otherwise("category")
    f1 = F.when(F.col("g") == 1, _part(2 * p * r, p + r)).otherwise(_part(2 * tp, 2 * tp + fp + fn))
    return found.select("file", level.alias("level"), F.coalesce("sheet", "category").alias("name"), "total", "tp", "fp", "fn", "unmapped", p.alias("precision"), r.alias("recall"), f1.alias("f1"), _part(tp, F.col("total")).alias("accuracy"))


def _tiers(triage: DataFrame, name: str) -> DataFrame:
    return triage.groupBy("file", "sheet").agg(F.max(F.struct("n", F.coalesce("tier", F.lit(0)).alias("tier")))["tier"].alias(name))


def triage_accuracy(expected: DataFrame, triage: DataFrame) -> DataFrame:
    """file, total, correct, accuracy of tiers. Both sides: file, n, sheet, tier; of a sheet triaged twice the last counts, a null tier is 0, a sheet without triage is wrong."""
    rows = expected.select("file", "sheet", F.coalesce("tier", F.lit(0)).alias("_expected")).join(_tiers(triage, "_actual"), ["file", "sheet"], "left")
    hits = F.count_if(F.col("_actual") == F.col("_expected"))
    return rows.groupBy("file").agg(F.count("*").alias("total"), hits.alias("correct"), _part(hits, F.count("*")).alias("accuracy"))


def attributed(expected: DataFrame, items: DataFrame, alternatives: DataFrame, expected_triage: DataFrame, triage: DataFrame) -> DataFrame:
    """N: judged rows (the last item of a label counts) with the cause of each error, null where the name is right.

    The ladder: no item and the sheet skipped against expectation: triage; no item: parsing; unmapped: mapping; a wrong name of the
    second pass: enhanced_mapping; another wrong name: mapping."""
    rows = judged(expected, items, alternatives, keep="last")
    rows = rows.join(_tiers(triage, "_actual"), ["file", "sheet"], "left").join(_tiers(expected_triage, "_expected"), ["file", "sheet"], "left")
    zero = F.lit(0)
    skipped = (F.coalesce("_actual", zero) >= SKIPPED) & (F.coalesce("_expected", zero) < SKIPPED)
    absent, again = F.col("actual").isNull(), F.col("stage").contains("enhanced") | F.col("stage").contains("stage_4")
    cause = F.when(F.col("right"), None).when(absent & skipped, "triage").when(absent, "parsing").when((F.col("actual") != "unmapped") & again, "enhanced_mapping").otherwise("mapping")
    return rows.select("file", "n", "sheet", "label", "expected", "actual", cause.alias("cause"))


def causes(rows: DataFrame) -> DataFrame:
    """N: file, sheet (null: the whole file), errors, and for each cause its number and percentage of the errors, rounded to one place."""
    sets = rows.groupingSets([["file"], ["file", "sheet"]], "file", "sheet")
    found = sets.agg(F.count("cause").alias("errors"), *[F.count_if(F.col("cause") == c).alias(c) for c in CAUSES])
    return found.select("file", "sheet", "errors", *CAUSES, *[_part(F.col(c) * 100, F.col("errors"), 1).alias(f"{c}_pct") for c in CAUSES])


def by_statement(rows: DataFrame) -> DataFrame:
    """File, sheet (null: the whole file), total, correct, unmapped, accuracy, accuracy_of_matched. rows: judged with trimmed labels."""
    n = lambda *which: F.count_if(F.col("outcome").isin(*which))
    sets = rows.groupingSets([["file"], ["file", "sheet"]], "file", "sheet")
    found = sets.agg(F.count("*").alias("total"), n("correct").alias("correct"), n("missing", "unmapped").alias("unmapped"))
    return found.select("*", _part(F.col("correct"), F.col("total")).alias("accuracy"), _part(F.col("correct"), F.col("total") - F.col("unmapped")).alias("accuracy_of_matched"))


def mismatch_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """File, label, change: mismatches of one run only, new or resolved, of files that both runs judged. Both sides: judged rows."""
    one = lambda rows, at: rows.groupBy("file", "label").agg(F.bool_or(F.col("outcome") == "mismatch").alias(at))
    files = now.select("file").distinct().join(before.select("file").distinct(), "file")
    both = one(now, "_now").join(one(before, "_before"), ["file", "label"], "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_now", "_before")})
    return both.where("_now <> _before").join(files, "file", "semi").select("file", "label", F.when(F.col("_now"), "new").otherwise("resolved").alias("change"))


#: Measures of a run and the places their differences are rounded to.
MEASURES = {"mapping_accuracy": 4, "triage_accuracy": 4, "quality_score": 4, "completeness_score": 4, "duration": 2}


def run_deltas(now: DataFrame, before: DataFrame) -> DataFrame:
    """File and for each measure the difference of the runs, null where one run lacks it (a duration of 0 is lacking); tokens always, a missing run has none.

    Both sides: one row a file with MEASURES and tokens."""
    a, b = (x.select("file", *[F.col(c).alias(f"_{s}_{c}") for c in (*MEASURES, "tokens")]) for s, x in (("a", now), ("b", before)))
    there = lambda c: F.nullif(F.col(c), F.lit(0.0)) if c.endswith("duration") else F.col(c)
    deltas = [double(there(f"_a_{c}") - there(f"_b_{c}"), places).alias(f"{c}_delta") for c, places in MEASURES.items()]
    return a.join(b, "file", "full").select("file", *deltas, (F.coalesce("_a_tokens", F.lit(0)) - F.coalesce("_b_tokens", F.lit(0))).cast("long").alias("token_delta"))
