"""Corrections of mapped items: preview, application, undo. State and change come in as tables, new state and history go out.

items: job_id, entity_id, seq (order in the job), label, sheet, canonical_name, confidence. corrections: job_id, n (order in
the request), label, new_name, sheet (null: any). A correction without its label in the job changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNMAPPED = "unmapped"


def _matched(items: DataFrame, corrections: DataFrame) -> DataFrame:
    c = corrections.select("job_id", "label", F.col("sheet").alias("_sheet"), "n", "new_name")
    rows = items.join(c, ["job_id", "label"]).where(F.col("_sheet").isNull() | (F.col("_sheet") == F.col("sheet"))).drop("_sheet")
    return rows.withColumns({"old_name": F.coalesce("canonical_name", F.lit(UNMAPPED)), "old_confidence": F.coalesce("confidence", F.lit(0.0))})


def preview(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """What each correction would change by itself: job_id, n, seq, label, sheet, old and new name, old confidence."""
    rows = _matched(items, corrections).where("old_name <> new_name")
    return rows.select("job_id", "n", "seq", "label", "sheet", "old_name", "new_name", "old_confidence")


def history(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """The changes in order. Each correction meets what the ones before it left; one that changes nothing leaves the confidence too."""
    w = Window.partitionBy("job_id", "seq").orderBy("n")
    rows = _matched(items, corrections).withColumn("_first", F.col("old_name"))
    rows = rows.withColumn("old_name", F.coalesce(F.lag("new_name").over(w), "_first")).withColumn("_changed", F.col("old_name") != F.col("new_name"))
    earlier = F.max("_changed").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("old_confidence", F.when(earlier, 1.0).otherwise(F.col("old_confidence")))
    return rows.where("_changed").select("job_id", "entity_id", "n", "seq", "label", "sheet", "old_name", "new_name", "old_confidence", F.lit(1.0).alias("new_confidence"))


def apply(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """The items afterwards; corrected ones have confidence 1 and the method user_correction."""
    last = history(items, corrections).groupBy("job_id", "seq").agg(F.max_by("new_name", "n").alias("_name"))
    done = F.col("_name").isNotNull()
    rows = items.join(last, ["job_id", "seq"], "left")
    return rows.withColumns({"canonical_name": F.coalesce("_name", "canonical_name"), "confidence": F.when(done, 1.0).otherwise(F.col("confidence")), "method": F.when(done, "user_correction")}).drop("_name")


def warnings(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """job_id, n, label and why: not_found, or no_change for each item that already was so."""
    seen = _matched(items, corrections)
    lost = corrections.join(seen.select("job_id", "n").distinct(), ["job_id", "n"], "left_anti").select("job_id", "n", "label", F.lit("not_found").alias("why"))
    w = Window.partitionBy("job_id", "seq").orderBy("n")
    same = seen.withColumn("_old", F.coalesce(F.lag("new_name").over(w), "old_name")).where("_old = new_name")
    return lost.unionByName(same.select("job_id", "n", "label", F.lit("no_change").alias("why")))


def bulk(items: DataFrame, corrections: DataFrame, names: DataFrame) -> DataFrame:
    """Corrections of the jobs in which each has a valid name and finds its label; one that doesn't rejects its job's whole batch. names: canonical_name."""
    found = _matched(items, corrections).select("job_id", "n").distinct().withColumn("_found", F.lit(True))
    valid = names.select(F.col("canonical_name").alias("new_name")).distinct().withColumn("_valid", F.lit(True))
    rows = corrections.join(found, ["job_id", "n"], "left").join(valid, "new_name", "left")
    good = rows.groupBy("job_id").agg(F.every(F.coalesce("_found", F.lit(False)) & F.coalesce("_valid", F.lit(False))).alias("_good")).where("_good").select("job_id")
    return corrections.join(good, "job_id", "left_semi")


def relabel(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts (job_id, label, canonical_name, confidence, method) after changes, in their order; each renames the label's facts that have its old name."""
    steps = changes.groupBy("job_id", "label").agg(F.array_sort(F.collect_list(F.struct("n", "seq", "old_name", "new_name"))).alias("_steps"))
    start = F.struct(F.col("canonical_name").alias("name"), F.lit(False).alias("hit"))
    follow = lambda now, x: F.when(now["name"] == x["old_name"], F.struct(x["new_name"].alias("name"), F.lit(True).alias("hit"))).otherwise(now)
    rows = facts.join(steps, ["job_id", "label"], "left").withColumn("_end", F.coalesce(F.aggregate("_steps", start, follow), start))
    hit = F.col("_end.hit")
    return rows.withColumns({"canonical_name": F.col("_end.name"), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "method": F.when(hit, "user_correction").otherwise(F.col("method"))}).drop("_end", "_steps")


def undo(past: DataFrame, asked: DataFrame) -> DataFrame:
    """Id, outcome of each asked id, and what it restores (old name and confidence) if undone.

    past: history with id and reverted. Refused are unknown ids, reverted ones, and those whose label and sheet (null like
    null) have another change in force in the job. Each id is judged by the state given.
    """
    w = Window.partitionBy("job_id", "label", "sheet")
    state = past.withColumn("_active", F.count_if(~F.col("reverted")).over(w))
    rows = asked.select("id").distinct().join(state, "id", "left")
    others = F.col("_active") - (~F.col("reverted")).cast("int")
    outcome = F.when(F.col("job_id").isNull(), "not_found").when(F.col("reverted"), "already_reverted").when(others > 0, "other_active").otherwise("undone")
    return rows.withColumn("outcome", outcome).select("id", "outcome", "job_id", "label", "sheet", *[F.when(outcome == "undone", F.col(c)).alias(c) for c in ("old_name", "old_confidence")])


def restore(items: DataFrame, undone: DataFrame) -> DataFrame:
    """Items afterwards: the first item of the job with the label (and sheet) gets its old name and confidence back; of several for an item, those of the least id."""
    back = undone.where("outcome = 'undone'").select("id", "job_id", "label", F.col("sheet").alias("_sheet"), F.col("old_name").alias("_name"), F.col("old_confidence").alias("_confidence"))
    rows = items.select("job_id", "seq", "label", "sheet").join(back, ["job_id", "label"]).where(F.col("_sheet").isNull() | (F.col("_sheet") == F.col("sheet")))
    first = rows.groupBy("id").agg(F.min_by(F.struct("job_id", "seq", "_name", "_confidence"), "seq").alias("x")).select("id", "x.*")
    one = first.groupBy("job_id", "seq").agg(F.min_by("_name", "id").alias("_name"), F.min_by("_confidence", "id").alias("_confidence"))
    return items.join(one, ["job_id", "seq"], "left").withColumns({"canonical_name": F.coalesce("_name", "canonical_name"), "confidence": F.coalesce("_confidence", "confidence")}).drop("_name", "_confidence")


def pattern_delta(changes: DataFrame) -> DataFrame:
    """An entity's pattern of each changed label: how often, and the first new name (all have confidence 1, which replaces lower ones only)."""
    return changes.groupBy("entity_id", "label").agg(F.min_by("new_name", F.struct("job_id", "n", "seq")).alias("canonical_name"), F.lit(1.0).alias("confidence"), F.count("*").alias("count"))


def alias_delta(changes: DataFrame, weight: int = 3) -> DataFrame:
    """Learned aliases of changed labels; a correction counts weight times."""
    return changes.groupBy(F.col("new_name").alias("canonical_name"), F.col("label").alias("alias")).agg((F.count("*") * weight).alias("weight"), F.array_sort(F.collect_set("entity_id")).alias("entities"))


def evidence(suggestions: DataFrame, changes: DataFrame) -> DataFrame:
    """Pending suggestions (id, text, status, canonical_name, kind, evidence, jobs) of a changed label count it, keep its jobs, and get a name if they have none."""
    delta = changes.groupBy(F.col("label").alias("text")).agg(F.count("*").alias("_n"), F.collect_set("job_id").alias("_jobs"), F.min_by("new_name", F.struct("job_id", "n", "seq")).alias("_name"))
    hit = (F.col("status") == "pending") & F.col("_n").isNotNull()
    bare: Column = hit & F.col("canonical_name").isNull()
    return suggestions.join(delta, "text", "left").withColumns({
        "evidence": F.coalesce("evidence", F.lit(0)) + F.when(hit, F.col("_n")).otherwise(0), "jobs": F.when(hit, F.array_sort(F.array_union("jobs", "_jobs"))).otherwise(F.col("jobs")),
        "canonical_name": F.when(bare, F.col("_name")).otherwise(F.col("canonical_name")), "kind": F.when(bare, "new_alias").otherwise(F.col("kind")),
    }).drop("_n", "_jobs", "_name")
