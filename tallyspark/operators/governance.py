"""State that grows by changes: labels, cells, patterns, suggestions, aliases, deprecations, rates, jobs. Each function takes the state and the change and returns the new state, or what to append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import upsert
from .taxonomy import fold_patterns


def unmapped_labels(state: DataFrame, rows: DataFrame) -> DataFrame:
    """label_normalized, entity_id (null like null), occurrences, labels, sheets (sorted sets), hint of the first row.

    rows: label, entity_id, sheet, hint, seq. A label is normalised by trimming and lower case.
    """
    keys = [F.lower(F.trim("label")).alias("label_normalized"), "entity_id"]
    new = rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("sheet")).alias("sheets"), F.min_by(F.struct("hint"), "seq")["hint"].alias("hint"))
    a, b = state.alias("a"), new.alias("b")
    same = (F.col("a.label_normalized") == F.col("b.label_normalized")) & F.col("a.entity_id").eqNullSafe(F.col("b.entity_id"))
    none = F.array().cast("array<string>")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(f"a.{c}", none), F.coalesce(f"b.{c}", none))).alias(c)
    hint = F.when(F.col("a.label_normalized").isNull(), F.col("b.hint")).otherwise(F.col("a.hint")).alias("hint")  # set on insertion only
    count = (F.coalesce("a.occurrences", F.lit(0)) + F.coalesce("b.occurrences", F.lit(0))).alias("occurrences")
    return a.join(b, same, "full").select(F.coalesce("a.label_normalized", "b.label_normalized").alias("label_normalized"), F.coalesce("a.entity_id", "b.entity_id").alias("entity_id"), count, both("labels"), both("sheets"), hint)


def column_number(letters: Column) -> Column:
    """Column letters to a number from 0."""
    chars = F.transform(F.split(letters, ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(chars, F.lit(0), lambda n, x: n * 26 + x) - 1


def cell_mappings(items: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each source cell of the items, the first of each (job, sheet, cell), with its place, role, and the fact it belongs to.

    items: job_id, seq, label, sheet, canonical_name, confidence, cells (array of sheet, cell_ref, period, raw, formula);
    facts: fact_id, job_id, sheet, cell_ref. Cells without a sheet (their own or the item's) or a proper reference go.
    """
    cells = items.select("job_id", "seq", "label", F.col("sheet").alias("_sheet"), "canonical_name", "confidence", F.posexplode("cells").alias("_pos", "c"))
    rows = cells.select("job_id", "seq", "_pos", "label", "canonical_name", "confidence", F.coalesce("c.sheet", "_sheet").alias("sheet"), F.col("c.cell_ref").alias("_ref"), "c.period", "c.raw", "c.formula").where("sheet is not null and _ref is not null")
    first = F.row_number().over(Window.partitionBy("job_id", "sheet", "_ref").orderBy("seq", "_pos"))
    rows = rows.withColumn("_n", first).where("_n = 1").withColumn("cell_ref", F.upper("_ref")).where(F.col("cell_ref").rlike("^[A-Z]+[0-9]+$"))
    mapped = F.col("canonical_name").isNotNull() & (F.col("canonical_name") != "unmapped")
    rows = rows.select(
        "job_id", "sheet", "cell_ref", F.regexp_extract("cell_ref", "[0-9]+$", 0).cast("int").alias("row_index"), column_number(F.regexp_extract("cell_ref", "^[A-Z]+", 0)).alias("col_index"),
        F.when(F.col("period").isNotNull(), "value").otherwise("label").alias("role"), F.when(mapped, F.col("canonical_name")).alias("canonical_name"), "label", "period", F.when(mapped, "mapped").otherwise("unmapped").alias("status"),
        F.when(mapped, F.col("confidence")).alias("confidence"), F.col("formula").isNotNull().alias("has_formula"),
    )
    own = facts.where("cell_ref is not null").groupBy("job_id", "sheet", F.upper("cell_ref").alias("cell_ref")).agg(F.max("fact_id").alias("_fact"))
    return rows.join(own, ["job_id", "sheet", "cell_ref"], "left").withColumn("fact_id", F.when(F.col("role") == "value", F.col("_fact"))).drop("_fact")


def bulk_patterns(state: DataFrame, mappings: DataFrame, names: DataFrame, least: float = 0.8) -> DataFrame:
    """Patterns after a stream of mappings (entity_id, label, canonical_name, confidence, seq from 1): those below least, unmapped, blank or of an unknown name are skipped. state: the same without seq, and count."""
    good = mappings.where((F.col("confidence") >= least) & (F.col("canonical_name") != "unmapped") & (F.coalesce(F.length("label"), F.lit(0)) > 0))
    good = good.join(names.select("canonical_name").distinct(), "canonical_name", "left_semi").withColumn("count", F.lit(1).cast("long"))
    old = state.withColumn("seq", F.lit(0).cast("long"))
    columns = ["entity_id", "label", "canonical_name", "confidence", "count", "seq"]
    return fold_patterns(old.select(columns).unionByName(good.select(*columns[:-1], F.col("seq").cast("long"))), ["entity_id", "label"])


def resolve_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Id and outcome of each decision (id, accept): accepted or rejected if pending, already_resolved, failed if there is no such suggestion. Of several decisions on one the first (n) counts."""
    one = decisions.groupBy("id").agg(F.min_by("accept", "n").alias("accept"))
    rows = one.join(suggestions, "id", "left")
    outcome = F.when(F.col("status").isNull(), "failed").when(F.col("status") != "pending", "already_resolved").when(F.col("accept"), "accepted").otherwise("rejected")
    return rows.select("id", outcome.alias("outcome"), "kind", "canonical_name", "text")


def accepted_aliases(taxonomy: DataFrame, resolved: DataFrame) -> DataFrame:
    """canonical_name and aliases after accepted suggestions of new aliases; those that are there aren't added, new ones come behind, in order."""
    new = resolved.where("outcome = 'accepted' and kind = 'new_alias' and canonical_name is not null").groupBy("canonical_name").agg(F.array_sort(F.collect_set("text")).alias("_new"))
    none = F.array().cast("array<string>")
    return taxonomy.join(new, "canonical_name", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("_new", none))).drop("_new")


def add_aliases(taxonomy: DataFrame, asked: DataFrame) -> DataFrame:
    """N, canonical_name, alias and outcome of each asked alias: added, duplicate (also of an earlier one; case doesn't count), or why it failed."""
    rows = asked.join(taxonomy.select("canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("_have")), "canonical_name", "left")
    blank = (F.coalesce(F.length("canonical_name"), F.lit(0)) == 0) | (F.coalesce(F.length("alias"), F.lit(0)) == 0)
    first = F.row_number().over(Window.partitionBy("canonical_name", F.lower("alias")).orderBy("n"))
    there = F.exists("_have", lambda x: F.lower(x) == F.lower(F.col("alias"))) | (F.col("_first") > 1)
    outcome = F.when(blank, "missing field").when(F.col("_have").isNull(), "item not found").when(there, "duplicate").otherwise("added")
    return rows.withColumn("_first", first).select("n", "canonical_name", "alias", outcome.alias("outcome"))


def alias_changes(taxonomy: DataFrame, added: DataFrame) -> DataFrame:
    """A line of the change log for each added alias, with the aliases before and after it."""
    new = added.where("outcome = 'added'").join(taxonomy.select("canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("_have")), "canonical_name")
    upto = F.concat("_have", F.array_agg("alias").over(Window.partitionBy("canonical_name").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    text = lambda a: F.array_join(a, "|")
    return new.withColumn("_now", upto).select("n", "canonical_name", F.lit("aliases").alias("field"), text(F.slice("_now", 1, F.size("_now") - 1)).alias("old_value"), text(F.col("_now")).alias("new_value"))


def deprecate(taxonomy: DataFrame, asked: DataFrame) -> DataFrame:
    """canonical_name, redirect and outcome of each request: deprecated, or item_not_found, target_not_found, target_deprecated. taxonomy: canonical_name, deprecated."""
    item = taxonomy.select("canonical_name", F.lit(True).alias("_item"))
    target = taxonomy.select(F.col("canonical_name").alias("redirect"), F.col("deprecated").alias("_gone"), F.lit(True).alias("_target"))
    rows = asked.join(item, "canonical_name", "left").join(target, "redirect", "left")
    asks = F.col("redirect").isNotNull()
    outcome = F.when(F.col("_item").isNull(), "item_not_found").when(asks & F.col("_target").isNull(), "target_not_found").when(asks & F.col("_gone"), "target_deprecated").otherwise("deprecated")
    return rows.select("canonical_name", "redirect", outcome.alias("outcome"))


def taxonomy_changes(outcomes: DataFrame) -> DataFrame:
    """The change log of deprecations: the flag, and the redirect if there is one."""
    done = outcomes.where("outcome = 'deprecated'")
    flag = done.select("canonical_name", F.lit("deprecated").alias("field"), F.lit("false").alias("old_value"), F.lit("true").alias("new_value"))
    return flag.unionByName(done.where("redirect is not null").select("canonical_name", F.lit("deprecated_redirect").alias("field"), F.lit(None).cast("string").alias("old_value"), F.col("redirect").alias("new_value")))


def cache_rates(state: DataFrame, rates: DataFrame, keys: Sequence[str] = ("base", "quote", "date")) -> DataFrame:
    """Of each pair and date the rate fetched last; of equal times the larger."""
    return state.unionByName(rates).groupBy(*keys).agg(F.max_by("rate", F.struct("fetched_at", "rate")).alias("rate"), F.max("fetched_at").alias("fetched_at"))


#: What may follow each state of a job.
FOLLOWS = {"pending": ["processing", "failed"], "processing": ["completed", "failed", "needs_review"], "needs_review": ["completed", "failed"]}


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status (of the last event), progress (the largest), updated_at and events. A job completed by an event whose gate failed needs review. events: job_id, at, n (breaks ties), status, progress, gate_passed."""
    shown = F.when((F.col("status") == "completed") & ~F.coalesce("gate_passed", F.lit(True)), "needs_review").otherwise(F.col("status"))
    return events.groupBy("job_id").agg(F.max_by(shown, F.struct("at", "n")).alias("status"), F.max("progress").alias("progress"), F.max("at").alias("updated_at"), F.count("*").alias("events"))


def job_transitions(events: DataFrame) -> DataFrame:
    """job_id, at, n, before, status, accepted of each event: accepted are updates of the state a job is in, and what FOLLOWS lists for it; the rest is refused and changes nothing.

    A job begins as pending; a completion whose gate failed asks for review; a status of null is refused. Equal events of one job
    and time come in the order of n, then of status; the second of two equal ones is an update. States only move forward, so as
    many windows as there are states that others follow find all steps; they share one shuffle by job, whose rows spill.
    events: as for job_states.
    """
    job, states = Window.partitionBy("job_id"), [*FOLLOWS, *{s for after in FOLLOWS.values() for s in after} - set(FOLLOWS)]
    shown = F.when((F.col("status") == "completed") & ~F.coalesce("gate_passed", F.lit(True)), "needs_review").otherwise(F.col("status"))
    follows = lambda state, status: F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for s in states for x in (F.lit(s), F.array(*map(F.lit, FOLLOWS.get(s, ["-"]))))]), state), status), F.lit(False))
    rows = events.select("job_id", "at", "n", shown.alias("status")).withColumn("_i", F.row_number().over(job.orderBy("at", "n", "status"))).withColumns({"_at": F.struct("_i", "status"), "_state": F.lit("pending"), "before": F.lit("pending")})
    rows = rows.withColumn("_last", F.lit(None).cast(rows.schema["_at"].dataType))
    for _ in FOLLOWS:
        later = F.col("_last").isNull() | (F.col("_at") > F.col("_last"))
        step = F.min(F.when(later & follows(F.col("_state"), F.col("status")), F.col("_at"))).over(job)
        rows = rows.withColumn("_step", step).withColumns({"_state": F.coalesce("_step.status", "_state"), "_last": F.coalesce("_step", "_last"), "before": F.when(F.col("_step") < F.col("_at"), F.col("_step.status")).otherwise(F.col("before"))})
    accepted = F.coalesce(F.col("status") == F.col("before"), F.lit(False)) | follows(F.col("before"), F.col("status"))
    return rows.select("job_id", "at", "n", "before", "status", accepted.alias("accepted"))


def job_outcomes(transitions: DataFrame) -> DataFrame:
    """job_id, status (pending if no event was accepted), updated_at (null then), accepted, refused."""
    known = F.when(F.col("accepted"), F.struct("at", "n", "status"))
    found = transitions.groupBy("job_id").agg(F.max(known).alias("_last"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    return found.select("job_id", F.coalesce("_last.status", F.lit("pending")).alias("status"), F.col("_last.at").alias("updated_at"), "accepted", "refused")


def backfill_periods(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Normalized periods where they are null, looked up by job and raw period. known: job_id, period, normalized; of several the least."""
    one = known.groupBy("job_id", "period").agg(F.min("normalized").alias("_normalized"))
    return facts.join(one, ["job_id", "period"], "left").withColumn("normalized", F.coalesce("normalized", "_normalized")).drop("_normalized")


def taxonomy_version(taxonomy: DataFrame) -> DataFrame:
    """One row: hash of the sorted items, number of items, and how many there are in each category, as name:count."""
    line = F.concat_ws("\t", "category", "canonical_name", F.array_join(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))), "|"))
    # a hash for each item first, so that only these meet in one row
    items = taxonomy.select("category", F.sha2(line, 256).alias("hash"))
    by = items.groupBy("category").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("hash"))
    parts = F.array_sort(F.collect_list(F.struct("category", "n", "hash")))
    return by.agg(F.sum("n").alias("items"), parts.alias("p")).select("items", F.sha2(F.array_join(F.transform("p", lambda x: x["hash"]), ""), 256).alias("checksum"), F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["category"], x["n"])), "|").alias("categories"))


def accept_label(patterns: DataFrame, accepted: DataFrame, confidence: float = 0.85) -> DataFrame:
    """Patterns with those of accepted labels (entity_id, label, canonical_name, n) that had none yet; of several the first."""
    one = accepted.groupBy("entity_id", "label").agg(F.min_by("canonical_name", "n").alias("canonical_name"))
    new = one.join(patterns, ["entity_id", "label"], "left_anti").withColumns({"confidence": F.lit(confidence), "count": F.lit(1).cast("long")})
    return patterns.unionByName(new.select(patterns.columns))


def replay(letters: DataFrame, replays: DataFrame) -> DataFrame:
    """M27/ST5: dead letters after replays (id, at): each is replayed once; later replays of it change nothing."""
    first = replays.groupBy("id").agg(F.min("at").alias("_at"))
    return letters.join(first, "id", "left").withColumn("replayed_at", F.coalesce("replayed_at", "_at")).drop("_at")


def without(state: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are deleted go."""
    return state.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def entities(state: DataFrame, changes: DataFrame) -> DataFrame:
    """entity_id, name, industry after creations and updates in order; a null leaves what was there."""
    new = changes.groupBy("entity_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c) for c in ("name", "industry")])
    return upsert(state.select("entity_id", "name", "industry"), new, ["entity_id"], {c: F.coalesce(f"new_{c}", f"old_{c}") for c in ("name", "industry")})


def extracted_values(candidates: DataFrame, tiers: int = 3) -> DataFrame:
    """B: one value for each key, canonical and period: the first, unless another disagrees; then that of the lowest tier, the first of equals. With the candidates' number, whether they conflict, and the sheet.

    candidates: key, canonical_name, period, value (decimal), unit (null: 1), sheet, tier, seq. Sheets beyond tiers and
    unmapped rows take no part. Values agree within 0.01, or a thousandth of the first one (at least 1).
    """
    rows = candidates.where((F.col("tier") <= tiers) & F.col("value").isNotNull() & F.col("canonical_name").isNotNull() & (F.col("canonical_name") != "unmapped"))
    rows = rows.withColumn("value", (F.col("value") * F.coalesce("unit", F.lit(1).cast("decimal(10,0)"))).cast("decimal(28,4)"))
    keys = ["key", "canonical_name", "period"]
    first = F.first("value").over(Window.partitionBy(*keys).orderBy("seq"))
    gap = F.abs(F.col("value") - F.col("_first"))
    apart = (gap > 0.01) & (gap.cast("double") / F.greatest(F.abs("_first"), F.lit(1)).cast("double") > 0.001)
    pick = lambda c: F.when(F.max(apart), F.min_by(c, F.struct("tier", "seq"))).otherwise(F.min_by(c, "seq"))
    return rows.withColumn("_first", first).groupBy(*keys).agg(pick("value").alias("value"), pick("sheet").alias("sheet"), F.count("*").alias("candidates"), F.max(apart).alias("is_conflict"))


#: Drops of accuracy that are allowed, usually and when the taxonomy has changed.
DROPS = {"mapping": 0.02, "triage": 0.00, "f1": 0.02, "recall": 0.03}
LOOSER = {"mapping": 0.05, "triage": 0.02, "f1": 0.05, "recall": 0.05}


def regression_gate(baseline: DataFrame, current: DataFrame, own: DataFrame) -> DataFrame:
    """O: fixture, metric, delta, threshold and failed of each metric both runs have.

    baseline, current: fixture, version, metric, value; own: fixture, metric, threshold, before the usual ones. Between
    different versions the looser threshold holds if it is larger.
    """
    pick = lambda of: F.coalesce(*[F.when(F.col("metric") == k, v) for k, v in of.items()], F.lit(0.0))
    rows = current.join(baseline.select("fixture", "metric", F.col("version").alias("_old"), F.col("value").alias("_base")), ["fixture", "metric"]).join(own, ["fixture", "metric"], "left")
    usual = F.coalesce("threshold", pick(DROPS))
    allowed = F.when(F.col("version") != F.col("_old"), F.greatest(usual, pick(LOOSER))).otherwise(usual)
    delta = F.round((F.col("value") - F.col("_base")).cast("decimal(20,10)"), 6).cast("double")
    return rows.where("value is not null and _base is not null").select("fixture", "metric", delta.alias("delta"), allowed.alias("threshold"), (delta < -allowed).alias("failed"))
