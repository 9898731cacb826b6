"""Shapes of records and small reports: taxonomy as a document, lineage, validation records, job reports, sheet summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The taxonomy as a document.
DOCUMENT = "categories map<string, array<struct<canonical_name: string, display: string, aliases: array<string>, priority: int, rules: array<string>>>>"


def taxonomy_items(documents: DataFrame, content: str = "content") -> DataFrame:
    """An item for each entry of the categories of JSON documents: category, canonical_name, display, aliases, priority, rules. A document that isn't one has none."""
    parsed = documents.select(F.explode(F.from_json(content, DOCUMENT)["categories"]).alias("category", "items"))
    return parsed.select("category", F.inline("items"))


def alias_index(items: DataFrame) -> DataFrame:
    """Alias (lower case, trimmed), canonical_name, priority of each alias and display name, not of the canonical name."""
    names = F.array_compact(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("display")))
    rows = items.select(F.explode(names).alias("alias"), "canonical_name", "priority").withColumn("alias", F.lower(F.trim("alias")))
    return rows.where("alias <> ''").groupBy("alias", "canonical_name").agg(F.min("priority").alias("priority"))


def with_rules(items: DataFrame) -> DataFrame:
    """Items that carry rules."""
    return items.where(F.size("rules") > 0)


def validated_names(mappings: DataFrame, names: DataFrame) -> DataFrame:
    """Mappings whose name isn't in the vocabulary become unmapped, with confidence 0. names: canonical_name."""
    known = names.select("canonical_name").distinct().withColumn("_known", F.lit(True))
    fine = F.coalesce("_known", F.lit(False))
    return mappings.join(known, "canonical_name", "left").withColumns({"canonical_name": F.when(fine, F.col("canonical_name")).otherwise("unmapped"), "confidence": F.when(fine, F.col("confidence")).otherwise(0.0)}).drop("_known")


def merged_aliases(base: DataFrame, more: DataFrame) -> DataFrame:
    """canonical_name and aliases, those of base first, then the others' that aren't there yet."""
    none = F.array().cast("array<string>")
    a, b = base.select("canonical_name", F.col("aliases").alias("_a")), more.select("canonical_name", F.col("aliases").alias("_b"))
    return a.join(b, "canonical_name", "full").select("canonical_name", F.array_union(F.coalesce("_a", none), F.coalesce("_b", none)).alias("aliases"))


def lineage_chain(events: DataFrame) -> DataFrame:
    """A job's events (job_id, stage, at, n) in their order: place and the stage before."""
    w = Window.partitionBy("job_id").orderBy("at", "n")
    return events.select("job_id", "stage", "at", "n", F.row_number().over(w).alias("place"), F.lag("stage").over(w).alias("before"))


def lineage_summary(events: DataFrame, required: Sequence[str]) -> DataFrame:
    """R/U06: for each job events, distinct stages, first and last time, and the required stages that are missing, in their order."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("_stages"))
    rows = events.groupBy("job_id").agg(F.count("*").alias("events"), F.collect_set("stage").alias("_stages"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return rows.select("job_id", "events", F.size("_stages").alias("stages"), "first_at", "last_at", F.array_join(missing, "|").alias("missing"), (F.size(missing) == 0).alias("is_complete"))


def next_stage(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """The stage from which a job goes on: behind the last one it completed; null if that is the final one. events: job_id, stage, completed."""
    at = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    done = events.groupBy("job_id").agg(F.max(F.when(F.col("completed"), at)).alias("_done"))
    return done.select("job_id", F.get(F.array(*map(F.lit, stages)), F.coalesce("_done", F.lit(0)).cast("int")).alias("resume_from"))


def validation_records(flags: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each validated name (keys) its flags' number, distinct rules, and whether none is an error; names without a flag too. flags: keys, rule, severity."""
    own = flags.groupBy(*keys).agg(F.count("*").alias("flags"), F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("rules"), F.max((F.col("severity") == "error").cast("int")).alias("_error"))
    rows = names.select(*keys).distinct().join(own, list(keys), "left")
    return rows.select(*keys, F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("rules", F.lit("")).alias("rules"), (F.coalesce("_error", F.lit(0)) == 0).alias("all_passed"))


def passed_patterns(mapped: DataFrame, flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pattern-mapped items that no flag names."""
    return mapped.select(*keys).distinct().join(flagged.select(*keys).distinct(), list(keys), "left_anti")


def result_rows(extracted: DataFrame, derived: DataFrame) -> DataFrame:
    """Extracted and derived facts in one shape; what the other kind has is null."""
    text, number = (F.lit(None).cast(x) for x in ("string", "double"))
    columns = ("entity_id", "period", "canonical_name", "value", "confidence")
    e = extracted.select(*columns, F.lit("extracted").alias("source"), "label", "sheet", text.alias("rule_id"), number.alias("low"), number.alias("high"), F.lit(None).cast("boolean").alias("passed"), F.lit(False).alias("is_gap_fill"))
    d = derived.select(*columns, F.lit("derived").alias("source"), text.alias("label"), text.alias("sheet"), "rule_id", "low", "high", "passed", (F.col("kind") == "gap_fill").alias("is_gap_fill"))
    return e.unionByName(d)


def versions(rows: DataFrame) -> DataFrame:
    """Versions, newest first, with whether they have a snapshot instead of the snapshot itself."""
    return rows.select("version", "checksum", "created_at", F.col("snapshot").isNotNull().alias("has_snapshot"))


def diff_report(diff: DataFrame, entities: DataFrame) -> DataFrame:
    """For each pair of jobs (job_a, job_b) the number of each change, and whether the jobs belong to different entities. diff: job_a, job_b, change; entities: job_id, entity_id."""
    kinds = ("added", "removed", "mapping_changed", "value_changed", "unchanged")
    rows = diff.groupBy("job_a", "job_b").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    of = lambda c: entities.select(F.col("job_id").alias(f"job_{c}"), F.col("entity_id").alias(f"_{c}"))
    return rows.join(of("a"), "job_a", "left").join(of("b"), "job_b", "left").select("job_a", "job_b", *kinds, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("cross_entity"))


def diagnostics(rows: DataFrame, dimensions: Sequence[str], worst: int = 2) -> DataFrame:
    """Of each job below grade B the weakest dimensions: job_id, dimension, value, place (ties by name)."""
    long = rows.where(F.col("grade").isin("C", "D", "F")).select("job_id", "grade", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))).where("value is not null")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("value", "dimension"))
    return long.withColumn("place", place).where(F.col("place") <= worst)


def category_context(rows: DataFrame, sections: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """The category of each row: that of the section it lies in (of several the one that begins last), else of the first pattern its sheet's name holds, else unknown. One window over both sides.

    rows: sheet, row_index, label; sections: sheet, start, end, category.
    """
    a = rows.select("sheet", F.col("row_index").alias("at"), "label", F.lit(None).cast("struct<end: long, category: string>").alias("s"))
    b = sections.select("sheet", F.col("start").alias("at"), F.lit(None).cast("string").alias("label"), F.struct(F.col("end").cast("long").alias("end"), "category").alias("s"))
    w = Window.partitionBy("sheet").orderBy("at", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("s", ignorenulls=True).over(w)
    ladder = F.coalesce(*[F.when(F.lower("sheet").contains(p), c) for p, c in patterns], F.lit("unknown"))
    found = a.unionByName(b).withColumn("_last", last).where("s is null")
    inside = F.col("_last")["end"] >= F.col("at")
    return found.select("sheet", F.col("at").alias("row_index"), "label", F.coalesce(F.when(inside, F.col("_last")["category"]), ladder).alias("category"))


def sheet_summary(rows: DataFrame, labels: int = 5, bold: int = 10) -> DataFrame:
    """For each sheet rows, the first labels, bold labels, formulas, and whether a label speaks of a total. rows: sheet, row_index, label, is_bold, formulas."""
    ordered = lambda keep, n: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(keep, F.struct("row_index", "label")))), 1, n), lambda x: x["label"]), "|")
    # only the least rows of a sheet are gathered, whatever its size
    first = F.row_number().over(Window.partitionBy("sheet", "is_bold", F.col("label").isNotNull()).orderBy("row_index", "label"))
    own = rows.withColumn("_n", first)
    top = own.where((F.col("_n") <= max(labels, bold)) & F.col("label").isNotNull())
    texts = top.groupBy("sheet").agg(ordered(F.lit(True), labels).alias("first_labels"), ordered(F.col("is_bold"), bold).alias("bold_labels"))
    counts = rows.groupBy("sheet").agg(F.count("*").alias("rows"), F.sum("formulas").alias("formulas"), F.max(F.coalesce(F.lower("label").rlike(r"\btotal\b"), F.lit(False))).alias("has_subtotal"))
    return counts.join(texts, "sheet", "left").na.fill("", ["first_labels", "bold_labels"])


def static_values(rows: DataFrame) -> DataFrame:
    """Sheets of labels and single values (at least three rows, no period anywhere): each row's first value under the period static. rows: sheet, row_index, label, values (array), has_periods."""
    sheets = rows.groupBy("sheet").agg(F.count("*").alias("n"), F.max("has_periods").alias("p")).where("n >= 3 and not p").select("sheet")
    value = F.get(F.filter("values", lambda x: x.isNotNull()), F.lit(0))
    return rows.join(sheets, "sheet", "left_semi").select("sheet", "row_index", "label", F.lit("static").alias("period"), value.alias("value")).where("value is not null")


def mean_confidence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean confidence of the mappings; a missing one counts as 0."""
    return rows.groupBy(*keys).agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def entity_context(patterns: DataFrame, mappings: DataFrame, most: int = 20, more: int = 10, sure: float = 0.9) -> DataFrame:
    """For each entity its patterns used most (at most most), then sure mappings of labels that have no pattern (at most more). patterns: entity_id, label, canonical_name, count; mappings: entity_id, label, canonical_name, confidence."""
    top = lambda order: F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))
    a = patterns.withColumn("place", top([F.desc("count"), "label"])).where(F.col("place") <= most)
    b = mappings.where(F.col("confidence") >= sure).join(a.select("entity_id", "label"), ["entity_id", "label"], "left_anti")
    b = b.withColumn("place", top([F.desc("confidence"), "label", "canonical_name"])).where(F.col("place") <= more)
    keep = lambda df, source: df.select("entity_id", "label", "canonical_name", F.lit(source).alias("source"), "place")
    return keep(a, "pattern").unionByName(keep(b, "mapping"))


def scaled(value: Column, unit: Column) -> Column:
    """a value in its unit (thousands, millions, billions; others count as ones)."""
    times = F.when(unit == "thousands", 1_000).when(unit == "millions", 1_000_000).when(unit == "billions", 1_000_000_000).otherwise(1)
    return value * times


def close(score: Column, least: float = 85.0) -> Column:
    """A close match."""
    return score >= least
