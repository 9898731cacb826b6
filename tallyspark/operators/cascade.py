"""Q: labels mapped in stages, each of which sees only what the ones before it left; then disambiguation, rescue and redirects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import settled
from .facts import redirect
from .taxonomy import fuzzy_scores

#: What a mapping has for a name if there is none.
UNMAPPED = "unmapped"
#: The priority of an alias that has none, where another one of its category has.
LAST = 999
#: Gives label, canonical_name, confidence for the labels it is handed (label).
Give = Callable[[DataFrame], DataFrame]


def contexts(items: DataFrame) -> DataFrame:
    """Label, category, pos: the categories that each label is met in, and where first; the section's, or else by the sheet's name.

    items: label, sheet, section_category, seq. Rows without either, and labels of null, have none.
    """
    section = F.when(F.length("section_category") > 0, F.col("section_category"))
    rows = items.select("label", F.coalesce(section, text.sheet_category(F.col("sheet"))).alias("category"), "seq")
    return rows.where("label is not null and category is not null").groupBy("label", "category").agg(F.min("seq").alias("pos"))


def entries(aliases: DataFrame) -> DataFrame:
    """Aliases by their lower-case texts without outer spaces, equal ones as one row with their number (entries) and first seq; blank ones go. aliases: alias, canonical_name, category, priority, seq."""
    rows = aliases.select(text.folded(F.col("alias")).alias("alias"), "canonical_name", "category", F.col("priority").cast("int").alias("priority"), "seq").where("alias <> ''")
    return rows.groupBy("alias", "canonical_name", "category", "priority").agg(F.count("*").alias("entries"), F.min("seq").alias("seq"))


def _total(rows: DataFrame) -> DataFrame:
    return rows.groupBy("alias").agg(F.sum("entries").alias("_total"), F.min("canonical_name").alias("_only"))


def by_category(rows: DataFrame) -> DataFrame:
    """Alias, category, the number n of entries there, and who of them is the only one, has the least priority alone, and is named most like the alias.

    rows: of entries(). An entry that is there twice counts twice. Where no entry has a priority, no one wins by it; of equal
    names the first (seq) counts, and a name that neither holds the alias nor is held by it counts for nothing.
    """
    words, plain = F.replace("canonical_name", F.lit("_"), F.lit(" ")), text.trimmed(F.replace(F.replace("alias", F.lit("&"), F.lit("and")), F.lit("-"), F.lit(" ")))
    score = F.when(words == plain, 100).when(F.contains(plain, words) | F.contains(words, plain), 50 + F.length(words))
    each = rows.groupBy("alias", "category", "canonical_name").agg(F.sum("entries").alias("n"), F.min("priority").alias("p"), F.min("seq").alias("seq"))
    like = F.max(F.when(score.isNotNull(), F.struct(score.alias("score"), (-F.col("seq")).alias("seq"), "canonical_name"))).alias("like")
    level = each.groupBy("alias", "category", F.coalesce("p", F.lit(LAST)).alias("p")).agg(F.sum("n").alias("n"), F.count("p").alias("known"), F.min("canonical_name").alias("name"), like)
    found = level.groupBy("alias", "category").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.min(F.struct("p", "n", "name")).alias("least"), F.max("like").alias("like"))
    alone = F.when(F.col("least.n") == 1, F.col("least.name"))
    return found.select("alias", "category", "n", F.when(F.col("n") == 1, F.col("least.name")).alias("one"), F.when(F.col("known") > 0, alone).alias("winner"), F.col("like.canonical_name").alias("named"))


def disambiguated(mapped: DataFrame, items: DataFrame, rows: DataFrame) -> DataFrame:
    """Mapped (label once, canonical_name, ...) with names that exact aliases and the categories of a label's rows speak for, and resolved_by.

    A name of none of these categories gives way to the first category's only entry (category). Where a category has several
    entries, the one of least priority does (priority), or the one that is named most like the label (name), if it is another
    one; the first category that has such a one counts. What is unmapped takes the first category's only entry (rescued) or
    the one of least priority (rescued_priority), or the alias's only entry of all (rescued_global). Confidences stay.
    rows: of entries().
    """
    own = rows.groupBy("alias", "canonical_name").agg(F.min_by("category", "seq").alias("_own"))
    m = mapped.select("label", "canonical_name").withColumn("alias", text.folded(F.col("label")))
    m = m.join(_total(rows), "alias").join(own, ["alias", "canonical_name"], "left")
    met = m.join(contexts(items), "label").join(by_category(rows), ["alias", "category"])
    pick = lambda name, by: F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(by).alias("by")))
    other = lambda c: F.when(F.col(c) != F.col("canonical_name"), F.col(c))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("pos")))
    many = F.col("n") > 1
    chosen = met.groupBy("label").agg(
        F.coalesce(F.max(F.col("_own") == F.col("category")), F.lit(False)).alias("_fits"), first(pick(other("one"), "category")).alias("_single"),
        first(F.when(many, F.coalesce(pick(other("winner"), "priority"), pick(other("named"), "name")))).alias("_multi"),
        first(F.coalesce(pick(F.col("one"), "rescued"), F.when(many, pick(F.col("winner"), "rescued_priority")))).alias("_rescue"),
    )
    alone = F.when(F.col("_total") == 1, pick(F.col("_only"), "rescued_global"))
    choice = F.when(F.col("canonical_name") == UNMAPPED, F.coalesce("_rescue", alone)).otherwise(F.coalesce(F.when(~F.col("_fits"), F.col("_single")), F.col("_multi")))
    chosen = m.join(chosen, "label", "left").select("label", choice.alias("_choice"))
    return mapped.join(chosen, "label", "left").withColumns({"canonical_name": F.coalesce("_choice.name", "canonical_name"), "resolved_by": F.col("_choice.by")}).drop("_choice")


def rescued(mapped: DataFrame, items: DataFrame, rows: DataFrame, least: float = 80.0) -> DataFrame:
    """What is still unmapped by the most similar alias (label without numbering and units, token-sort ratio of least; ties to the smaller alias).

    The alias must have one entry in the label's first category; or none there (or no category) and one of all. Such a row
    gets the ratio as its confidence, to three digits, and method and resolved_by fuzzy_alias. Only unmapped labels are scored.
    rows: of entries().
    """
    plain = mapped.where(F.col("canonical_name") == UNMAPPED).select("label", text.folded(text.label(F.col("label"))).alias("text")).where("text <> ''")
    total = _total(rows)
    scores = fuzzy_scores(plain.select(F.col("text").alias("label")), total.select("alias"), least)
    best = scores.groupBy(F.col("label").alias("text")).agg(F.min_by(F.struct("alias", "score"), F.struct(-F.col("score"), F.col("alias"))).alias("best")).select("text", "best.*")
    category = contexts(items).groupBy("label").agg(F.min_by("category", "pos").alias("category"))
    found = plain.join(best, "text").join(category, "label", "left").join(by_category(rows).select("alias", "category", "n", "one"), ["alias", "category"], "left").join(total, "alias")
    name = F.when(F.col("n") == 1, F.col("one")).when(F.col("n").isNull() & (F.col("_total") == 1), F.col("_only"))
    found = found.select("label", name.alias("_name"), F.round(F.col("score") / 100, 3).alias("_score")).where("_name is not null")
    there = F.col("_name").isNotNull()
    take = lambda c, x: F.when(there, x).otherwise(F.col(c))
    changed = {"canonical_name": take("canonical_name", F.col("_name")), "confidence": take("confidence", F.col("_score")), "method": take("method", F.lit("fuzzy_alias")), "resolved_by": take("resolved_by", F.lit("fuzzy_alias"))}
    return mapped.join(found, "label", "left").withColumns(changed).drop("_name", "_score")


def _best(rows: DataFrame) -> DataFrame:
    """One row a label: the surest, of equals the first by name."""
    best = F.min_by(F.struct("canonical_name", F.col("confidence").cast("double").alias("confidence")), F.struct(-F.col("confidence"), F.col("canonical_name")))
    return rows.where("label is not null and canonical_name is not null and confidence is not null").groupBy("label").agg(best.alias("_best")).select("label", "_best.*")


def cascade(items: DataFrame, before: Sequence[tuple[str, Give, float]], mapper: Give, vocabulary: DataFrame, aliases: DataFrame, redirects: DataFrame, least: float | None = 80.0) -> DataFrame:
    """label, canonical_name, confidence, method, resolved_by, redirected_from, category of each label of items, once.

    before: stages that come before the mapper, in order, as method, what gives their rows, and the least confidence that
    counts. A stage is handed only labels that none before it knew (written down between stages, so none is scored twice),
    and what it says of others is ignored; the mapper gets the rest. N08: the mapper's names that vocabulary (canonical_name,
    category) lacks are unmapped with confidence 0, as are labels it says nothing of. Only the mapper's rows are
    disambiguated, and rescued by similarity unless least is None. J18: names that are deprecated (name, target) become their
    target in all rows, one hop. J11: category is unknown for names that vocabulary lacks. Labels of null have no row.

    Items, vocabulary and aliases are read once: what stays of the items is a row for each label, sheet and section.
    """
    items = settled(items.where("label is not null").groupBy("label", "sheet", "section_category").agg(F.min("seq").alias("seq")))
    rest, known = settled(items.select("label").distinct()), []
    for method, give, enough in before:
        rows = _best(give(rest).where(F.col("confidence") >= enough)).join(rest, "label", "left_semi")
        known.append(settled(rows.withColumn("method", F.lit(method))))
        rest = settled(rest.join(known[-1], "label", "left_anti"))
    names, known_as = settled(vocabulary.groupBy("canonical_name").agg(F.min("category").alias("category"))), settled(entries(aliases))
    said = rest.join(_best(mapper(rest)), "label", "left").join(names, "canonical_name", "left")
    valid = F.col("category").isNotNull() | (F.col("canonical_name") == UNMAPPED)
    said = said.select("label", F.when(valid, F.col("canonical_name")).otherwise(UNMAPPED).alias("canonical_name"), F.when(valid, F.col("confidence")).otherwise(0.0).alias("confidence"), F.lit("mapper").alias("method"))
    said = disambiguated(settled(said), items, known_as)
    if least is not None:
        said = rescued(settled(said), items, known_as, least)
    for rows in known:
        said = said.unionByName(rows.withColumn("resolved_by", F.lit(None).cast("string")))
    gone = redirects.where(F.col("name") != UNMAPPED).groupBy("name").agg(F.min("target").alias("target"))
    out = redirect(said.withColumn("_was", F.col("canonical_name")), gone).join(names, "canonical_name", "left")
    moved: Column = F.when(F.col("_was") != F.col("canonical_name"), F.col("_was"))
    return out.select("label", "canonical_name", "confidence", "method", "resolved_by", moved.alias("redirected_from"), F.coalesce("category", F.lit("unknown")).alias("category"))
