"""Checks of a taxonomy: one row for each finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import levels

#: Items that accounting identities need, and words of formulas that aren't items.
IDENTITIES = ["total_assets", "total_liabilities", "total_equity", "gross_profit", "ebit", "fcf"]
WORDS = ["and", "or", "not", "if", "else", "sum", "abs", "max", "min"]
REQUIRED = ["canonical_name", "category", "display_name", "aliases", "definition", "typical_sign"]


def findings(items: DataFrame, categories: Sequence[str], deepest: int = 4) -> DataFrame:
    """P: check, severity, canonical_name, detail. items: REQUIRED, parent_canonical, derivation, ocr_variants (array).

    Names that are there twice are found as such; for the other checks one of them, the least, counts.
    """
    none = F.array().cast("array<string>")

    def found(rows: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("canonical_name").alias("canonical_name"), detail.cast("string").alias("detail"))

    lacks = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])))
    missing = found(items.select("canonical_name", lacks.alias("_field")), "missing_field", "error", F.col("_field"))
    named = items.where("canonical_name is not null")
    twice = found(named.groupBy("canonical_name").count().where("count > 1"), "duplicate_name", "error", F.col("count"))
    one = named.groupBy("canonical_name").agg(F.min(F.struct("category", "display_name", "aliases", "parent_canonical", "derivation", "ocr_variants")).alias("x")).select("canonical_name", "x.*")
    wrong = found(one.where(~F.coalesce(F.col("category").isin(list(categories)), F.lit(False))), "invalid_category", "error", F.col("category"))
    above = one.select(F.col("canonical_name").alias("parent_canonical"), F.col("category").alias("_above"), F.lit(True).alias("_there"))
    parents = one.where("parent_canonical is not null").join(above, "parent_canonical", "left")
    orphans = found(parents.where("_there is null"), "orphaned_parent", "error", F.col("parent_canonical"))
    across = found(parents.where("_there and category <> _above"), "cross_category_parent", "warning", F.col("parent_canonical"))
    tree = levels(one.select(F.col("canonical_name").alias("node"), F.col("parent_canonical").alias("parent"))).withColumnRenamed("node", "canonical_name")
    circles = found(tree.where("level is null"), "circular_reference", "error", F.lit(None))
    deep = found(tree.where(F.col("level") > deepest), "hierarchy_depth", "warning", F.col("level"))
    alias = one.select("canonical_name", F.explode(F.coalesce("aliases", none)).alias("_alias")).select("canonical_name", F.lower("_alias").alias("_alias"))
    shared = alias.groupBy("_alias").agg(F.count("*").alias("_n"), F.min("canonical_name").alias("canonical_name")).where("_n > 1")
    aliases = found(shared, "duplicate_alias", "warning", F.col("_alias"))
    words = F.array_except(F.array_distinct(F.regexp_extract_all("derivation", F.lit(r"\b([a-z][a-z_]+)\b"), F.lit(1))), F.array(*map(F.lit, WORDS)))
    uses = one.select("canonical_name", F.explode(words).alias("_ref"))
    unknown = uses.join(one.select(F.col("canonical_name").alias("_ref")), "_ref", "left_anti")
    formulas = found(unknown, "derivation_reference", "warning", F.col("_ref"))
    same = one.select("canonical_name", "display_name", F.explode(F.coalesce("ocr_variants", none)).alias("_variant")).where("lower(_variant) = lower(display_name)")
    variants = found(same, "ocr_variant", "warning", F.col("_variant"))
    needed = items.sparkSession.createDataFrame([(n,) for n in IDENTITIES], "canonical_name string").join(one.select("canonical_name"), "canonical_name", "left_anti")
    out = missing
    for part in (twice, wrong, orphans, across, circles, deep, aliases, formulas, variants, found(needed, "identity_item", "warning", F.lit(None))):
        out = out.unionByName(part)
    return out


def distribution(items: DataFrame) -> DataFrame:
    """P: for each category items, those with a parent, with variants, and their variants."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    n = F.when(size("ocr_variants") > 0, size("ocr_variants")).otherwise(0)
    return items.groupBy("category").agg(F.count("*").alias("items"), F.count("parent_canonical").alias("with_parent"), F.count_if(n > 0).alias("with_variants"), F.sum(n).alias("variants"))
