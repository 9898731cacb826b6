"""Results of jobs as JSON text, read only where they are asked for, and gold standards made of them, written and read.

Texts are parsed to VARIANT, so that values of any kind may stand under a period. A text that isn't JSON, has a key twice in one
object, or lacks a list of items has no items. Names that are null, empty or unmapped are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances of a gold value, and the coverage asked of each statement and of all.
TOLERANCE_PCT, TOLERANCE_ABS, STATEMENT_PCT, TOTAL_PCT = 1.0, 0.5, 80.0, 75.0
#: What a gold row says of its cell, with what holds if the result doesn't say it.
PARSING = {"is_bold": False, "is_formula": False, "is_subtotal": False, "hierarchy_level": 0}
UNMAPPED = "unmapped"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
VALUES = "map<string,variant>"
#: What is read of an item; names that count for none.
ITEM = f"struct<canonical_name:string,sheet:string,original_label:string,values:{VALUES},provenance:struct<parsing:{VALUES}>>"
NAMELESS = ("", UNMAPPED)
GOLD = (
    "expected_mappings array<struct<n:long,sheet:string,original_label:string,canonical_name:string>>, expected_values map<string,map<string,struct<value:double,tolerance_pct:double,tolerance_abs:double>>>, "
    "expected_parsing array<struct<pos:int,canonical_name:string,sheet:string,original_label:string,is_bold:boolean,is_formula:boolean,is_subtotal:boolean,hierarchy_level:int>>"
)


def _number(value: Column, texts: bool) -> Column:
    """A value as a double: numbers and truth values, and texts that hold a plain number if texts counts; null otherwise."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    written = F.when(text.rlike(NUMBER), F.trim(F.regexp_replace(text, r"\s+", "")).try_cast("double"))
    plain = F.try_variant_get(value, "$", "double")
    return F.when(kind == "STRING", written if texts else None).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), plain)


def newest(jobs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest completed jobs of each entity that have a result, with their rank from 1, of equal times the larger id first.

    jobs: entity_id, job_id, status, created_at, result. Ranks are cut in each task before rows move, and before any text is parsed."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.where("status = 'completed' and result is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _listed(rows: DataFrame, keys: Sequence[str], sampled: bool) -> DataFrame:
    """keys and _listed, the items of a result, each read as an ITEM in one go; if sampled, a list of sampled items goes before the list of all. What isn't of its field's kind is null."""
    lists = (["sample_line_items"] if sampled else []) + ["line_items"]
    doc = F.try_variant_get(F.try_parse_json("result"), "$", f"struct<{', '.join(f'{c}:array<{ITEM}>' for c in lists)}>")
    return rows.select(*keys, doc.alias("_doc")).select(*keys, F.coalesce(*[F.col(f"_doc.{c}") for c in lists]).alias("_listed"))


def _exploded(rows: DataFrame, keys: Sequence[str], listed: Column, *names: str) -> DataFrame:
    """keys, pos and an array's elements, or a map's keys and values, as names.

    Spark filters what it explodes by size and null first, and works out a text's parse anew for both; by the outer form it
    does so once, and the row that an empty one gets has no place."""
    return rows.select(*keys, F.posexplode_outer(listed).alias("pos", *names)).where("pos is not null")


def line_items(rows: DataFrame, keys: Sequence[str], sampled: bool = False) -> DataFrame:
    """keys, pos and canonical_name of the named items of each result, and item, what ITEM reads of it. If sampled, a list of sampled items goes before the list of all."""
    return _exploded(_listed(rows, keys, sampled), keys, F.col("_listed"), "item").withColumn("canonical_name", F.col("item.canonical_name")).where(f"canonical_name not in {NAMELESS}")


def financials(jobs: DataFrame, taxonomy: DataFrame, names: Sequence[str] | None = None, keep: int = 5) -> DataFrame:
    """entity_id, canonical_name, category (null if the taxonomy lacks it), period, value: of each name and period the first value that is a
    number, newest job first, then in the order of items. taxonomy: canonical_name, category."""
    items = line_items(newest(jobs, keep), ["entity_id", "rank"])
    items = items.where(F.col("canonical_name").isin(*names)) if names else items
    values = items.select("entity_id", "rank", "pos", "canonical_name", F.explode("item.values").alias("period", "_value"))
    values = values.withColumn("_value", _number(F.col("_value"), texts=True)).where("_value is not null")
    first = values.groupBy("entity_id", "canonical_name", "period").agg(F.min_by("_value", F.struct("rank", "pos")).alias("value"))
    known = taxonomy.groupBy("canonical_name").agg(F.min("category").alias("category"))
    return first.join(known, "canonical_name", "left").select("entity_id", "canonical_name", "category", "period", "value")


def gold_rows(results: DataFrame) -> DataFrame:
    """File, expected_values (by name and period) and expected_parsing of each result, made in its row, so that nothing moves. results: file (once each), result.

    The last item of a name that has values gives all of them; only numbers count, texts never. Items that say how they were
    parsed have a row of it, in their order. Names or lists without any are empty.
    """
    listed = _listed(results, ["file"], sampled=True)
    named = lambda x: ~x["canonical_name"].isin(*NAMELESS)
    places = F.sort_array(F.filter(F.transform("_listed", lambda x, i: F.when(named(x) & (F.size(x["values"]) > 0), F.struct(x["canonical_name"].alias("name"), i.alias("pos")))), lambda x: x.isNotNull()))
    # a name's last place is the one before another name's
    last = F.filter("_places", lambda x, i: F.coalesce(F.get("_places", i + 1)["name"] != x["name"], F.lit(True)))
    value = lambda v: F.struct(v.alias("value"), F.lit(TOLERANCE_PCT).alias("tolerance_pct"), F.greatest(F.abs(v) * 0.01, F.lit(TOLERANCE_ABS)).alias("tolerance_abs"))
    numbers = lambda x: F.map_filter(F.transform_values(F.get("_listed", x["pos"])["values"], lambda _, v: _number(v, texts=False)), lambda _, v: v.isNotNull())
    periods = F.filter(F.transform("_last", lambda x: F.struct(x["name"].alias("name"), numbers(x).alias("numbers"))), lambda x: F.size(x["numbers"]) > 0)
    values = F.map_from_entries(F.transform(periods, lambda x: F.struct(x["name"], F.transform_values(x["numbers"], lambda _, v: value(v)))))
    of = lambda x, c, d: F.coalesce(F.try_variant_get(x["provenance"]["parsing"][c], "$", "int" if c == "hierarchy_level" else "boolean"), F.lit(d)).alias(c)
    told = lambda x, i: F.when(named(x) & (F.size(x["provenance"]["parsing"]) > 0), F.struct(i.alias("pos"), x["canonical_name"].alias("canonical_name"), *[F.coalesce(x[c], F.lit("")).alias(c) for c in ("sheet", "original_label")], *[of(x, c, d) for c, d in PARSING.items()]))
    parsing = F.filter(F.transform("_listed", told), lambda x: x.isNotNull())
    return listed.withColumn("_places", places).withColumn("_last", last).select("file", values.alias("expected_values"), parsing.alias("expected_parsing"))


def gold_values(results: DataFrame) -> DataFrame:
    """File, canonical_name, period, value, tolerance_pct, tolerance_abs. results: file (once each), result."""
    return _values(gold_rows(results), F.col("expected_values"))


def gold_parsing(results: DataFrame) -> DataFrame:
    """File, pos, canonical_name, sheet, original_label and PARSING of the items that say how they were parsed."""
    return _exploded(gold_rows(results), ["file"], F.col("expected_parsing"), "_p").select("file", "_p.*")


def _values(rows: DataFrame, listed: Column) -> DataFrame:
    names = _exploded(rows, ["file"], listed, "canonical_name", "_periods")
    return _exploded(names, ["file", "canonical_name"], F.col("_periods"), "period", "_v").select("file", "canonical_name", "period", "_v.*")


def gold_completeness(mappings: DataFrame) -> DataFrame:
    """File, sheet (null: the whole file), min_items, min_coverage_pct. mappings: file, n, sheet (null: Unknown), original_label, canonical_name."""
    sets = mappings.select("file", F.coalesce("sheet", F.lit("Unknown")).alias("sheet")).groupingSets([["file"], ["file", "sheet"]], "file", "sheet").agg(F.count("*").alias("min_items"))
    return sets.withColumn("min_coverage_pct", F.when(F.col("sheet").isNull(), TOTAL_PCT).otherwise(STATEMENT_PCT))


def _documents(mappings: DataFrame, *told: DataFrame) -> DataFrame:
    """file and document of each file that has mappings. told: by file, what else goes in."""
    rows = mappings.groupBy("file").agg(_sorted_rows("n", "sheet", "original_label", "canonical_name").alias("expected_mappings"))
    for df in told:
        rows = rows.join(df, "file", "left")
    return rows.select("file", F.to_json(F.struct("expected_mappings", "expected_values", "expected_parsing")).alias("document"))


def _sorted_rows(*columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


def gold_documents(mappings: DataFrame, values: DataFrame, parsing: DataFrame) -> DataFrame:
    """File and document, the gold standard of each file that has mappings as one JSON text, ready to be written. A file's rows meet in one row, so they are as many as a workbook has."""
    by_name = values.groupBy("file", "canonical_name").agg(F.map_from_entries(F.collect_list(F.struct("period", F.struct("value", "tolerance_pct", "tolerance_abs")))).alias("_periods"))
    v = by_name.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("canonical_name", "_periods"))).alias("expected_values"))
    return _documents(mappings, v, parsing.groupBy("file").agg(_sorted_rows("pos", "canonical_name", "sheet", "original_label", *PARSING).alias("expected_parsing")))


def gold_written(mappings: DataFrame, results: DataFrame) -> DataFrame:
    """The same documents straight from results (file once each, result): each is parsed once, and goes to its file's mappings as one row."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return _documents(mappings, gold_rows(results).select("file", full("expected_values"), full("expected_parsing")))


def gold_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mappings, values and parsing of gold documents (file, document), as they went in; a document that isn't JSON has none."""
    gold = documents.select("file", F.from_json("document", GOLD).alias("g"))
    mappings, parsing = (_exploded(gold, ["file"], F.col(f"g.{c}"), "_row").select("file", "_row.*") for c in ("expected_mappings", "expected_parsing"))
    return mappings, _values(gold, F.col("g.expected_values")), parsing
