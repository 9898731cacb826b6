"""Operators on cell tables: merged ranges, regions, sections, context, headers, formulas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import periods, text


def spread_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """The top left value of each merged range in all its cells. merged: sheet, r1, c1, r2, c2; cells: sheet, r, c, value."""
    every = merged.select("sheet", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("r"), "c2").select("sheet", "r1", "c1", "r", F.explode(F.sequence("c1", "c2")).alias("c"))
    source = cells.select("sheet", F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("value").alias("_top"))
    filled = every.join(source, ["sheet", "r1", "c1"], "left").select("sheet", "r", "c", "_top", F.lit(True).alias("_in"))
    return cells.join(filled, ["sheet", "r", "c"], "full").select("sheet", "r", "c", F.coalesce("_top", "value").alias("value"), F.coalesce("_in", F.lit(False)).alias("is_merged"))


def islands(rows: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """Regions of rows without a gap of gap or more: keys, region, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    step = F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(0))
    marked = rows.withColumn("_step", step).withColumn("region", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "region").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def sections(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """A section begins after a gap of three rows, at a bold row after a gap of two, at a full-bold row, at a new fill, or at a keyword row without numbers."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.col(at) - F.lag(at).over(w)
    fill = F.col("fill").isNotNull() & ~F.col("fill").eqNullSafe(F.lag("fill").over(w))
    begins = (gap >= 3) | (F.col("bold") & (gap >= 2)) | F.col("full_bold") | fill | (F.col("keyword") & (F.col("numbers") == 0))
    marked = rows.withColumn("_b", F.coalesce(begins, F.lit(False)).cast("int")).withColumn("section", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "section").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.min_by("label", at).alias("title"))


def in_section(rows: DataFrame, found: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The section that holds each row (the last that starts at or before it and doesn't end before it), by one window over both: no theta join."""
    a = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_k"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast("struct<start:bigint,stop:bigint,title:string>").alias("_s"))
    b = found.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_k"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("title").cast("string").alias("title")).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_hit", F.last("_s", ignorenulls=True).over(w)).where("_row is not null")
    held = F.when(F.col("_hit.stop") >= F.col("_at"), F.col("_hit.title"))
    return out.select("_row.*", held.alias("section"))


def context(rows: DataFrame, keys: Sequence[str], at: str, label: str, level: str, reach: int = 3) -> DataFrame:
    """Labels of the rows up to reach before and after, and the nearest header (level 0) among those before."""
    w = Window.partitionBy(*keys).orderBy(at)
    around = F.array_join(F.collect_list(label).over(w.rowsBetween(-reach, reach)), "|")
    header = F.last(F.when(F.col(level) == 0, F.col(label)), ignorenulls=True).over(w.rowsBetween(-reach, -1))
    return rows.withColumns({"context": around, "header": header})


def label_column(cells: DataFrame) -> DataFrame:
    """The column with most text of each sheet: at least three texts and half of its cells; ties go left."""
    n = cells.groupBy("sheet", "c").agg(F.count("value").alias("n"), F.count_if(F.col("value").try_cast("double").isNull() & F.col("value").isNotNull()).alias("texts"))
    ok = n.where((F.col("texts") >= 3) & (F.col("texts") * 2 >= F.col("n")))
    return ok.groupBy("sheet").agg(F.max_by("c", F.struct("texts", -F.col("c"))).alias("label_column"))


def header_row(cells: DataFrame, is_period: Column, first: int = 20) -> DataFrame:
    """Of the first rows of each sheet, the one with most periods, two at least; ties go up."""
    n = cells.where(F.col("r") <= first).groupBy("sheet", "r").agg(F.count_if(is_period).alias("n")).where("n >= 2")
    return n.groupBy("sheet").agg(F.max_by("r", F.struct("n", -F.col("r"))).alias("header_row"))


def formula_summary(cells: DataFrame, samples: int = 5) -> DataFrame:
    """Formulas of each sheet, their references, and a few of them."""
    f = cells.where("formula is not null").withColumn("refs", text.references(F.col("formula")))
    ranked = f.withColumn("_n", F.row_number().over(Window.partitionBy("sheet").orderBy("r", "c")))
    return ranked.groupBy("sheet").agg(F.count("*").alias("formulas"), F.sum(F.size("refs")).alias("refs"), F.count_if(F.exists("refs", lambda x: x.contains("!"))).alias("cross_sheet"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.col("formula")))), " ; ").alias("samples"))


def range_sums(formulas: DataFrame, cells: DataFrame) -> DataFrame:
    """=SUM(a:b) and =-SUM(a:b) by exploding the range and joining its cells. formulas: sheet, r, c, formula."""
    p = r"^=(-?)SUM\(\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)\)$"
    g = lambda k: F.regexp_extract("formula", p, k)
    f = formulas.where(F.col("formula").rlike(p)).select("sheet", F.col("r").alias("fr"), F.col("c").alias("fc"), g(1).alias("sign"), text.column_number(g(2)).alias("c1"), g(3).cast("int").alias("r1"), text.column_number(g(4)).alias("c2"), g(5).cast("int").alias("r2"))
    each = f.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2")))
    return each.join(cells.select("sheet", "r", "c", "number"), ["sheet", "r", "c"], "left").groupBy("sheet", F.col("fr").alias("r"), F.col("fc").alias("c"), "sign").agg(F.sum("number").alias("total")).select("sheet", "r", "c", F.when(F.col("sign") == "-", -F.col("total")).otherwise(F.col("total")).alias("total"))


def evaluate(formula: str, values: dict[str, float]) -> float | None:
    """+ - * / ^ with brackets, SUM, MAX, MIN, AVERAGE over lists and ranges' cells, ABS, ROUND. None if anything else occurs."""
    import re

    tokens = re.findall(r"[A-Z]+\(|\$?[A-Z]{1,3}\$?\d+|\d+\.?\d*|[-+*/^(),:]|\S", formula.lstrip("=").upper())
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(x: str | None = None) -> str:
        nonlocal at
        t = peek()
        if t is None or (x is not None and t != x):
            raise ValueError(t)
        at += 1
        return t

    def ref(t: str) -> float:
        return values[t.replace("$", "")]

    def cells_between(a: str, b: str) -> list[float]:
        (c1, r1), (c2, r2) = (re.fullmatch(r"([A-Z]+)(\d+)", x.replace("$", "")).groups() for x in (a, b))
        num = lambda c: sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(c)))
        out = []
        for k, v in values.items():
            c, r = re.fullmatch(r"([A-Z]+)(\d+)", k).groups()
            if num(c1) <= num(c) <= num(c2) and int(r1) <= int(r) <= int(r2):
                out.append(v)
        return out

    def arguments() -> list[float]:
        out: list[float] = []
        while True:
            t = peek()
            if t and re.fullmatch(r"\$?[A-Z]{1,3}\$?\d+", t) and at + 1 < len(tokens) and tokens[at + 1] == ":":
                take()
                take(":")
                out += cells_between(t, take())
            else:
                out.append(total())
            if peek() == ",":
                take()
                continue
            take(")")
            return out

    def atom() -> float:
        t = take()
        if t == "-":
            return -atom()
        if t == "(":
            v = total()
            take(")")
            return v
        if t.endswith("("):
            args, name = arguments(), t[:-1]
            if name == "ROUND":
                return round(args[0], int(args[1]) if len(args) > 1 else 0)
            return {"SUM": sum, "MAX": max, "MIN": min, "AVERAGE": lambda x: sum(x) / len(x), "ABS": lambda x: abs(x[0])}[name](args)
        return ref(t) if t[0] in "$ABCDEFGHIJKLMNOPQRSTUVWXYZ" else float(t)

    def power() -> float:
        v = atom()
        if peek() == "^":
            take()
            return v ** power()
        return v

    def product() -> float:
        v = power()
        while peek() in ("*", "/"):
            v = v * power() if take() == "*" else v / power()
        return v

    def total() -> float:
        v = product()
        while peek() in ("+", "-"):
            v = v + product() if take() == "+" else v - product()
        return v

    try:
        v = total()
        return float(v) if at == len(tokens) else None
    except (KeyError, ValueError, ZeroDivisionError, IndexError, AttributeError, OverflowError):
        return None


@F.pandas_udf(DoubleType())
def formula_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """evaluate over columns: formula, and a map from reference to number of the cells it needs."""
    for f, v in batches:
        yield pd.Series([None if a is None else evaluate(a, dict(b or {})) for a, b in zip(f, v)], dtype="float64")


def header_rows(cells: DataFrame, least: int = 2, share: float = 0.4) -> DataFrame:
    """Rows (sheet, row_index) of which at least least cells, and this share of those with a value, are periods; the kind that most of them have (of equals the first by name), and the share, lowered if there are several kinds."""
    keys = ["sheet", "row_index"]
    filled = cells.where(F.length(F.trim("value")) > 0).withColumn("kind", periods.normalize(F.col("value"))["kind"])
    by = filled.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    there = F.col("kind").isNotNull()
    rows = by.groupBy(*keys).agg(F.sum("n").alias("filled"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("periods"), F.count_if(there).alias("kinds"), F.min_by("kind", F.when(there, F.struct(-F.col("n"), "kind"))).alias("dominant"))
    ratio = F.col("periods").cast("double") / F.col("filled")
    bonus = F.when(F.col("kinds") == 1, 1.0).when(F.col("kinds") == 2, 0.9).otherwise(0.8)
    return rows.where((F.col("periods") >= least) & (ratio >= share)).select(*keys, "periods", "dominant", F.round(ratio * bonus, 4).alias("confidence"))


def numeric_rows(cells: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """Rows whose numbers (whole, up to 100) are consecutive, at least least, and at least a share of the cells with a value."""
    n = F.regexp_extract(F.trim("value"), r"^(\d{1,3})(?:\.0)?$", 1).try_cast("int")
    rows = cells.where(F.length(F.trim("value")) > 0).select("sheet", "row_index", F.when(n <= 100, n).alias("n"))
    rows = rows.groupBy("sheet", "row_index").agg(F.count("*").alias("filled"), F.count("n").alias("numbers"), F.count_distinct("n").alias("different"), F.min("n").alias("first"), F.max("n").alias("last"))
    ratio = F.col("numbers").cast("double") / F.col("filled")
    consecutive = (F.col("numbers") == F.col("different")) & (F.col("last") - F.col("first") == F.col("numbers") - 1)
    return rows.where((F.col("numbers") >= least) & consecutive & (ratio >= share)).select("sheet", "row_index", "first", "last", F.round(F.lit(0.7) * ratio, 4).alias("confidence"))
