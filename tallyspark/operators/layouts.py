"""Where a sheet has its periods: in one row, in one under a row of keywords, as numbers, or down the first column; and whether sheets agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..sources.store import settled

#: Keywords of a row above the periods, with what they put before a text below them.
KEYWORDS = {
    "year": "", "period": "", "date": "", "fy": "FY", "cy": "CY", "fiscal year": "FY", "calendar year": "CY", "construction": "Construction Year ", "operations": "Operations Year ",
    "ops": "Operations Year ", "const": "Construction Year ", "const.": "Construction Year ", "development": "",
}
#: Rows below a sheet's first that may be headers; periods of a row, of its cells that share; numbers of a row; periods of a column.
SCAN, LEAST, SHARE, LEAST_NUMBERS, LEAST_DOWN = 8, 2, 0.4, 3, 3
#: Below this confidence other ways are tried; factors of numbers and of columns; confidence in a period under a keyword.
ENOUGH, NUMBERS, DOWN, UNDER = 0.3, 0.7, 0.8, 0.8
#: Kinds of project finance, which go together.
PROJECT = ["relative", "phase", "cod", "stub"]


def candidates(cells: DataFrame) -> DataFrame:
    """Each cell with what it is in each way to read its sheet: sheet, way, at (the row, 0 for the column), top (the keyword's row), place, row_index, c, raw and the period p, null if it is none.

    cells: sheet, row_index, c (from 1), value, is_number. Ways: under (a row of keywords), across, numbers, down. Blank cells aren't there.
    """
    rows = cells.groupBy("sheet", "row_index").agg(F.min_by(F.lower(F.trim("value")), F.when(~F.col("is_number") & F.lower(F.trim("value")).isin(list(KEYWORDS)), F.col("c"))).alias("keyword"))
    sizes = rows.groupBy("sheet").agg(F.min("row_index").alias("first"), F.count("*").alias("n_rows"))
    prefix = F.create_map(*[F.lit(x) for pair in KEYWORDS.items() for x in pair])
    above = Window.partitionBy("sheet").orderBy("row_index")
    heads = rows.join(sizes, "sheet").where(F.col("row_index") <= F.col("first") + SCAN).select("sheet", "row_index", F.lag("row_index").over(above).alias("top"), F.try_element_at(prefix, F.lag("keyword").over(above)).alias("prefix"))
    there = cells.where(F.length(F.trim("value")) > 0).select("sheet", "row_index", "c", F.trim("value").alias("raw"), "is_number")
    told = there.join(sizes, "sheet").join(heads, ["sheet", "row_index"], "left").where((F.col("row_index") <= F.col("first") + SCAN) | (F.col("c") == 1))
    plain = periods.normalize(F.col("raw"))
    told = told.withColumn("p", plain).withColumn("q", F.when(~F.col("is_number") & (F.col("prefix") != ""), periods.normalize(F.concat("prefix", "raw"))))
    n = F.regexp_extract("raw", r"^(\d{1,3})(?:\.0)?$", 1).try_cast("int")
    none, kind = F.lit(None), plain_type(told)
    number = F.when(n <= 100, F.struct(F.concat(F.lit("P"), n.cast("string")).alias("normalized"), F.lit("numeric").alias("kind"), none.cast("int").alias("year"), n.alias("sub"), F.lit(False).alias("is_actual"), F.lit(False).alias("is_forecast"), F.lit(NUMBERS).alias("confidence")))
    sure = lambda p: F.when(p.isNotNull(), p.withField("confidence", F.lit(UNDER)))
    way = lambda name, at, top, place, raw, p, if_: F.when(if_, F.struct(F.lit(name).alias("way"), at.cast("int").alias("at"), top.cast("int").alias("top"), place.cast("int").alias("place"), raw.alias("raw"), p.cast(kind).alias("p")))
    head, row = F.col("row_index") <= F.col("first") + SCAN, F.col("row_index")
    ways = F.array(
        way("under", row, F.col("top"), F.col("c"), F.when(F.col("q").isNotNull(), F.concat("prefix", F.lit(" "), "raw")).otherwise(F.col("raw")), sure(F.coalesce("q", "p")), F.col("prefix").isNotNull()),
        way("across", row, none, F.col("c"), F.col("raw"), F.col("p"), head),
        way("numbers", row, none, F.col("c"), F.col("raw"), number, head),
        way("down", F.lit(0), none, row, F.col("raw"), F.col("p"), F.col("c") == 1),
    )
    return told.select("sheet", "n_rows", "row_index", "c", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("x")).select("sheet", "n_rows", "row_index", "c", "x.*")


def plain_type(df: DataFrame) -> str:
    return df.schema["p"].dataType.simpleString()


def chosen(found: DataFrame) -> DataFrame:
    """sheet, way, at, top, n, dominant, confidence: the best way to read each sheet. found: candidates.

    All ways of all sheets are one grouped pass. The first row under keywords that holds enough periods counts, and any row
    that is better; without one, rows of numbers; if these are unsure, the first column. Ties go to keywords, then up. The
    dominant kind is that of most periods, of equals the first met. Sheets without periods have no row.
    """
    keys = ["sheet", "way", "at"]
    by = found.groupBy(*keys, F.col("p.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("top").alias("top"), F.max("n_rows").alias("n_rows"), F.min("p.sub").alias("least"), F.max("p.sub").alias("most"), F.count_distinct("p.sub").alias("different"))
    there = F.col("kind").isNotNull()
    rows = by.groupBy(*keys).agg(
        F.sum("n").alias("filled"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n"), F.count_if(there).alias("kinds"), F.min_by("kind", F.when(there, F.struct(-F.col("n"), F.col("first")))).alias("dominant"), F.max("top").alias("top"), F.max("n_rows").alias("n_rows"),
        F.max(F.when(there, F.col("most") - F.col("least") + 1)).alias("span"), F.max(F.when(there, F.col("different"))).alias("different"),
    )
    ratio = F.col("n").cast("double") / F.when(F.col("way") == "down", F.col("n_rows")).otherwise(F.col("filled"))
    bonus = F.when(F.col("kinds") == 1, 1.0).when(F.col("kinds") == 2, 0.9).otherwise(0.8)
    consecutive = (F.col("span") == F.col("n")) & (F.col("different") == F.col("n"))
    fits = F.when(F.col("way") == "down", F.col("n") >= LEAST_DOWN).when(F.col("way") == "numbers", (F.col("n") >= LEAST_NUMBERS) & consecutive & (ratio >= SHARE)).otherwise((F.col("n") >= LEAST) & (ratio >= SHARE))
    trust = F.when(F.col("way") == "down", F.least(ratio, F.lit(1.0)) * bonus * DOWN).when(F.col("way") == "numbers", NUMBERS * ratio).otherwise(ratio * bonus)
    rows = rows.where(fits).withColumn("confidence", F.round(trust, 4))
    first_under = rows.where("way = 'under'").groupBy("sheet").agg(F.min("at").alias("under_at"))
    rows = rows.join(first_under, "sheet", "left").where("way <> 'under' or at = under_at")
    order = F.when(F.col("way") == "under", 0).when(F.col("way") == "across", 1).when(F.col("way") == "numbers", 2).otherwise(3)
    tier = F.when(order < 2, 0).when((order == 2) & (F.col("confidence") >= ENOUGH), 1).otherwise(2)
    best = F.struct("way", "at", "top", "n", "dominant", "confidence")
    return rows.groupBy("sheet").agg(F.min_by(best, F.struct(tier, -F.col("confidence"), order, F.col("at"))).alias("b")).select("sheet", "b.*")


def period_layouts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A: of each sheet with periods its layout, header rows, dominant kind and confidence; and its periods in the order of time, with their cells."""
    found = settled(candidates(cells))
    best = settled(chosen(found))
    kept = found.join(best.select("sheet", "way", "at"), ["sheet", "way", "at"], "left_semi").where("p is not null")
    key = F.when(F.col("way") == "numbers", F.struct(F.lit(0).alias("unknown"), F.lit(0).alias("family"), F.lit(0).alias("year"), F.lit(0).alias("grain"), F.col("p.sub").cast("double").alias("part"), F.lit(1).alias("forecast"), F.col("raw").alias("raw"))).otherwise(periods.sort_key(F.col("raw"), F.col("p")))
    place = F.row_number().over(Window.partitionBy("sheet").orderBy(key, "place"))
    listed = kept.select("sheet", "row_index", "c", place.alias("place"), "raw", "p.normalized", "p.kind", "p.year", "p.sub", "p.confidence")
    down = kept.where("way = 'down'").groupBy("sheet").agg(F.array_join(F.array_sort(F.collect_set("row_index")), "|").alias("down"))
    layout = F.when(F.col("way") == "down", "time_down_rows").otherwise("time_across_columns")
    heads = F.coalesce("down", F.concat_ws("|", "top", "at"))
    return best.join(down, "sheet", "left").select("sheet", layout.alias("layout"), heads.alias("header_rows"), F.col("n").alias("periods"), "dominant", "confidence"), listed


def consistency(layouts: DataFrame, listed: DataFrame) -> DataFrame:
    """A: warnings of books with several sheets that have periods: book, type, severity, sheet (of a gap), details. layouts: also book; listed: book, sheet, year."""
    family = F.when(F.col("dominant").isin(PROJECT), "project").otherwise(F.col("dominant"))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", c))), lambda x: F.concat(x["sheet"].cast("string"), F.lit("="), x[c])), ", ")
    books = layouts.groupBy("book").agg(F.count("*").alias("sheets"), F.count_distinct(family).alias("families"), F.count_distinct("layout").alias("ways"), told("dominant").alias("kinds"), told("layout").alias("layouts")).where("sheets >= 2")
    none = F.lit(None).cast(layouts.schema["sheet"].dataType)
    kinds = books.where("families > 1").select("book", F.lit("mismatched_period_type").alias("type"), F.lit("warning").alias("severity"), none.alias("sheet"), F.col("kinds").alias("details"))
    ways = books.where("ways > 1").select("book", F.lit("layout_inconsistency").alias("type"), F.lit("info").alias("severity"), none.alias("sheet"), F.col("layouts").alias("details"))
    years = listed.where("year is not null").select("book", "sheet", "year").distinct()
    every, sheets = years.select("book", "year").distinct(), years.select("book", "sheet").distinct()
    missing = sheets.join(every, "book").join(years, ["book", "sheet", "year"], "left_anti").groupBy("book", "sheet").agg(F.array_join(F.array_sort(F.collect_list("year")), ", ").alias("details"))
    gaps = missing.join(books.select("book"), "book").select("book", F.lit("period_coverage_gap").alias("type"), F.lit("info").alias("severity"), "sheet", "details")
    return kinds.unionByName(gaps).unionByName(ways)
