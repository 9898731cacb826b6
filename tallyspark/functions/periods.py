"""Period grammar: text to a normal form, its kind, flags, confidence and a key that sorts in time, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, whole or by three letters.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH = "(" + "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
#: Years of two to four digits, and the letters behind a period: actual, estimate, forecast, plan.
YEAR, FLAG, CENTURY = r"(\d{2,4})", r"\s*([aefp])?$", r"((?:19|20)\d{2})"


def year(text: Column) -> Column:
    """A year of two digits below 50 is in this century, else in the last; longer ones stay."""
    n = text.cast("int")
    return F.when(n >= 100, n).when(n < 50, n + 2000).otherwise(n + 1900)


def normalize(raw: Column) -> Column:
    """Struct of normalized, kind, year, sub, is_actual, is_forecast, confidence; null if the text is no period. The first form that fits counts."""
    # as a lambda the forms see the text cleaned once, and don't swell the generated code
    return F.transform(F.array(F.regexp_replace(F.lower(F.trim(raw)), "[’`]", "'")), _form)[0]


def _form(t: Column) -> Column:
    none, s = F.lit(None).cast("int"), lambda c: c.cast("string")
    two = lambda c: F.lpad(s(c), 2, "0")
    month = lambda x: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(x, 1, 3)).cast("int")
    out = None

    def add(pattern: str, kind: str, form, sub=None, at: int = 0, flag: int = 0, sure: float = 0.0, first=None) -> None:
        """at, flag: groups of the year and the flag; sure: confidence where no year's digits decide it; form gets groups, year, part and the flag in capitals."""
        nonlocal out
        g = lambda k: F.regexp_extract(t, pattern, k)
        y, p, f = year(g(at)) if at else first(g) if first else none, sub(g).cast("int") if sub else none, g(flag) if flag else F.lit("")
        trust = F.lit(sure) if sure else F.when(F.length(g(at)) == 2, 0.9).otherwise(1.0)
        row = F.struct(form(g, y, p, F.upper(f)).alias("normalized"), F.lit(kind).alias("kind"), y.alias("year"), p.alias("sub"), (f == "a").alias("is_actual"), f.isin("e", "f", "p").alias("is_forecast"), trust.alias("confidence"))
        out = (F if out is None else out).when(t.rlike(pattern), row)

    end = lambda g: F.when(g(2) == "", "").otherwise(F.concat(F.lit("/"), F.when(F.length(g(2)) <= 2, g(2)).otherwise(s(year(g(2))))))
    part = lambda mark: lambda g, y, p, f: F.concat(s(y), F.lit(f"-{mark}"), s(p))
    either = lambda g: F.concat(g(1), g(2))
    add(rf"^fy\s*'?{YEAR}(?:/{YEAR})?{FLAG}", "fiscal_year", lambda g, y, p, f: F.concat(F.lit("FY"), s(y), end(g), f), at=1, flag=3)
    add(rf"^fye\s+{MONTH}\s*[-/\s]?\s*'?{YEAR}{FLAG}", "fiscal_year_end", lambda g, y, p, f: F.concat(F.lit("FYE-"), s(y), F.lit("-"), two(p), f), lambda g: month(g(1)), at=2, flag=3)
    add(rf"^cy\s*'?{YEAR}{FLAG}", "calendar_year", lambda g, y, p, f: F.concat(F.lit("CY"), s(y), f), at=1, flag=2)
    add(r"^(ltm|ttm|ntm)(?:\s+.*)?$", "trailing", lambda g, y, p, f: F.upper(g(1)), sure=1.0)
    add(rf"^{CENTURY}\s*([aefp])$", "year", lambda g, y, p, f: F.concat(s(y), f), at=1, flag=2)
    add(rf"^q([1-4])\s*['\s]*{YEAR}{FLAG}", "quarter", part("Q"), lambda g: g(1), at=2, flag=3)
    add(rf"^{CENTURY}\s*q([1-4]){FLAG}", "quarter", part("Q"), lambda g: g(2), at=1, flag=3)
    for letter in "hs":
        add(rf"^(?:([12]){letter}|{letter}([12]))\s*['\s]*{YEAR}{FLAG}", "half", part("H"), either, at=3, flag=4)
    add(rf"^{MONTH}\s*[-/\s]\s*'?{YEAR}$", "month", lambda g, y, p, f: F.concat(s(y), F.lit("-"), two(p)), lambda g: month(g(1)), at=2)
    add(rf"^{CENTURY}[/-](0[1-9]|1[0-2])$", "month", lambda g, y, p, f: F.concat(s(y), F.lit("-"), two(p)), lambda g: g(2), at=1)
    add(rf"^{CENTURY}(?:\.0)?$", "year", lambda g, y, p, f: s(y), at=1)
    later = lambda g: F.when(g(1).startswith("const"), 0).otherwise(1)
    add(r"^(construction|const\.?|operations|ops\.?)\s+(?:year|yr)\.?\s*(\d{1,3})$", "phase", lambda g, y, p, f: F.concat(F.when(y == 0, "Const").otherwise("Ops"), F.lit("-Year"), s(p)), lambda g: g(2), sure=0.9, first=later)
    add(rf"^(?:year|yr)\.?\s*(\d{{1,3}}){FLAG}", "relative", lambda g, y, p, f: F.concat(F.lit("Year"), s(p), f), lambda g: g(1), flag=2, sure=0.9)
    offset = lambda g: F.when(g(1).startswith("pre"), -999).when(g(1).startswith("post"), 999).when(g(2) == "", 0).otherwise(F.regexp_replace(g(2), " ", "").try_cast("int"))
    shown = lambda g, y, p, f: F.when(p == -999, "PreCOD").when(p == 999, "PostCOD").when(g(2) == "", "COD").otherwise(F.concat(F.lit("COD"), F.when(p >= 0, "+").otherwise(""), s(p)))
    add(r"^(pre[- ]?cod|post[- ]?cod|cod\s*([+-]\s*\d{1,3})?)$", "cod", shown, offset, sure=0.95)
    months = lambda g: F.coalesce(F.nullif(g(1), F.lit("")).try_cast("int"), F.lit(0))
    add(r"^(?:(\d+)\s*-?\s*(?:month|mo)\.?\s+)?stub(?:\s+period)?$|^short\s+period$", "stub", lambda g, y, p, f: F.when(p > 0, F.concat(F.lit("Stub-"), s(p), F.lit("M"))).otherwise("Stub"), months, sure=0.8)
    return out


def of_date(day: Column) -> Column:
    """The same struct for a date or time: the last and the first day of a year stand for the year, others for their month."""
    whole = ((F.month(day) == 12) & (F.dayofmonth(day) == 31)) | ((F.month(day) == 1) & (F.dayofmonth(day) == 1))
    y, m = F.year(day), F.when(~whole, F.month(day))
    text = F.when(whole, y.cast("string")).otherwise(F.date_format(day, "yyyy-MM"))
    return F.when(day.isNotNull(), F.struct(text.alias("normalized"), F.lit("date").alias("kind"), y.alias("year"), m.alias("sub"), F.lit(False).alias("is_actual"), F.lit(False).alias("is_forecast"), F.lit(1.0).alias("confidence")))


#: Families of kinds in the order of sorting (numbers are 0, dated kinds 1), and parts of a year behind whole years.
FAMILIES = {"relative": 2, "phase": 3, "cod": 4, "stub": 5, "trailing": 6}
GRAINS = {"half": 1, "quarter": 2, "month": 3}


def _among(kind: Column, places: dict[str, int], other: int) -> Column:
    out = F
    for name, place in places.items():
        out = out.when(kind == name, place)
    return out.otherwise(other)


def sort_key(raw: Column, parsed: Column) -> Column:
    """Numbers by value, then periods by family, year, grain and part, actuals before plain ones before forecasts, then all other text; ties by the text."""
    number, zero = raw.try_cast("double"), F.lit(0)
    bare = parsed.isNull() & number.isNotNull()
    return F.struct(
        (parsed.isNull() & number.isNull()).cast("int").alias("unknown"), F.when(bare, 0).otherwise(_among(parsed["kind"], FAMILIES, 1)).alias("family"), F.coalesce(parsed["year"], zero).alias("year"), F.when((parsed["kind"] == "date") & parsed["sub"].isNotNull(), 3).otherwise(_among(parsed["kind"], GRAINS, 0)).alias("grain"),
        F.when(bare, number).otherwise(F.coalesce(parsed["sub"], zero).cast("double")).alias("part"), F.when(parsed["is_actual"], 0).when(parsed["is_forecast"], 2).otherwise(1).alias("forecast"), raw.alias("raw"),
    )
