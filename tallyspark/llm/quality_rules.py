"""Quality rules with thresholds that adapt to each language and source.

Statistics of a text are whole numbers. Their quantile sketch is a histogram over buckets of integers whose width is at
most 1/32 of their value: merging two sketches is adding their counts, so sketches are plain grouped counts, combined
before the shuffle, and don't depend on the order of rows. From the quartiles of a group come fences,
q3 + reach * (q3 - q1) + slack and, for word length, q1 - reach * (q3 - q1) - slack. A group of less than min_rows texts
takes the fences of its language, and a language of less than min_rows those of all texts. The rows are joined with
their group's fences and stay if every statistic is within.

Null and empty texts have no words and fail the base rules. Rows of a null language or source form groups of their own.
Repeated rows count each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, as_text, slices, stash
from .stats import BLANK, SYMBOLS, repeated_lines, repeated_words, words_of

#: Statistic: (numerator, factor, slack, has a lower fence). Each is numerator * factor div n_words.
RULES = {
    "symbols": ("n_symbols", 10_000, 1_000, False),
    "dup_lines": ("n_dup_lines", 10_000, 200, False),
    "repeats": ("n_repeat_words", 10_000, 1_500, False),
    "word_length": ("word_chars", 100, 300, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, doc_id: str, text: str, by: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_text(batch)
            raw = [x.encode() for x in texts]
            words = words_of(raw)
            cols = {k: (batch.column(k), None) for k in ("doc_id", "lang", "source")}
            values = (
                [len(x) for x in words],
                [len(x) - sum(map(b.count, map(bytes, zip(BLANK)))) for x, b in zip(texts, raw)],
                [sum(map(b.count, map(bytes, zip(SYMBOLS)))) for b in raw],
                [repeated_lines(b)[1] for b in raw],
                repeated_words(words),
            )
            yield arrow(cols | {k: (np.asarray(v, np.int64), pa.int64()) for k, v in zip(COUNTS, values)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(by[0]).cast("string").alias("lang"), F.col(by[1]).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{x} long" for x in COUNTS))


def bucket(x: Column) -> Column:
    """Bucket of a whole number: itself below 64; above, its five leading bits after the first and its length."""
    extra = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (extra * 32 + F.call_function("shiftright", x, extra)).cast("int")


def least_in(b: Column) -> Column:
    """The least number of a bucket."""
    extra = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - extra * 32).cast("long"), extra)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, stat, bucket, n over rows that pass the base rules."""
    stats = F.array(*[F.struct(F.lit(k).alias("stat"), bucket(F.expr(f"{top} * {f} div n_words")).alias("bucket")) for k, (top, f, _, _) in RULES.items()])
    return rows.where("not base_failed").select("lang", "source", F.inline(stats)).groupBy("lang", "source", "stat", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q1, q3 and n of each group and statistic from merged sketches."""
    merged = sketch.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "stat")
    upto = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: least_in(F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bucket"))))
    return upto.groupBy(*keys, "stat").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("rows"))


def fences(sketch: DataFrame, reach: int, min_rows: int) -> DataFrame:
    """A row for each lang and source: low_<stat> and high_<stat>."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("of"), F.col("stat").alias("of_stat"), F.struct("q1", "q3").alias("lang_q"), F.col("rows").alias("lang_rows"))
    every = quartiles(sketch, []).select("stat", F.struct("q1", "q3").alias("every_q"))
    group = own.join(lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("stat") == F.col("of_stat"))).select("lang", "source", "stat", "rows", F.struct("q1", "q3").alias("own_q"), "lang_q", "lang_rows").join(every, "stat")
    q = F.when(F.col("rows") >= min_rows, F.col("own_q")).when(F.col("lang_rows") >= min_rows, F.col("lang_q")).otherwise(F.col("every_q"))
    chosen = group.withColumn("q", q).withColumn("spread", (F.col("q.q3") - F.col("q.q1")) * reach)
    cols = []
    for k, (_, _, slack, lower) in RULES.items():
        own_stat = F.col("stat") == k
        cols.append(F.max(F.when(own_stat, F.col("q.q3") + F.col("spread") + slack)).alias(f"high_{k}"))
        if lower:
            cols.append(F.max(F.when(own_stat, F.col("q.q1") - F.col("spread") - slack)).alias(f"low_{k}"))
    return chosen.groupBy("lang", "source").agg(*cols)


def adaptive_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"), reach: int = 3, min_rows: int = 200) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the statistic that failed first (null if none)."""
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    rows = stash(counts(docs, doc_id, text, by).withColumn("base_failed", failed), "counts")
    limits = fences(sketches(rows), reach, min_rows).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"high_{k}" for k in RULES], *[f"low_{k}" for k, r in RULES.items() if r[3]])
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = F.when(F.col("base_failed"), "base")
    for k, (top, f, _, lower) in RULES.items():
        value = F.expr(f"{top} * {f} div n_words")
        out = out.when(value > F.col(f"high_{k}"), k)
        if lower:
            out = out.when(value < F.col(f"low_{k}"), k)
    return joined.withColumn("failed_rule", out).select("doc_id", *COUNTS, "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")
