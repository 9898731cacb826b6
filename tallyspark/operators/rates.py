"""Exchange rates: each amount by the rate that holds on its day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.roles import double


def convert(rows: DataFrame, rates: DataFrame, currency: str = "currency", day: str = "created_at", value: str = "value") -> DataFrame:
    """Rate and converted amount; null where no rate holds yet.

    rates: currency, day, rate. A rate holds until the next of its currency. Its span is listed by months, so the join is
    an equi-join on currency and month, and no window holds all rows of a currency.
    """
    r = rates.select(F.col("currency").alias("_c"), F.col("day").cast("date").alias("_from"), "rate")
    until = F.lead("_from").over(Window.partitionBy("_c").orderBy("_from"))
    last = rows.agg(F.max(day).cast("date").alias("_last"))
    spans = r.withColumn("_until", until).crossJoin(last).withColumn("_end", F.coalesce(F.date_sub("_until", 1), "_last")).where("_from <= _end")
    months = spans.withColumn("_m", F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_end", "month"), F.expr("interval 1 month")))).select("_c", "_m", "_from", "_end", "rate")
    at = F.col(day).cast("date")
    hit = (F.col(currency) == F.col("_c")) & (F.trunc(at, "month") == F.col("_m")) & at.between(F.col("_from"), F.col("_end"))
    return rows.join(months, hit, "left").drop("_c", "_m", "_from", "_end").withColumn("converted", double(F.col(value).cast("decimal(30,8)") * F.col("rate")))


def lookup(rows: DataFrame, cache: DataFrame, static: DataFrame, base: str = "base", quote: str = "quote", day: str = "day", value: str = "value") -> DataFrame:
    """Rate, its source and the converted amount: 1 within a currency, the cached rate of the day, the newest cached one of any age, the static one, or the inverse of the static one; null if there is none.

    cache: base, quote, day, rate; of a day's rates the largest. static: base, quote, rate: listed constants, so it is broadcast.
    """
    pair = (F.col(base) == F.col("_b")) & (F.col(quote) == F.col("_q"))
    known = cache.select(F.col("base").alias("_b"), F.col("quote").alias("_q"), F.col("day").cast("date").alias("_day"), "rate")
    exact = known.groupBy("_b", "_q", "_day").agg(F.max("rate").alias("_exact"))
    newest = known.groupBy("_b", "_q").agg(F.max_by("rate", F.struct("_day", "rate")).alias("_newest"))
    table = F.broadcast(static.select(F.col("base").alias("_b"), F.col("quote").alias("_q"), F.col("rate").alias("_static")))
    turned = F.broadcast(static.select(F.col("quote").alias("_b"), F.col("base").alias("_q"), F.round(1 / F.col("rate"), 8).alias("_inverse")))
    rows = rows.join(exact, pair & (F.col(day).cast("date") == F.col("_day")), "left").drop("_b", "_q", "_day")
    for other in (newest, table, turned):
        rows = rows.join(other, pair, "left").drop("_b", "_q")
    steps = [("same", F.when(F.col(base) == F.col(quote), 1.0)), ("exact", F.col("_exact")), ("newest", F.col("_newest")), ("static", F.col("_static")), ("inverse", F.col("_inverse"))]
    rate = F.coalesce(*[c for _, c in steps])
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in steps])
    rows = rows.withColumns({"rate": rate, "source": source}).drop("_exact", "_newest", "_static", "_inverse")
    return rows.withColumn("converted", double(F.col(value).cast("decimal(30,8)") * F.col("rate")))
