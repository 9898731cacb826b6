"""Rates, quantiles and first copies over event time; each function takes a stream or a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The time column as a timestamp with time zone, which watermarks need, and the watermark (no effect on a table)."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def rates(events: DataFrame, keys: list[str], at: str = "ts", length: str = "60 seconds", step: str | None = None) -> DataFrame:
    """ST1/ST2: events of each key in tumbling windows, or in sliding ones with a step; columns start, keys, n."""
    w = F.window(at, length, step) if step else F.window(at, length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def over_limit(events: DataFrame, keys: list[str], limit: int, at: str = "ts", length: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """ST1: windows in which a key has more events than the limit."""
    return rates(events, keys, at, length, step).where(F.col("n") > limit)


def quantiles(events: DataFrame, value: str, shares: list[float], at: str = "ts", length: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """ST2: approximate quantiles in tumbling windows, from mergeable sketches; columns start, n, q (array)."""
    w = F.window(at, length).alias("w")
    return events.groupBy(w).agg(F.count(value).alias("n"), F.percentile_approx(value, shares, accuracy).alias("q")).select(F.col("w.start").alias("start"), "n", "q")


def first_copies(files: DataFrame, content: Column, on_time: bool = True) -> DataFrame:
    """ST3: the first file of each content hash; on a stream, state is dropped with the watermark."""
    hashed = files.withColumn("content_hash", F.sha2(content, 256))
    return hashed.dropDuplicatesWithinWatermark(["content_hash"]) if hashed.isStreaming and on_time else hashed.dropDuplicates(["content_hash"])
