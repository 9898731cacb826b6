"""ST1: requests of each key admitted while fewer than allowed were in the time before, exactly, on tables and on streams.

A request at t is admitted if fewer than its key's allowed number were admitted in (t - length, t], among those before it by
time and id; refused ones don't count. No number, or none above 0, is no limit. Columns: keys, at, id (long), allowed (long,
the same for a key); out comes admitted. Requests without a time or id go.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def _walk(times: list[int], recent: deque, allowed: int | None, length: int) -> list[bool]:
    """Decisions on ordered times; recent holds the latest admitted ones, as many as allowed at most, and goes on."""
    out = []
    for t in times:
        good = not allowed or allowed <= 0 or len(recent) < allowed or recent[0] <= t - length
        if good and allowed and allowed > 0:
            if len(recent) >= allowed:
                recent.popleft()
            recent.append(t)
        out.append(good)
    return out


def limited(requests: DataFrame, keys: list[str], at: str = "ts", id: str = "id", allowed: str = "allowed", length: int = MINUTE) -> DataFrame:
    """A table's requests with admitted; length in microseconds.

    Counts of each key in spans of length decide most: where a span and the one before it hold no more than allowed together,
    all of the span is admitted. Only runs of other spans are walked, each from the span before it, all of which was admitted,
    and so told from what came earlier; they are dealt out by run, so a hot key is in one task only as long as it is
    over its limit without a break, and read as a stream there, so memory goes with allowed and not with a run's requests.
    """
    rows = requests.where(F.col(at).isNotNull() & F.col(id).isNotNull()).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_span", F.floor(F.col("_t") / F.lit(length)))
    own = [F.col(k).eqNullSafe(F.col(f"_{i}_")) for i, k in enumerate(keys)]
    spans = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n"), F.max(allowed).alias("_allowed"))
    by = Window.partitionBy(*keys).orderBy("_span")
    follows = F.lag("_span").over(by) == F.col("_span") - 1
    spans = spans.withColumn("_full", F.coalesce((F.col("_allowed") > 0) & (F.col("_n") + F.when(follows, F.lag("_n").over(by)).otherwise(0) > F.col("_allowed")), F.lit(False)))
    starts = F.col("_full") & ~F.coalesce(follows & F.lag("_full").over(by), F.lit(False))
    spans = spans.withColumn("_run", F.max(F.when(starts, F.col("_span"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    leads = (F.lead("_span").over(by) == F.col("_span") + 1) & F.lead("_full").over(by) & ~F.col("_full")
    spans = spans.withColumn("_leads", F.coalesce(leads, F.lit(False))).select(*[F.col(k).alias(f"_{i}_") for i, k in enumerate(keys)], F.col("_span").alias("_s"), "_full", "_run", "_leads")
    on = F.col("_span") == F.col("_s")
    for same in own:
        on = on & same
    placed = rows.join(spans, on).drop("_s", *[f"_{i}_" for i in range(len(keys))])
    # a span that leads a run in is there once for its requests and once for what the run has to know
    roles = F.when(F.col("_leads"), F.array(F.lit(0), F.lit(1))).when(F.col("_full"), F.array(F.lit(2))).otherwise(F.array(F.lit(0)))
    placed = placed.withColumn("_role", F.explode(roles)).withColumn("_run", F.when(F.col("_role") == 1, F.col("_span") + 1).when(F.col("_role") == 2, F.col("_run")))
    plain = placed.where("_role = 0").select(*requests.columns, F.lit(True).alias("admitted"))
    walked = placed.where("_role > 0").repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_t", id)
    columns = requests.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, recent = None, deque()
        for batch in batches:
            heads = list(zip(*[batch[k] for k in keys], batch["_run"]))
            heads = [tuple(None if pd.isna(x) else x for x in h) for h in heads]
            times, limits, good, start = batch["_t"].tolist(), batch[allowed].tolist(), [], 0
            while start < len(heads):
                stop = start
                while stop < len(heads) and heads[stop] == heads[start]:
                    stop += 1
                if heads[start] != run:
                    run, recent = heads[start], deque()
                good += _walk(times[start:stop], recent, int(limits[start]), length)
                start = stop
            yield batch.assign(admitted=good).loc[batch["_role"] == 2, [*columns, "admitted"]]

    schema = requests.withColumn("admitted", F.lit(True)).schema
    return plain.unionByName(walked.mapInPandas(walk, schema))


def limited_stream(requests: DataFrame, keys: list[str], at: str = "ts", id: str = "id", allowed: str = "allowed", length: int = MINUTE, late: str = "1 minute") -> DataFrame:
    """A stream's requests (keys, at, id, admitted) in append mode: each decided once the watermark has passed it, so that their order is known.

    State of a key: its latest admitted times, as many as allowed and not older than length, and what waits for the watermark;
    a timer decides what waits when no more requests come, and drops the state when it can't matter any more. Requests that
    come later than the watermark go.
    """
    rows = requests.where(F.col(at).isNotNull() & F.col(id).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = rows.select(*keys, at, F.col(id).cast("long").alias("_id"), F.unix_micros(at).alias("_t"), F.coalesce(F.col(allowed).cast("long"), F.lit(0)).alias("_allowed"))

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        recent, waits, most = ([], [], 0) if not state.exists else state.get
        waits = [tuple(w) for w in waits]
        for batch in batches:
            waits += zip(batch["_t"].tolist(), batch["_id"].tolist())
            most = int(batch["_allowed"].iloc[0]) if len(batch) else most
        passed = state.getCurrentWatermarkMs()
        ready = sorted(w for w in waits if w[0] <= passed * 1000)
        waits = sorted(w for w in waits if w[0] > passed * 1000)
        recent = deque(recent)
        good = _walk([t for t, _ in ready], recent, most, length)
        recent = [t for t in recent if t > passed * 1000 - length]
        if waits or recent:
            state.update((recent, waits, most))
            state.setTimeoutTimestamp(max(passed + 1, (waits[0][0] if waits else recent[-1] + length) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({**{k: [v] * len(ready) for k, v in zip(keys, key)}, "_t": [t for t, _ in ready], "_id": [i for _, i in ready], "admitted": good})

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", _t long, _id long, admitted boolean"
    kept = "recent array<long>, waits array<struct<t: long, id: long>>, allowed long"
    found = rows.groupBy(*keys).applyInPandasWithState(decide, out, kept, "append", "EventTimeTimeout")
    return found.select(*keys, F.timestamp_micros("_t").alias(at), F.col("_id").alias(id), "admitted")
