"""Admitted requests of tables and streams against a walk over each key's requests."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.streaming import limits

SCHEMA = "who string, ts timestamp, id long, allowed long, extra string"
START = dt.datetime(2024, 1, 1)
ALLOWED = {"a": 3, "b": 1, "c": None, "d": 0, "e": 5, None: 2}


def made(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        who = rnd.choice(["a", "a", "a", "b", "c", "d", "e", None])  # one key has a third of all
        seconds = rnd.choice([rnd.randint(0, 600), rnd.randint(5000, 5060), 60 * rnd.randint(0, 30)])
        rows.append((who, START + dt.timedelta(seconds=seconds, milliseconds=rnd.choice([0, 0, 1])), i, ALLOWED[who], None))
    return rows


def walk(rows, length=60):
    out, kept = {}, {}
    for who, ts, i, allowed, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        before = [t for t in kept.get(who, []) if t > ts - dt.timedelta(seconds=length)]
        out[i] = not allowed or allowed <= 0 or len(before) < allowed
        kept[who] = before + [ts] if out[i] else before
    return out


def test_tables_equal_the_walk(spark):
    for seed in range(3):
        rows = made(seed)
        got = limits.limited(spark.createDataFrame(rows, SCHEMA), ["who"]).collect()
        want = walk(rows)
        assert len(got) == len(rows) and {r.id: r.admitted for r in got} == want
        assert {True, False} == set(want.values())


def test_batches_of_one_row_and_two_keys(spark):
    rows = made(7, 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(None).cast("int"))
        assert {r.id: r.admitted for r in limits.limited(df, ["who", "part"]).collect()} == walk(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables_missing_times_and_ties(spark):
    assert limits.limited(spark.createDataFrame([], SCHEMA), ["who"]).collect() == []
    rows = [("a", None, 1, 1, None), ("a", START, 3, 1, None), ("a", START, 2, 1, None), ("a", START, 2, 1, None), ("a", START + dt.timedelta(seconds=60), 4, 1, "x")]
    got = limits.limited(spark.createDataFrame(rows, SCHEMA), ["who"]).collect()
    assert sorted((r.id, r.admitted) for r in got) == [(2, False), (2, True), (3, False), (4, True)]


def test_streams_equal_tables(spark, tmp_path):
    rows = [r for r in made(11) if r[0] is not None]
    inside = sorted(rows, key=lambda r: r[1])
    rnd = random.Random(1)
    for i in range(0, len(inside), 100):  # requests of a batch are out of order, and batches in order
        batch = inside[i : i + 100]
        rnd.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", START + dt.timedelta(days=1), -1, 1, None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # the last request lets the watermark pass the others
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.limited_stream(stream, ["who"]).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.id: r.admitted for r in spark.table("limited").collect()}
    assert got == walk(inside)
