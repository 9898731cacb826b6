"""SimHash fingerprints, and near-duplicates among them by multi-index hashing.

A fingerprint of 64 bits is two segments of 32. Of two fingerprints that differ in at most two bits, one segment differs
in at most one. So each fingerprint enumerates the ball of radius one about each segment, fetches the fingerprints whose
segment is in it from the segment's table, and verifies the complete distance inside the join. Of two segments that
differ in one bit, one has the bit set: balls only clear bits, which halves them and loses no pair.

Equal fingerprints are one row before any of this. A table bucket that holds more than crowd distinct fingerprints (a
large group of near copies) isn't joined: those who touch it enumerate their whole ball of radius one, 65 points. Two
fingerprints differ in at most two bits if and only if they share a point, so each is linked to the least that shares a
point with it. This finds the same components with rows in proportion to the members, never all pairs.

Null, empty and blank texts have fingerprint zero, which is linked like any other. Rows without an id have a result
too, but give no component its id. A fingerprint or a component with a large share of the rows gets its class by broadcast. Repeated rows fall together. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, as_bytes, join_hot, join_long, slices, stash
from .components import components

SEED, MASK, BLOCK = 42, 0xFFFFFFFF, 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned fingerprint of the word shingles: a bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, width) for x in as_bytes(batch)], np.uint64).view(np.int64)
            yield arrow({"doc_id": (batch.column("doc_id"), None), "fp": (fps, pa.int64())})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame, crowd: int = 16) -> DataFrame:
    """Links a, b that connect all distinct fingerprints (fp) at two or fewer differing bits; not always each such pair."""
    low, high = F.col("fp").bitwiseAND(F.lit(MASK)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    table = fps.select("fp", F.explode(F.array(low, high)).alias("key"))
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])
    ball = table.select("fp", "key", F.explode(bits).alias("bit")).where("bit = 0 or (key & bit) != 0").select(F.col("fp").alias("other"), F.col("key").bitwiseAND(F.bitwise_not("bit")).alias("key"), (F.col("bit") == 0).alias("same"))
    crowded = stash(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    near = (F.bit_count(F.col("other").bitwiseXOR(F.col("fp"))) <= 2) & (F.col("other") != F.col("fp")) & (~F.col("same") | (F.col("other") < F.col("fp")))
    a, b = ball.join(crowded, "key", "left_anti").alias("a"), table.join(crowded, "key", "left_anti").alias("b")
    pairs = join_long(a, b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("other").alias("a"), F.col("fp").alias("b"))
    touching = ball.join(crowded, "key", "left_semi").select(F.col("other").alias("fp")).distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    points = touching.select("fp", F.explode(steps).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("point"))
    stars = points.withColumn("least", F.min("fp").over(Window.partitionBy("point"))).where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, crowd: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable over links) of each row."""
    rows = stash(fingerprints(docs, doc_id, text, width), "fingerprints")
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = stash(components(links(fps.select("fp"), crowd)), "components")
    # roots are members too
    members = found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())
    firsts = members.join(fps, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of = join_hot(members, firsts, "root").select("fp", "component_id")
    classes = fps.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return join_hot(rows, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
