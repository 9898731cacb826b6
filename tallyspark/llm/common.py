"""What the operators share: table access, the shared scratch folder, Arrow batches as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into bytes at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset one of our own, but only in a session on this machine: executors elsewhere wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", pieces: int = 200) -> DataFrame:
    """left joined with right, which has one row a key. Keys with over 1 / pieces of left's rows, fewer than pieces, get right's rows by broadcast, so that no task gets all of a key."""
    total = left.count()
    keys = [r[0] for r in left.groupBy(key).count().where(F.col("count") * pieces > total).select(key).dropna().collect()]
    if not keys:
        return left.join(right, key, how)
    hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return left.where(hot).join(F.broadcast(right.where(hot)), key, how).unionByName(left.where(~hot).join(right.where(~hot), key, how))


def join_long(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """left joined with right, both dealt by their keys and sorted, never broadcast. For sides that Spark sizes too low: it takes exploded rows for as many as they were made from, and arrays for one element."""
    return left.join(right.hint("merge"), on, how)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like stash, in buckets of the key: joins and groups on it that read the result don't shuffle it."""
    spark = df.sparkSession
    own = f"stash_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(min(max(1, buckets), 100_000), key).option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    return spark.table(own)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def pieces_of(batch: pa.RecordBatch, most: int, name: str = "text", rows: int = 8_192) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in a column, and so many rows; a single row may have more bytes."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null counts as empty."""
    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def as_text(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def arrow(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most rows rows of df, those of least hash of the key; a filter on the hash comes first, so that few rows are sorted."""
    n = df.count()
    share = min(1.0, (1.2 * rows + 1_000) / max(n, 1))
    level = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return df.where(level < int(share * (1 << 30))).orderBy(level, key).limit(rows)
