"""Running state of counters over a stream: each batch is folded into the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CounterTable:
    """ST4: count, first and last time of each key, for writeStream.foreachBatch(table.merge).

    Version n holds the state after batch n. A batch that runs again, after a failure, starts from version n - 1 and
    overwrites version n, so that nothing is counted twice.
    """

    def __init__(self, path: str, keys: list[str], at: str = "ts") -> None:
        self.path, self.keys, self.at = path, keys, at

    def merge(self, batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*self.keys).agg(F.count("*").alias("n"), F.min(self.at).alias("first_seen"), F.max(self.at).alias("last_seen"))
        if number:
            old = batch.sparkSession.read.parquet(self._version(number - 1))
            new = old.unionByName(new).groupBy(*self.keys).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        new.write.mode("overwrite").parquet(self._version(number))

    def read(self, spark, number: int) -> DataFrame:
        return spark.read.parquet(self._version(number))

    def _version(self, number: int) -> str:
        return f"{self.path}/version={number}"
