"""Where loops cut their lineage, and stages keep their outputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting (from 4.1) by which shuffle files go at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that is this session's; only a session on this machine may have none, and gets one of its own."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyspark-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(*parts: DataFrame, packed: bool = False) -> DataFrame:
    """Like settled, as Parquet: much smaller, and later steps read only the columns that they need. Several parts of the same columns come after each other. packed: smaller yet, and what was shuffled for a part goes as soon as it is written."""
    schema, spark = parts[0].schema, parts[0].sparkSession
    path = f"{shared(spark)}/written-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if packed:
        spark.conf.set(CLEANUP, "true")
    try:
        for df in parts:
            (df.write.option("compression", "zstd") if packed else df.write).mode("append").parquet(path)
    finally:
        if packed:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what written has written of these; nothing may read them any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("written-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
