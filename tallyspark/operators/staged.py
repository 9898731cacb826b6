"""Jobs in stages that go on behind the last completed one (ST6), with a row for each completed stage.

An output is written to a folder of its own and counts from the moment its row is in the manifest, so that a stage that was
stopped leaves nothing that a later run would read. A row names the output it was made from: if an earlier stage is done anew,
what was made from its old output no longer counts.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "job_id string, stage string, number int, path string, made_from string, rows long, finished_at timestamp"
Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all jobs in folder: a few for each job; none if nothing was completed there."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def completed(spark: SparkSession, folder: str, job_id: str, names: Sequence[str], resume_from: str | None = None) -> list[str]:
    """Paths of the outputs that a run of these stages can start behind, in order; of a stage done twice the later one. resume_from is done anew, with all behind it."""
    rows = manifest(spark, folder).where(F.col("job_id") == job_id).orderBy("finished_at", "path").collect()
    paths: list[str] = []
    for number, name in enumerate(names):
        fit = [r.path for r in rows if (r.stage, r.number, r.made_from) == (name, number, paths[-1] if paths else "")]
        if name == resume_from or not fit:
            break
        paths.append(fit[-1])
    return paths


def run(source: DataFrame, folder: str, job_id: str, stages: Sequence[Stage], resume_from: str | None = None) -> DataFrame:
    """The last stage's output. Stages take the output of the one before, the first one source; folder must be one that driver and executors share.

    A stage that fails raises; the next run with the same job_id starts with it. No stages give source itself; names may repeat."""
    spark, names = source.sparkSession, [name for name, _ in stages]
    if resume_from is not None and resume_from not in names:
        raise ValueError(f"no stage {resume_from}")
    paths = completed(spark, folder, job_id, names, resume_from)
    data = spark.read.parquet(paths[-1]) if paths else source
    for number in range(len(paths), len(stages)):
        name, stage = stages[number]
        path = f"{folder}/outputs/{uuid.uuid4().hex}"
        stage(data).write.parquet(path)
        data = spark.read.parquet(path)
        row = (job_id, name, number, path, paths[-1] if paths else "", data.count(), datetime.datetime.now())
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        paths.append(path)
    return data


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """job_id, number, stage, rows, finished_at of each stage of each job, once: its last run."""
    last = F.max_by(F.struct("rows", "finished_at"), F.struct("finished_at", "path"))
    return manifest(spark, folder).groupBy("job_id", "number", "stage").agg(last.alias("_last")).select("job_id", "number", "stage", "_last.*")
