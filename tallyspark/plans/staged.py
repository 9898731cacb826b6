"""A job in stages over line items, stopped behind its second stage and gone on with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staged as op
from ..sources import roles, store
from .base import ITEMS, query, with_

STAGES: list[op.Stage] = [
    ("parsing", lambda rows: rows.select(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("yr"), "l_returnflag", F.col("l_extendedprice").cast(roles.PRICE).alias("value"))),
    ("mapping", lambda rows: rows.where("l_returnflag <> 'R'").select("entity_id", "yr", F.concat(F.lit("flag_"), "l_returnflag").alias("canonical_name"), "value")),
    ("totals", lambda rows: rows.groupBy("entity_id", "yr", "canonical_name").agg(F.sum("value").cast("decimal(20,2)").alias("value"), F.count("*").alias("n"))),
]
TOTALS = with_(ITEMS, "t AS (SELECT l_suppkey AS entity_id, yr, 'flag_' || l_returnflag AS canonical_name, CAST(SUM(p) AS DECIMAL(20,2)) AS value, COUNT(*) AS n FROM items WHERE l_returnflag <> 'R' GROUP BY ALL)")


def _stopped_and_resumed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    folder, rows = f"{store.shared(spark)}/staged-{uuid.uuid4().hex}", roles.table(spark, sf_dir, "lineitem")
    op.run(rows, folder, "job", STAGES[:2])
    # the second run reads what the first one left, so its source is of no use
    return folder, op.run(rows.where("false"), folder, "job", STAGES)


@query(TOTALS + " SELECT * FROM t")
def staged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: the output of the job's last stage."""
    return _stopped_and_resumed(spark, sf_dir)[1]


@query(TOTALS + " SELECT 'job' AS job_id, 0 AS number, 'parsing' AS stage, COUNT(*) AS rows FROM items UNION ALL SELECT 'job', 1, 'mapping', COUNT(*) FROM items WHERE l_returnflag <> 'R' UNION ALL SELECT 'job', 2, 'totals', COUNT(*) FROM t")
def stage_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stage, though the job ran twice."""
    return op.lineage(spark, _stopped_and_resumed(spark, sf_dir)[0]).drop("finished_at")
