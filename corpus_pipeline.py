"""Documents to training sequences: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.keep_civil),
    ("quality", stages.keep_good),
    ("near_dedup", stages.keep_one_of_each),
    ("packing", stages.pack),
]
#: Two fitted models, a tokeniser and a placement that depends on order: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents, each written as Parquet and read again by the next."""
    from tallyspark.llm.common import stash, table

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, name)
    return docs
