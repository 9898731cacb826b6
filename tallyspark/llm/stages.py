"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all docs, and returns documents' columns but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, rule_ensemble, shingles, simhash, toxicity
from .common import stash, table
from .components import components
from .queries import tokenizer


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't find toxic."""
    return toxicity.filter_civil(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, scores at least 0.5."""
    model = rule_ensemble.fit_quality(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.filter_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row of the least id and text hash. Rows without an id stay.

    Rows that share an id but not their text are documents of their own; those that share both are one.

    Near duplicates have fingerprints that differ in two bits at most, or five-word shingles of similarity 0.8.
    """
    named = docs.where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    found = shingles.sets(named, ["doc_id", "hash"])
    rows = stash(found.groupBy("own", "fp").agg(F.min(F.struct("doc_id", "hash")).alias("first")), "rows")
    near = simhash.links(stash(rows.select("fp").distinct(), "distinct")).unionByName(rows.select(F.col("fp").alias("a"), F.col("own").alias("b"))).unionByName(shingles.links(found))
    members = stash(components(near), "components").select(F.col("node").alias("own"), "root")
    firsts = rows.join(members, "own", "left").groupBy(F.coalesce("root", "own").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    kept = docs.withColumn("hash", F.xxhash64("text")).join(firsts, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (op6's columns)."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))
