"""Greedy clusters against the sequential run."""

import random

import pytest

from tallyspark.operators import gaps


def sequentially(nodes, pairs):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    seed = {}
    for i in sorted(nodes):
        if i not in seed:
            seed |= {j: i for j in sorted(nodes) if j >= i and j not in seed and (j == i or (i, j) in near)}
    return seed


@pytest.mark.parametrize("shape", ["random", "chain", "star", "dense", "none"])
def test_clusters_equal_the_sequential_run(spark, shape):
    rnd = random.Random(shape)
    nodes = rnd.sample(range(1000), 60)
    pairs = {
        "random": [tuple(rnd.sample(nodes, 2)) for _ in range(110)],
        "chain": list(zip(sorted(nodes), sorted(nodes)[1:]))[:9],
        "star": [(min(nodes), x) for x in nodes if x != min(nodes)] + [(nodes[3], nodes[7])],
        "dense": [(a, b) for a in nodes for b in nodes if a < b and rnd.random() < 0.5],
        "none": [],
    }[shape]
    pairs = [(min(p), max(p)) for p in pairs]
    rows = [*pairs, *pairs[:5], (5000, 6000), (nodes[0], nodes[0])]
    got = gaps.greedy_clusters(spark.createDataFrame([(n,) for n in nodes], "n long"), spark.createDataFrame(rows, "a long, b long"))
    assert {r.n: r.seed for r in got.collect()} == sequentially(nodes, pairs)


def test_labels_between_the_thresholds_are_ambiguous_and_zero_vectors_new(spark):
    labels = spark.createDataFrame([("same", 9, 2, [1.0, 0.0]), ("near", 5, 2, [1.0, 1.0]), ("far", 3, 2, [0.0, 1.0]), ("zero", 2, 2, [0.0, 0.0])], "label string, total long, entities long, vector array<double>")
    items = spark.createDataFrame([("revenue", [2.0, 0.0])], "item string, vector array<double>")
    got = {r.label: (r.best_score, r.classification, r.suggested) for r in gaps.analyse(labels, items).collect()}
    assert got == {"same": (1.0, "alias_candidate", "revenue"), "near": (0.707107, "ambiguous", None), "far": (0.0, "new_item_candidate", None), "zero": (0.0, "new_item_candidate", None)}


def test_reports_of_too_many_labels_are_refused(spark):
    labels = spark.range(gaps.MOST_LABELS + 1).selectExpr("id as n", "array(1D, cast(id as double)) as vector")
    with pytest.raises(ValueError, match="more than"):
        gaps.alike(labels)
    pairs = gaps.alike(labels.where("n < 3"), 0.9)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_pairs_of_suppliers_are_joined_in_tasks_of_bounded_rows(spark, monkeypatch):
    from tallyspark.plans import gaps as plan

    from .compare import SF_DIR

    seen = []
    monkeypatch.setattr(plan.op, "greedy_clusters", lambda size, near: seen.append(near) or size.select("n", size.n.alias("seed")))
    monkeypatch.setattr(plan, "ROWS", 1_000)
    plan.greedy_clusters(spark, SF_DIR)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    assert "RepartitionByExpression [p" in seen[0]._jdf.queryExecution().optimizedPlan().toString() and f"], {lines // 1_000 + 1}" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
