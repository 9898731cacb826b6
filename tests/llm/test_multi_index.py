import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import multi_index


def brute(rows, k=5, every=50):
    x = {i: np.array(v, float) for i, v in rows}
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    return {q: sorted(((-cos(x[q], x[i]), i) for i in x if i != q))[:k] for q in x if q % every == 0}


@pytest.mark.parametrize(("share", "least"), [(1.0, 1.0), (0.45, 0.9)])
def test_recall_against_brute_force(spark, share, least):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rnd.normal(size=16).astype(np.float32)]) for i in range(3000)]
    rows += [(i, rows[7][1]) for i in range(3000, 4500)]  # a third of the rows are one vector
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = multi_index.search(df, F.col("vec_id") % 50 == 0, centroids=16, sample_rows=1500, share=share, min_entries=200, block_rows=300, group_rows=40).collect()
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert by.keys() == want.keys()
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
        if share == 1.0:
            assert [(i, round(s, 12)) for _, i, s in found] == [(i, round(-c, 12)) for c, i in want[q]]
    assert hits / (5 * len(want)) >= least


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.5]), (8, [2.0, 2.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in multi_index.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(q, k, i) for q, k, i, _ in got] == [(0, 1, 1), (0, 2, 8)]
    assert all(math.isclose(s, math.sqrt(0.5)) for *_, s in got)
    assert multi_index.search(df.where("false"), F.lit(True)).count() == 0


def test_rows_are_dealt_evenly_whatever_their_ids():
    """Ids that are multiples of 50, two parts; one cell with more rows than a part."""
    ids = np.arange(0, 50 * 9000, 50)
    cells = np.where(ids % 150 == 0, 3, ids // 50 % 8)
    rows = np.bincount(cells, minlength=16)
    dealt = multi_index.Dealt(rows, 2000)
    sizes = np.bincount(dealt.parts(cells, ids))
    assert len(sizes[sizes > 0]) >= 5 and sizes.sum() == 9000 and sizes.max() < 2 * 2000
    assert multi_index.Dealt(np.zeros(4, np.int64), 10).parts(np.array([2]), np.array([7]))[0] == 0


def test_blocks_go_to_the_teams_that_visit_them(spark):
    """Vectors in clusters, a small share: few of all pairs of blocks and teams meet, and recall stays."""
    rnd = np.random.default_rng(8)
    middles = rnd.normal(size=(40, 16))
    rows = [(i, [float(v) for v in (middles[i % 40] + 0.1 * rnd.normal(size=16))]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows, every=3)
    by = {}
    for r in multi_index.search(df, F.col("vec_id") % 3 == 0, centroids=16, sample_rows=1500, share=0.04, min_entries=100, block_rows=200, group_rows=100).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert by.keys() == want.keys()
    assert sum(len(by[q] & {i for _, i in want[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_cells_come_by_distance():
    rnd = np.random.default_rng(1)
    a, b = rnd.random(7), rnd.random(5)
    cells = list(multi_index.cells_by_distance(a, b))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)
