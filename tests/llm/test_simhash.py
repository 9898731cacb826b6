import random
from collections import Counter

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyspark.llm import simhash
from tallyspark.llm.components import components

from .helpers import KIND, broadcast_joins, documents


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values):
    """Least id reachable over links at two or fewer bits; values: (id, fingerprint)."""
    least = dict.fromkeys({f for _, f in values})
    for f in sorted(least):
        if least[f] is None:
            todo, seen = [f], {f}
            while todo:
                x = todo.pop()
                new = {y for y in least if (x ^ y).bit_count() <= 2} - seen
                seen |= new
                todo += new
            ids = [i for i, y in values if y in seen and i is not None]
            for y in seen:
                least[y] = min(ids, default=-1)
    return least


def test_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    least = slow_components(rows)
    want = Counter((i, f"{f:016x}", least[f]) for i, f in rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_links_connect_the_same_with_and_without_crowds(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {0, *base}
    for b in base[:8]:  # groups of near copies, and chains
        for _ in range(60):
            fps.add(b ^ 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64) if rnd.random() < 0.5 else 0))
        x = b
        for _ in range(15):
            x ^= 1 << rnd.randrange(64)
            x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = [(signed(f), f) for f in fps]
    want = slow_components(values)
    df = spark.createDataFrame([(s,) for s, _ in values], "fp long")
    for crowd in (0, 3, 1000):
        roots = {r.node: r.root for r in components(simhash.links(df, crowd)).collect()}
        for s, f in values:
            assert roots.get(s, s) == want[f], crowd


def test_long_chain_and_loops(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5), (None, 3), (7, None)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, n)} | {i: 1000 for i in range(1001, 1301)}


def test_empty_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    docs = documents(spark, ["same words here", "same words here"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {1}


def test_points_of_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(500).selectExpr("xxhash64(id) fp").write.parquet(f"{tmp_path}/fps")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString() and not broadcast_joins(found)
