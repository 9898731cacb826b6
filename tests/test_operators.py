"""Operators on small fixtures, against brute force where there is no SQL."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import periods, text
from tallyspark.operators import rates, sheets, taxonomy, vectors
from tallyspark.streaming import sinks, windows


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=12), st.text("abc é", max_size=12))
def test_indel_similarity(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert text.indel(a, b) == pytest.approx(want)


def test_similarity_columns_keep_nulls(spark):
    pairs = [("net revenue", "revenue net"), ("", ""), (None, "a"), ("cost", "costs of goods")]
    got = spark.createDataFrame(pairs, "a string, b string").select(text.indel_ratio("a", "b").alias("i"), text.sequence_ratio("a", "b").alias("s")).collect()
    for r, (a, b) in zip(got, pairs):
        assert r.s == (None if a is None else SequenceMatcher(None, a, b).ratio())
        assert (r.i is None) == (a is None)


def test_fuzzy_join_equals_brute_force(spark):
    labels, aliases = ["revenue total", "ebitda margin", "zzz"], [("total revenue", "revenue"), ("ebitda margins", "ebitda_margin"), ("cash", "cash")]
    rows = taxonomy.fuzzy(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(aliases, "alias string, canonical_name string"), 80.0).collect()
    tokens = lambda x: " ".join(sorted(x.split()))
    best = {}
    for x in labels:
        scored = [(text.indel(tokens(x), tokens(a)), c) for a, c in aliases]
        if max(scored)[0] >= 80:
            best[x] = max(scored)[1]
    assert {r.label: r.canonical_name for r in rows} == best


@pytest.mark.parametrize("least", [60.0, 80.0])
def test_fuzzy_join_needs_no_common_token(spark, least):
    rnd = random.Random(1)
    labels = ["cold anvils", "Bevenue", "xy", "a a a a b"] + ["".join(rnd.choice("abcd e") for _ in range(rnd.randint(3, 9))).strip() or "a" for _ in range(40)]
    aliases = ["old anvil", "Revenue", "yx", "a a a b"] + ["".join(rnd.choice("abcd e") for _ in range(rnd.randint(3, 9))).strip() or "b" for _ in range(40)]
    tokens = lambda x: " ".join(sorted(x.lower().split()))
    want = {}
    for x in labels:
        score, alias = min((-text.indel(tokens(x), tokens(a)), a) for a in aliases)
        if -score >= least:
            want[x] = (alias, round(-score, 6))
    assert {"cold anvils", "Bevenue"} <= want.keys()
    rows = taxonomy.fuzzy(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x, x) for x in aliases], "alias string, canonical_name string"), least).collect()
    assert {r.label: (r.alias, round(r.score, 6)) for r in rows} == want


@pytest.mark.parametrize(("formula", "want"), [
    ("=A1+B2*2", 21.0), ("=SUM(A1:B2)", 25.0), ("=-(A1-B2)^2", 9.0), ("=ROUND(AVERAGE(A1,A2)/B2,1)", 1.1), ("=A1/0", None), ("=VLOOKUP(A1)", None), ("=ABS(A1-100)", 95.0), ("=Z9", None), ("=", None), ("=2^3^2", 512.0),
])
def test_formulas(formula, want):
    assert sheets.evaluate(formula, {"A1": 5.0, "B2": 8.0, "A2": 12.0}) == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(("raw", "normal", "kind"), [
    ("FY24", "FY2024", "fiscal_year"), ("fy26/27", "FY2026/27", "fiscal_year"), ("FYE Mar 2024", "FYE-2024-03", "fiscal_year_end"), ("CY98", "CY1998", "calendar_year"), ("LTM", "LTM", "trailing"), ("2024E", "2024E", "year"),
    ("Q3'24", "2024-Q3", "quarter"), ("2024Q3", "2024-Q3", "quarter"), ("1H24", "2024-H1", "half"), ("Jan-24", "2024-01", "month"), ("2024-01", "2024-01", "month"), ("2024", "2024", "year"), ("Ops Yr 3", "Ops-Year3", "phase"), ("Year 1", "Year1", "relative"),
    ("COD+2", "COD+2", "cod"), ("total", None, None), ("", None, None), (None, None, None),
    ("COD", "COD", "cod"), ("post cod", "PostCOD", "cod"), ("Pre-COD", "PreCOD", "cod"), ("COD-3", "COD-3", "cod"), ("Stub", "Stub", "stub"), ("6-month stub", "Stub-6M", "stub"), ("Short Period", "Stub", "stub"), ("Year 1A", "Year1A", "relative"), ("Yr. 5", "Year5", "relative"),
    ("Const. Year 2", "Const-Year2", "phase"), ("1S 2024", "2024-H1", "half"), ("H1 2024A", "2024-H1", "half"), ("FY24/2025", "FY2024/2025", "fiscal_year"), ("Mayhem 24", None, None), ("Jan24", None, None), ("24A", None, None), ("Marches 2024", None, None),
])
def test_periods(spark, raw, normal, kind):
    r = spark.createDataFrame([(raw,)], "raw string").select(periods.normalize(F.col("raw")).alias("p")).first().p
    assert (r and r.normalized, r and r.kind) == (normal, kind)


def test_rates_hold_until_the_next(spark):
    d = dt.date
    listed = spark.createDataFrame([("EUR", d(2020, 1, 10), 1.1), ("EUR", d(2020, 3, 1), 1.2), ("GBP", d(2030, 1, 1), 9.0)], "currency string, day date, rate double")
    rows = [("EUR", d(2020, 1, 9), 10.0), ("EUR", d(2020, 1, 10), 10.0), ("EUR", d(2020, 2, 29), 10.0), ("EUR", d(2020, 3, 1), 10.0), ("EUR", d(2021, 7, 1), 10.0), ("USD", d(2021, 7, 1), 10.0), ("GBP", d(2021, 1, 1), 1.0), ("EUR", None, 1.0)]
    got = rates.convert(spark.createDataFrame(rows, "currency string, created_at date, value double"), listed).collect()
    key = lambda x: (x[0], str(x[1]))
    assert [r.rate for r in sorted(got, key=key)] == [x[2] for x in sorted(zip([r[0] for r in rows], [r[1] for r in rows], [None, 1.1, 1.1, 1.2, 1.2, None, None, None]), key=key)]


def test_dictionary_of_vectors_is_bounded(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0])], "vec_id long, vector array<double>")
    items = v.select(F.col("vec_id").alias("item"), "vector")
    assert {(r.vec_id, r.item, r.rank) for r in vectors.hints(v, items).collect()} == {(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)}
    monkeypatch.setattr(vectors, "MOST_ITEMS", 2)
    with pytest.raises(ValueError):
        vectors.hints(v, items)


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 1, 1, 7, 7, 59)]
    events = spark.createDataFrame([(i % 2, t, "x" if i else None) for i, t in enumerate(at)], "user_id int, ts timestamp, body string")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.timed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    state = sinks.CounterTable(str(tmp_path / "state"), ["user_id"])
    q = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = state.read(spark, 0)
    assert {(r.user_id, r.n) for r in first.collect()} == {(0, 3), (1, 3)}
    state.merge(events, 1)
    state.merge(events, 1)  # a repeated batch isn't counted twice
    assert {(r.user_id, r.n) for r in state.read(spark, 1).collect()} == {(0, 6), (1, 6)}
    q = windows.rates(stream, ["user_id"], length="5 minutes").writeStream.outputMode("complete").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in windows.rates(windows.timed(events), ["user_id"], length="5 minutes").collect()}
    assert {tuple(r) for r in spark.table("found").collect()} == want
    assert windows.first_copies(events, F.col("body")).count() == 2
    assert windows.quantiles(events.withColumn("v", F.lit(2.0)), "v", [0.5]).first().q == [2.0]


def test_levels_know_no_depth(spark):
    chain = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(60)]
    rows = [*chain, ("orphan", "nobody"), ("a/b", "n003"), ("x", "y"), ("y", "x"), ("below", "x"), ("self", "self")]
    got = {r.node: r for r in taxonomy.levels(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert len(got) == len(rows) and got["n059"].level == 59 and got["n059"].root == "n000" and got["n059"].ancestors == [n for n, _ in chain]
    assert (got["orphan"].level, got["orphan"].root, got["orphan"].parent) == (0, "orphan", None)
    assert got["a/b"].ancestors == ["n000", "n001", "n002", "n003", "a/b"]
    assert all(got[n].level is None and got[n].root is None and got[n].path is None for n in ("x", "y", "below", "self"))
    sums = taxonomy.subtotals(spark.createDataFrame(list(got.values())), spark.createDataFrame([("a/b", 2), ("n005", 3), ("n059", 9)], "node string, value int"))
    assert {r.node: r.value for r in sums.collect()} == {"a/b": 2, "n005": 3, **{n: 9 for n, _ in chain[6:]}, "n004": 3, **{n: 5 for n, _ in chain[:4]}}
    assert taxonomy.levels(spark.createDataFrame([], "node string, parent string")).count() == 0
