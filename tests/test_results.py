"""Values out of JSON results, and gold documents out and in."""

import datetime as dt
import json

import pytest

from tallyspark.operators import results as op

JOBS = "entity_id long, job_id long, status string, created_at timestamp, result string"


def job(n, items, entity=1, status="completed", day=None):
    return (entity, n, status, dt.datetime(2024, 1, day or n), items if isinstance(items, str) or items is None else json.dumps({"line_items": items}))


def item(name, **values):
    return {"canonical_name": name, "values": values}


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([("revenue", "income"), ("revenue", "other")], "canonical_name string, category string")


def found(spark, taxonomy, jobs, **how):
    return {(r.entity_id, r.canonical_name, r.period): (r.value, r.category) for r in op.financials(spark.createDataFrame(jobs, JOBS), taxonomy, **how).collect()}


def test_first_number_of_the_newest_job_wins(spark, taxonomy):
    jobs = [job(1, [item("revenue", a=1, b=2, c=3)]), job(2, [item("revenue", a="x", b=None), item("revenue", a=" 7e1 ", b=[1]), item("revenue", a=5)])]
    assert found(spark, taxonomy, jobs) == {(1, "revenue", "a"): (70.0, "income"), (1, "revenue", "b"): (2.0, "income"), (1, "revenue", "c"): (3.0, "income")}


def test_values_of_every_kind(spark, taxonomy):
    kinds = {"int": 3, "float": 0.5, "exp": 1e30, "true": True, "text": "-2.5", "dot": ".5", "words": "12 apples", "suffix": "1d", "nan": "NaN", "empty": "", "null": None, "list": [1], "map": {"a": 1}}
    got = found(spark, taxonomy, [job(1, [item("x", **kinds)])])
    assert {k[2]: v[0] for k, v in got.items()} == {"int": 3.0, "float": 0.5, "exp": 1e30, "true": 1.0, "text": -2.5, "dot": 0.5}


def test_only_five_completed_jobs_with_results_and_no_broken_texts(spark, taxonomy):
    jobs = [job(n, [item("x", **{f"p{n}": n})]) for n in range(1, 8)] + [job(8, [item("x", p=8)], status="failed"), job(9, None), job(10, "{broken", entity=2), job(11, '{"line_items": 3}', entity=3), job(12, "[]", entity=4)]
    assert sorted(k[2] for k in found(spark, taxonomy, jobs)) == ["p3", "p4", "p5", "p6", "p7"]
    ties = [job(n, [item("x", p=n)], day=1) for n in (1, 2, 3)]
    assert found(spark, taxonomy, ties, keep=1) == {(1, "x", "p"): (3.0, None)}


def test_names(spark, taxonomy):
    rows = [item("", p=1), item(None, p=1), item("unmapped", p=1), {"values": {"p": 1}}, {"canonical_name": "none"}, item("a", p=1), item("b", p=2)]
    assert found(spark, taxonomy, [job(1, rows)]).keys() == {(1, "a", "p"), (1, "b", "p")}
    assert found(spark, taxonomy, [job(1, rows)], names=["b"]).keys() == {(1, "b", "p")}
    assert found(spark, taxonomy, [job(1, [])]) == {}


def test_gold_documents_out_and_in(spark, tmp_path):
    listed = [
        item("a", p=1) | {"provenance": {"parsing": {"is_bold": True}}, "sheet": "s"}, item("a", p=-200, q="9", r=None), item("a") | {"provenance": {"parsing": {}}},
        item("b", p="text only"), item("unmapped", p=1), item("quo\"te", **{"FY 1/2": True}),
    ]
    results = spark.createDataFrame([("f", json.dumps({"sample_line_items": listed, "line_items": [item("z", p=1)]})), ("g", json.dumps({"line_items": listed[:1]})), ("h", "broken")], "file string, result string")
    maps = spark.createDataFrame([("f", 1, "s", "A", "a"), ("f", 1, "s", "A", "a"), ("f", 2, None, None, "b"), ("h", 3, "s", "C", None)], "file string, n long, sheet string, original_label string, canonical_name string")
    values, parsing = op.gold_values(results), op.gold_parsing(results)
    plain = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(tuple(r) for r in values.collect()) == [("f", "a", "p", -200.0, 1.0, 2.0), ("f", 'quo"te', "FY 1/2", 1.0, 1.0, 0.5), ("g", "a", "p", 1.0, 1.0, 0.5)]
    assert sorted(tuple(r) for r in parsing.collect()) == [("f", 0, "a", "s", "", True, False, False, 0), ("g", 0, "a", "s", "", True, False, False, 0)]
    folder = str(tmp_path / "gold")
    op.gold_documents(maps, values, parsing).write.partitionBy("file").text(folder)
    back = op.gold_tables(spark.read.text(folder).withColumnRenamed("value", "document"))
    # g has no mappings, so no document
    for df, want in zip(back, (maps, values.where("file <> 'g'"), parsing.where("file <> 'g'"))):
        assert sorted(df.columns) == sorted(want.columns) and plain(df) == plain(want)
    counts = {(r.file, r.sheet): (r.min_items, r.min_coverage_pct) for r in op.gold_completeness(back[0]).collect()}
    assert counts == {("f", None): (3, 75.0), ("f", "s"): (2, 80.0), ("f", "Unknown"): (1, 80.0), ("h", None): (1, 75.0), ("h", "s"): (1, 80.0)}
    assert [df.count() for df in op.gold_tables(spark.createDataFrame([("x", "broken"), ("y", None), ("z", "{}")], "file string, document string"))] == [0, 0, 0]


def test_gold_documents_straight_from_results_parse_each_text_once(spark):
    listed = [item("b", p=2, q="text"), item("a", p=1) | {"provenance": {"parsing": {"is_bold": 1, "hierarchy_level": "2"}}, "sheet": 3}, item("b", r=True), item("c", p="text"), item(5, p=0), 7, None, {"canonical_name": "a", "values": 3, "provenance": {"parsing": {}}}]
    texts = [json.dumps(x) for x in ({"line_items": listed}, {"sample_line_items": listed[2:], "line_items": listed}, {"sample_line_items": [], "line_items": listed}, {"sample_line_items": None, "line_items": 4}, [])] + ["broken", None]
    results = spark.createDataFrame(list(enumerate(texts)), "file int, result string")
    maps = spark.createDataFrame([(i, 1, "s", "A", "a") for i in range(len(texts) + 1)], "file int, n long, sheet string, original_label string, canonical_name string")
    values, parsing = op.gold_values(results), op.gold_parsing(results)
    want = {r.file: r.document for r in op.gold_documents(maps, values, parsing).collect()}
    written = op.gold_written(maps, results)
    assert {r.file: json.loads(r.document) for r in written.collect()} == {k: json.loads(v) for k, v in want.items()}
    assert sorted(tuple(r)[:4] for r in values.collect()) == [(0, "5", "p", 0.0), (0, "a", "p", 1.0), (0, "b", "r", 1.0), (1, "5", "p", 0.0), (1, "b", "r", 1.0)]
    for df in op.gold_tables(written):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator(") + plan.count("to_json(") == 1
    for df in (values, parsing):
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
