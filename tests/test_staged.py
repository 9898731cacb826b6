"""Stages that fail and go on, and states of jobs against a walk over their events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import governance, staged


@pytest.fixture
def job(spark, tmp_path):
    ran, fails = [], set()

    def stage(name, change):
        def work(rows):
            ran.append(name)
            return rows.select(F.when(F.lit(name in fails) & (F.col("id") == 7), F.raise_error(F.lit("lost"))).otherwise(F.expr(change)).cast("long").alias("id"))

        return name, work

    stages = [stage("parse", "id + 1"), stage("map", "id * 10"), stage("check", "id - 3")]
    source = spark.range(20)
    go = lambda job_id="j", **how: sorted(r.id for r in staged.run(source, str(tmp_path), job_id, stages, **how).collect())
    return go, ran, fails, str(tmp_path)


WANT = [(i + 1) * 10 - 3 for i in range(20)]


def test_a_stage_that_fails_is_the_first_of_the_next_run(spark, job):
    go, ran, fails, folder = job
    fails.add("map")
    with pytest.raises(Exception, match="lost"):
        go()
    assert ran == ["parse", "map"] and [r.stage for r in staged.lineage(spark, folder).collect()] == ["parse"]
    fails.clear()
    assert go() == WANT and ran == ["parse", "map", "map", "check"]
    assert go() == WANT and len(ran) == 4
    assert sorted((r.number, r.stage, r.rows) for r in staged.lineage(spark, folder).collect()) == [(0, "parse", 20), (1, "map", 20), (2, "check", 20)]


def test_a_stage_done_anew_makes_what_follows_outdated(spark, job):
    go, ran, fails, folder = job
    assert go() == WANT
    fails.add("check")
    with pytest.raises(Exception, match="lost"):
        # the stage before gives a 7, on which the check fails
        staged.run(spark.range(7, 8), folder, "other", [("check", lambda x: x.select(F.raise_error(F.lit("lost")).cast("long").alias("id")))])
    fails.clear()
    ran.clear()
    assert go(resume_from="map") == WANT and ran == ["map", "check"]
    assert staged.manifest(spark, folder).count() == 5 and staged.lineage(spark, folder).count() == 3
    stopped = staged.run(spark.range(20), folder, "j", [("parse", None), ("map", lambda x: x)], resume_from="map")
    assert stopped.count() == 20
    assert len(staged.completed(spark, folder, "j", ["parse", "map", "check"])) == 2  # the check was made from the old output
    with pytest.raises(ValueError, match="no stage"):
        go(resume_from="none")


def test_jobs_are_apart_and_no_stages_give_the_source(spark, job):
    go, ran, _, folder = job
    assert staged.manifest(spark, folder).count() == 0 and staged.completed(spark, folder, "j", ["parse"]) == []
    assert go("a") == go("b") == WANT and len(ran) == 6
    assert staged.run(spark.range(3), folder, "c", []).count() == 3


def walked(events):
    state, out = "pending", []
    for at, n, status in sorted(events, key=lambda e: (e[0], e[1], e[2] or "")):
        fine = status is not None and (status == state or status in governance.FOLLOWS.get(state, []))
        out.append((at, n, state, status, fine))
        state = status if fine else state
    return out


def test_transitions_equal_a_walk(spark):
    rnd, day = random.Random(3), dt.datetime(2024, 1, 1)
    kinds = ["pending", "processing", "completed", "failed", "needs_review", "strange", None]
    jobs = {j: [(day + dt.timedelta(hours=rnd.randrange(6)), rnd.randrange(3), rnd.choice(kinds)) for _ in range(rnd.randrange(1, 12))] for j in range(150)}
    jobs[200] = [(day, 1, "processing"), (day, 1, "processing"), (day, 2, "completed"), (day, 3, "pending")]
    rows = [(j, *e, None) for j, es in jobs.items() for e in es]
    events = spark.createDataFrame(rows, "job_id long, at timestamp, n long, status string, gate_passed boolean")
    got = governance.job_transitions(events)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((j, *r) for j, es in jobs.items() for r in walked(es)), key=key)
    ends = {r.job_id: (r.status, r.accepted, r.refused) for r in governance.job_outcomes(got).collect()}
    assert ends[200] == ("completed", 3, 1) and len(ends) == 151


def test_a_failed_gate_asks_for_review_and_review_completes(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, 1, "processing", None), (1, day, 2, "completed", False), (1, day, 3, "completed", True), (2, day, 1, "completed", True)]
    got = governance.job_transitions(spark.createDataFrame(rows, "job_id long, at timestamp, n long, status string, gate_passed boolean"))
    assert [(r.job_id, r.before, r.status, r.accepted) for r in got.orderBy("job_id", "n").collect()] == [(1, "pending", "processing", True), (1, "processing", "needs_review", True), (1, "needs_review", "completed", True), (2, "pending", "completed", False)]
    assert {r.job_id: (r.status, r.updated_at) for r in governance.job_outcomes(got).collect()} == {1: ("completed", day), 2: ("pending", None)}
