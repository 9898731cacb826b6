"""Phases against a walk through the periods one by one."""

import random
from statistics import median

import pytest

from tallyspark.operators import lifecycle


def walked(rows, project):
    """rows: (revenue, capex, development costs, drawdown) in order; a walk forth for starts, back for ends."""
    rev = [r[0] for r in rows]
    positive = [x for x in rev if x > 0]
    if not positive:
        return {}
    first, last = min(i for i, x in enumerate(rev) if x > 0), max(i for i, x in enumerate(rev) if x > 0)
    out = {}
    for i, (_, capex, costs, drawn) in enumerate(rows):
        prepared = project and capex == 0 and costs == 0 and drawn > 0
        out[i] = "operations" if first <= i <= last else "post_operations" if i > last else "pre_construction" if prepared else "construction"
    if not project:
        return out
    starts = 0
    for i in range(first, last + 1):
        if starts == 3 or rev[i] >= median(positive) / 2:
            break
        if rev[i] > 0:
            out[i], starts = "ramp_up", starts + 1
    for i in range(first + 1, last):
        if rev[i] <= 0 and (rev[i - 1] > 0 or rev[i + 1] > 0):
            out[i] = "maintenance_shutdown"
    ends = 0
    for i in [i for i in range(last, first - 1, -1) if out[i] == "operations"]:
        if ends == 2 or not (0 < rev[i] < max(positive) / 2 and i > 0 and rev[i] < rev[i - 1]):
            break
        out[i], ends = "tail", ends + 1
    return out


def facts(lives):
    out = []
    for entity, (rows, project) in enumerate(lives):
        for at, row in enumerate(rows):
            out += [(entity, at, item, float(v)) for item, v in zip(("revenue", "capex", "development_costs", "debt_drawdown"), row) if v is not None]
            out += [(entity, at, name, 1.0) for name in ("dscr", "cfads") if project]
    return out


def test_phases_equal_the_walk(spark):
    rnd, lives = random.Random(3), []
    for k in range(160):
        n = rnd.randint(1, 14)
        rev = [rnd.choice([0, 0, 10, 30, 49, 50, 51, 90, 100, -5]) for _ in range(n)]
        lives.append(([(x, rnd.choice([0, 0, -7]), 0, rnd.choice([0, 5])) for x in rev], k % 3 > 0))
    rows = spark.createDataFrame(facts(lives), "entity long, at long, item string, value double")
    # development costs of 0 count as an indicator, so two more make a project and one alone doesn't
    known = lifecycle.profiles(rows)
    assert {r.entity: r.is_project for r in known.collect()} == {i: p for i, (_, p) in enumerate(lives)}
    got = {}
    for r in lifecycle.phases(rows, known).collect():
        got.setdefault(r.entity, {})[r.at] = r.phase
    want = {i: w for i, (rows_, project) in enumerate(lives) if (w := walked(rows_, project))}
    assert got == want
    assert {p for w in want.values() for p in w.values()} == {"pre_construction", "construction", "ramp_up", "operations", "maintenance_shutdown", "tail", "post_operations"}


@pytest.mark.parametrize(("items", "want"), [
    (["revenue"], (False, 0, "revenue", 0.2)), (["revenue", "capex", "dscr"], (False, 1, "revenue|capex|dscr", 0.6)), (["revenue", "cfads", "dscr"], (True, 2, "revenue|dscr", 0.4)),
    (["revenue", "capex", "debt_drawdown", "development_costs", "dscr", "llcr", "plcr", "cfae"], (True, 5, "revenue|capex|debt_drawdown|development_costs|dscr", 1.0)), (["dscr", "llcr"], (True, 2, "dscr", 0.0)), (["other"], (False, 0, "", 0.0)),
])
def test_profile(spark, items, want):
    rows = spark.createDataFrame([(1, at, x, 2.0) for x in items for at in (1, 2)], "entity long, at long, item string, value double")
    r = lifecycle.profiles(rows).first()
    assert (r.is_project, r.indicators, r.signals, r.confidence) == want
    assert lifecycle.phases(rows, lifecycle.profiles(rows)).count() == (2 if "revenue" in items else 0)
