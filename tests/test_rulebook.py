"""Rules of a table against a plain reading of the same texts."""

import random

import pytest

from tallyspark.functions import rule_text
from tallyspark.operators import rulebook


def plain(text, data):
    """A side's value, straight from its text."""
    text = text.strip()
    try:
        return float(text)
    except ValueError:
        pass
    if text in data:
        return data[text]
    for op, do in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("/", lambda a, b: a / b if b else None)):
        if op == "-" and "+" in text or op not in text or text.count(op) != 1:
            continue
        a, b = (plain(x, data) for x in text.split(op))
        return None if a is None or b is None else do(a, b)
    return None


def test_sides_equal_the_plain_reading(spark):
    rnd = random.Random(2)
    names = ["a", "b", "c", "gone", "zero"]
    data = {"a": 4.0, "b": -2.5, "c": 10.0, "zero": 0.0}
    texts = ["-a", "a - -3", "1e2", ".5 * a", "a b", "a + b + c", "a - b + c", "a / b * c", "a * b + c - 1", "", "a / zero", "abs(a)"]
    texts += [f" {rnd.choice('+-*/')} ".join(rnd.choice([*names, "2", "0.5"]) for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    texts = ["".join(c if c not in "+-*/" else rnd.choice("+-*/") for c in t) if i % 2 else t for i, t in enumerate(texts)]
    row = spark.createDataFrame([(4.0, -2.5, 10.0, None, 0.0)], "a double, b double, c double, gone double, zero double")
    got = row.selectExpr(*[f"{rule_text.value(rule_text.side(t))} as v{i}" for i, t in enumerate(texts)]).first()
    for text, value in zip(texts, got):
        want = plain(text, data)
        assert value == (None if want is None else pytest.approx(want)), text


def checked(spark, rules, facts, items=()):
    facts = spark.createDataFrame([(1, *f) for f in facts], "k long, item string, value double")
    items = spark.createDataFrame(list(items), "item string, kind string, must_be_positive boolean")
    rules = spark.createDataFrame(rules, "item string, rule string, tolerance double, warning_only boolean, optional boolean")
    return {(r.item, r.rule): (r.passed, r.severity, r.actual, r.expected, r.upper, r.reason) for r in rulebook.validate(facts, items, rules, ["k"]).collect()}


FACTS = [("a", 100.0), ("b", 99.0), ("share", 54.5), ("half", 0.5), ("neg", -1.0)]


@pytest.mark.parametrize(("rule", "want"), [
    (("a", "a == b", 0.01, False, False), (True, "error", 100.0, 99.0, None, "checked")),
    (("a", "a == b", 0.009, True, False), (False, "warning", 100.0, 99.0, None, "checked")),
    (("half", "half == neg + 1.4", 0.2, False, False), (True, "error", 0.5, 0.3999999999999999, None, "checked")),
    (("share", "share == half", 0.05, None, None), (True, "error", 0.545, 0.5, None, "checked")),
    (("share", "share == half", 0.04, None, None), (False, "error", 0.545, 0.5, None, "checked")),
    (("a", "b <= a <= 100", None, False, False), (True, "error", 100.0, 99.0, 100.0, "checked")),
    (("a", "a >= gone", None, False, False), (True, "error", None, None, None, "not told")),
    (("a", "a >= gone", None, False, True), None),
    (("gone", "a >= b", None, False, False), None),
    (("a", "gone <= b <= 50", None, False, False), (True, "error", 99.0, None, 50.0, "checked")),
    (("a", "0 <= b <= 50", None, False, True), (False, "error", 99.0, 0.0, 50.0, "checked")),
    (("a", "a > b", None, False, False), (False, "warning", None, None, None, "unreadable")),
    (("a", "a == b == b", None, False, False), (False, "warning", None, None, None, "unreadable")),
    (("a", "it's a", None, False, True), None),
])
def test_one_rule(spark, rule, want):
    got = checked(spark, [rule], FACTS, [("share", "percentage", False)])
    assert got == ({} if want is None else {rule[:2]: tuple(pytest.approx(x) if isinstance(x, float) else x for x in want)})


def test_positive_items_and_summary(spark):
    items = [("a", None, True), ("neg", "currency", True), ("gone", None, True), ("b", None, None)]
    got = checked(spark, [("a", "a ? b", None, None, None)], FACTS, items)
    assert got[("neg", "must_be_positive")][:3] == (False, "error", -1.0) and got[("a", "must_be_positive")][0] and len(got) == 3
    facts = spark.createDataFrame([(1, "neg", -1.0)], "k long, item string, value double")
    meta, none = spark.createDataFrame(items, "item string, kind string, must_be_positive boolean"), spark.createDataFrame([], "item string, rule string, tolerance double, warning_only boolean, optional boolean")
    assert tuple(rulebook.summary(rulebook.validate(facts, meta, none, ["k"]), ["k"]).first()) == (1, 1, 0, 1, 1, 0, 0, 0)
    assert rulebook.validate(facts, meta.where("false"), none, ["k"]).count() == 0


def test_signs_leave_zero_and_unknown_items_out(spark):
    facts = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", 0.0), ("b", 1.0), ("c", 5.0), ("d", 5.0)], "item string, value double")
    items = spark.createDataFrame([("a", "positive"), ("b", "negative"), ("c", "varies"), ("e", None)], "item string, typical_sign string")
    got = sorted((r.item, r.value, r.passed, r.severity) for r in rulebook.signs(facts, items, ["b"]).collect())
    assert got == [("a", -1.0, False, "warning"), ("a", 1.0, True, "warning"), ("b", 1.0, False, "error")]
