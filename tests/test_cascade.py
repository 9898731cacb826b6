"""The whole cascade against a walk over its labels, one by one."""

import random

import pytest

from tallyspark.functions import text
from tallyspark.operators import cascade as op

SHEETS = {"P&L 2024": "income_statement", "Balance Sheet": "balance_sheet", "Debt": "debt_schedule", "Notes": None, None: None}
CATEGORIES = {"revenue": "income_statement", "net_revenue": "income_statement", "cost": "income_statement", "cash": "balance_sheet", "total_cash": "balance_sheet", "loan": "debt_schedule", "gone": "debt_schedule"}
LABELS = ["Revenue", "Net Revenue", "net-revenue", " cash ", "Cash & banks", "Loan", "1. Loans", "costs", "Cost", "Total cash", "zzz", "Revenues", "  ", "Totalcash (USD)", "Gone"]


def made(seed):
    rnd = random.Random(seed)
    items = [(rnd.choice(LABELS), rnd.choice(list(SHEETS)), rnd.choice([None, None, "", *set(CATEGORIES.values())]), i) for i in range(rnd.randint(1, 60))]
    aliases = []
    for i in range(rnd.randint(0, 30)):
        name = rnd.choice(list(CATEGORIES))
        aliases.append((rnd.choice(["Revenue", "net revenue", "CASH", "cash & banks", "loan", "loans", "cost", "total cash", "gone", " "]), name, CATEGORIES[name], rnd.choice([None, 1, 1, 2, 3]), i))
    say = lambda share, names: [(x, rnd.choice(names), rnd.randint(0, 100) / 100) for x in LABELS + ["nowhere"] if rnd.random() < share]
    names = list(CATEGORIES)
    return items, aliases, say(0.3, names), say(0.3, names), say(0.7, [*names, "unmapped", "made_up"]), [("gone", "loan"), ("loan", "cash"), ("unmapped", "cash")]


def walk(items, aliases, patterns, vectors, mapper, redirects, least):
    entries = {}
    for alias, name, category, priority, _ in aliases:
        if alias.strip():
            entries.setdefault(alias.lower().strip(), []).append((name, category, priority))
    vocabulary, out = {k: v for k, v in CATEGORIES.items() if k != "cost"}, {}
    said = lambda rows, low: {x: (n, c) for x, n, c in sorted(rows, key=lambda r: (r[2], [-ord(ch) for ch in r[1]])) if c >= low}
    stages = [("pattern", said(patterns, 0.95)), ("vector", said(vectors, 0.5)), ("mapper", said(mapper, 0))]
    for label in {x[0] for x in items}:
        met = []
        for _, sheet, section, _ in (x for x in items if x[0] == label):
            category = section or SHEETS[sheet]
            if category and category not in met:
                met.append(category)
        method, (name, sure) = next(((m, s[label]) for m, s in stages if label in s), ("mapper", ("unmapped", 0.0)))
        by, found = None, entries.get(label.lower().strip(), [])
        if method == "mapper":
            if name not in vocabulary and name != "unmapped":
                name, sure = "unmapped", 0.0
            name, by = settle(label, name, met, found)
            if name == "unmapped" and least is not None:
                name, sure, method, by = similar(label, sure, met, entries, least, method, by)
        was = name
        name = dict(redirects).get(name, name) if name != "unmapped" else name
        out[label] = (label, name, round(sure, 6), method, by, was if was != name else None, vocabulary.get(name, "unknown"))
    return out


def settle(label, name, met, found):
    def by_priority(rows, category):
        known = {}
        for n, c, p in found:
            if c == category and p is not None:
                known[n] = min(p, known.get(n, p))
        ranks = [known.get(n, 999) for n, _, _ in rows]
        if not known or ranks.count(min(ranks)) > 1:
            return None
        return rows[ranks.index(min(ranks))][0]

    rows_of = lambda category: [r for r in found if r[1] == category]
    if name == "unmapped":
        for category in met:
            rows = rows_of(category)
            if len(rows) == 1:
                return rows[0][0], "rescued"
            if len(rows) > 1 and by_priority(rows, category):
                return by_priority(rows, category), "rescued_priority"
        return (found[0][0], "rescued_global") if len(found) == 1 else (name, None)
    own = next((c for n, c, _ in found if n == name), None)
    if own not in met:
        for category in met:
            rows = rows_of(category)
            if len(rows) == 1 and rows[0][0] != name:
                return rows[0][0], "category"
    for category in met:
        rows = rows_of(category)
        if len(rows) > 1:
            winner = by_priority(rows, category)
            if winner and winner != name:
                return winner, "priority"
            plain, best, most = label.lower().replace("&", "and").replace("-", " ").strip(), None, 0
            for n, _, _ in rows:
                words = n.replace("_", " ")
                score = 100 if words == plain else 50 + len(words) if words in plain or plain in words else 0
                if score > most:
                    best, most = n, score
            if best and best != name:
                return best, "name"
    return name, None


PLAIN = {"1. Loans": "loans", "Totalcash (USD)": "totalcash"}


def similar(label, sure, met, entries, least, method, by):
    plain = PLAIN.get(label, label.lower().strip())
    tokens = lambda x: " ".join(sorted(x.replace("-", " ").split()))
    scores = sorted((-text.indel(tokens(plain), tokens(alias)), alias) for alias in entries) if plain else []
    if scores and -scores[0][0] >= least:
        found = entries[scores[0][1]]
        rows = [r for r in found if met and r[1] == met[0]]
        one = rows if rows else found
        if len(one) == 1:
            return one[0][0], round(-scores[0][0] / 100, 3), "fuzzy_alias", "fuzzy_alias"
    return "unmapped", sure, method, by


def run(spark, case, least, asked=None):
    items, aliases, patterns, vectors, mapper, redirects = case
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)

    def give(name, rows):
        def stage(rest):
            if asked is not None:
                asked[name] = {r.label for r in rest.collect()}
            return frame(rows, "label string, canonical_name string, confidence double")

        return stage

    got = op.cascade(
        frame(items, "label string, sheet string, section_category string, seq long"), [("pattern", give("pattern", patterns), 0.95), ("vector", give("vector", vectors), 0.5)], give("mapper", mapper),
        frame([(k, v) for k, v in CATEGORIES.items() if k != "cost"], "canonical_name string, category string"),
        frame(aliases, "alias string, canonical_name string, category string, priority int, seq long"), frame(redirects, "name string, target string"), least,
    ).collect()
    assert len({r.label for r in got}) == len(got)
    return {r.label: (r.label, r.canonical_name, round(r.confidence, 6), r.method, r.resolved_by, r.redirected_from, r.category) for r in got}


#: Seeds whose cases have every rule between them.
@pytest.mark.parametrize("seed, least", [(368, 80.0), (116, None), (0, 60.0), (1, 80.0)])
def test_cascade_equals_a_walk(spark, seed, least):
    case, asked = made(seed), {}
    got, want = run(spark, case, least, asked), walk(*case, least)
    assert got == want
    mappers = {x for x, r in want.items() if r[3] in ("mapper", "fuzzy_alias")}
    assert asked["mapper"] == mappers and asked["pattern"] == set(want) and mappers <= asked["vector"] <= set(want)


def test_empty_tables_and_nulls(spark):
    nothing = ([], [], [], [], [], [])
    assert run(spark, nothing, 80.0) == {}
    items = [(None, None, None, 1), ("x", None, None, 2), ("x", "P&L", None, 3)]
    assert run(spark, (items, [], [], [("x", None, 0.9)], [(None, "cash", 0.9), ("x", "cash", None)], []), 80.0) == {"x": ("x", "unmapped", 0.0, "mapper", None, None, "unknown")}


def test_two_entries_of_a_name_have_no_only_one(spark):
    items = [("Revenue", "P&L", None, 1)]
    entry = ("revenue", "revenue", "income_statement", 1)
    assert run(spark, (items, [(*entry, 1)], [], [], [], []), None)["Revenue"][4] == "rescued"
    assert run(spark, (items, [(*entry, 1), (*entry, 2)], [], [], [], []), None)["Revenue"][1] == "unmapped"


def test_sheets_have_the_first_category_that_fits(spark):
    rows = spark.createDataFrame([("Cash Flow & Debt",), ("DEBT SCHEDULE",), ("Sheet1",), (None,)], "s string")
    assert [r[0] for r in rows.select(text.sheet_category(rows.s)).collect()] == ["cash_flow", "debt_schedule", None, None]


def test_items_and_aliases_are_read_once(spark):
    items, aliases, *given = made(368)
    read = {name: spark.sparkContext.accumulator(0) for name in ("items", "aliases")}

    def counted(rows, name):
        count = read[name]
        return spark.sparkContext.parallelize(rows, 2).map(lambda r: count.add(1) or r)

    got, want = run(spark, (counted(items, "items"), counted(aliases, "aliases"), *given), 80.0), run(spark, (items, aliases, *given), 80.0)
    assert got == want and {k: v.value for k, v in read.items()} == {"items": len(items), "aliases": len(aliases)}
