"""The audit of sources against one that writes every term and pair out."""

import re
from collections import Counter, defaultdict

from tallyspark.llm import divergence

from .helpers import documents, texts


def plainly(rows, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    share = lambda n, of, v: 1 + 10**9 * (n + 1) // (of + v)
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        v, of = len(kept), {s: sum(c[t] for t in kept) for (g, s), c in groups.items() if g == lang}
        total = {t: sum(groups[lang, s][t] for s in of) for t in kept}
        p = {s: {t: share(groups[lang, s][t], of[s], v) for t in kept} for s in of}
        q = {t: share(total[t], sum(total.values()), v) for t in kept}
        for s in of:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in of if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(docs, **more):
    return sorted(map(tuple, divergence.audit(docs, **more).collect()))


def plain_rows(docs):
    return [(r["text"], r["lang"], r["source"]) for r in docs.collect()]


def test_audit_equals_the_plain_one(spark):
    docs = documents(spark)
    assert audited(docs) == plainly(plain_rows(docs))
    assert audited(docs, top=3) == plainly(plain_rows(docs), 3)


def test_without_broadcast_and_with_small_counters(spark, monkeypatch):
    docs = documents(spark, texts(90, 5))
    monkeypatch.setattr(divergence, "SMALL", 0)
    monkeypatch.setattr(divergence, "HELD", 7)
    assert audited(docs) == plainly(plain_rows(docs))


def test_groups_without_terms_ties_and_one_source(spark):
    rows = [("a b", "en", "x")] * 3 + [("b a", "en", "y")] * 3 + [(None, "en", None), ("12 _", "en", "z"), ("only here", "de", "x"), ("", None, "x"), ("", None, "y"), ("Ä ä É [ ` { \x7f é", "fr", "x")] + [("Zß zß É", "fr", "y")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", divergence.F.lit(1))
    got = audited(docs)
    assert got == plainly(rows)
    assert ("", "x", "pair", "y", 0, 1) in got and not [r for r in got if r[0] == "de"]


def test_empty_table(spark):
    assert audited(documents(spark).where("false")) == []
