import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality_rules, rule_ensemble, stats, toxicity

from .helpers import KIND, documents


def slow_counts(text):
    blank = set(" \t\n\v\f\r")
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


REPEATS = ["a b c d e f a b c d e g a b c d e", "x\nx\n x\nx\n\n\n", "one two three four five " * 9, "w " * 40, "a\x1cb c d e"]


def test_counts_equal_slow_ones(spark):
    docs = documents(spark, [*REPEATS, *[r.text for r in documents(spark).collect()]])
    want = Counter()
    for r in docs.collect():
        c = slow_counts(r.text)
        want[r.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]] += 1
    got = quality_rules.adaptive_rules(docs)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert all(not (r.kept and r.base_failed) for r in got.collect())
    assert quality_rules.adaptive_rules(spark.createDataFrame([], KIND)).count() == 0


def slow_bucket(x):
    extra = max(x.bit_length() - 6, 0)
    return extra * 32 + (x >> extra)


def test_buckets_keep_order_and_width(spark):
    rnd = random.Random(2)
    values = sorted({*range(3000), *(rnd.getrandbits(rnd.randint(1, 60)) for _ in range(2000))})
    rows = spark.createDataFrame([(v,) for v in values], "x long").select("x", quality_rules.bucket(F.col("x")).alias("b")).withColumn("least", quality_rules.least_in(F.col("b"))).orderBy("x").collect()
    assert [r.b for r in rows] == [slow_bucket(r.x) for r in rows] == sorted(r.b for r in rows)
    assert all(r.least <= r.x <= r.least * 33 / 32 + 1 for r in rows)


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(8)
    values = []
    for i in range(400):
        words = ["w" * rnd.randint(2, 9) + str(rnd.random()) for _ in range(rnd.randint(12, 60))]
        values.append(" ".join(w + "###" * (i % 19 == 0) for w in words) + "\n" + ("\nsame line here" * (i % 23 == 0) * 30))
    values += [" ".join(["x" * 5000, *(f"y{i}{j}" for j in range(12))]) for i in range(3)]
    docs = documents(spark, values)
    reach, least = 3, 20
    rows = {r.doc_id: r for r in quality_rules.adaptive_rules(docs, reach=reach, min_rows=least).collect()}
    facts = []
    for r in docs.collect():
        n, chars, symbols, dup, repeats = slow_counts(r.text)
        if n >= 10 and 100 * repeats <= 20 * n:
            facts.append((r.doc_id, r.lang, r.source, {"symbols": symbols * 10_000 // n, "dup_lines": dup * 10_000 // n, "repeats": repeats * 10_000 // n, "word_length": chars * 100 // n}))

    def quartile(vals, q):
        b = sorted(map(slow_bucket, vals))[-int(-q * len(vals) // 1) - 1]
        extra = max(b // 32 - 1, 0)
        return (b - extra * 32) << extra

    for doc, lang, source, s in facts:
        group = [f for f in facts if (f[1], f[2]) == (lang, source)]
        if len(group) < least:
            group = [f for f in facts if f[1] == lang]
        if len(group) < least:
            group = facts
        ok = True
        for k, (_, _, slack, lower) in quality_rules.RULES.items():
            q1, q3 = (quartile([f[3][k] for f in group], q) for q in (0.25, 0.75))
            ok &= s[k] <= q3 + reach * (q3 - q1) + slack and not (lower and s[k] < q1 - reach * (q3 - q1) - slack)
        assert rows[doc].kept == ok, (doc, s)
    assert {r.failed_rule for r in rows.values()} >= {"symbols", "word_length", None}


def test_statistics_of_odd_texts():
    x = rule_ensemble.statistics([b"", b" ", b"ab AB", "é|é".encode(), b"w " * 100_000])
    assert np.isfinite(x).all() and x[0].sum() == 0 and x[4][0] == 100_000
    assert stats.repeated_words([]).tolist() == [] and rule_ensemble.statistics([]).shape[0] == 0


def labelled(spark, n=900):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = [rnd.choice(["stone", "river", "Light", "and", "of"]) for _ in range(rnd.randint(5, 80))]
        if not good:
            words = [w + "$$" for w in words] if rnd.random() < 0.5 else [w.upper() + "!!" for w in words]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Vilename!", "rudeword", "slurish,"]))
        docs.append((i, " ".join(words) if i else None, "en", "s", 1, 0.1, "x"))
        labels.append((i, int(good), int(toxic)))
    labels += [(5, None, None), (None, 1, 0), (10**6, 1, 1), labels[7]]
    return spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {a: (b, c) for a, b, c in labels[:n]}


def test_rules_learn_and_compile(spark):
    docs, labels, truth = labelled(spark)
    model = rule_ensemble.fit_quality(docs, labels, F.col("_id") % 3 != 1)
    assert 0 < len(model.rules) < 200
    scored = rule_ensemble.score_quality(docs, model, into="quality_score").select("doc_id", "text", "quality_score", "score").collect()
    held = [(r.quality_score >= 0.5) == truth[r.doc_id][0] for r in scored if r.doc_id % 3 == 1]
    assert sum(held) / len(held) > 0.97 and {r.score for r in scored} == {0.1}
    x = rule_ensemble.statistics([(r.text or "").encode() for r in scored])
    assert np.allclose(model.score(x), [r.quality_score for r in scored])
    kept = rule_ensemble.filter_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.quality_score >= 0.5 for r in scored)


def test_rules_without_labels(spark):
    docs, labels, _ = labelled(spark, 20)
    model = rule_ensemble.fit_quality(docs, labels.where("false"))
    assert {r.s for r in rule_ensemble.score_quality(docs, model, into="s").collect()} == {0.5}
    assert rule_ensemble.score_quality(spark.createDataFrame([], KIND), model).count() == 0


def test_toxicity_grades(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert model.thresholds == sorted(model.thresholds)
    rows = toxicity.score_toxicity(docs, model).collect()
    right = [r.toxic == bool(truth[r.doc_id][1]) for r in rows]
    assert sum(right) / len(right) > 0.98
    by = {}
    for r in rows:
        assert 0 <= r.expected_severity <= 3 and r.toxic == (r.grade > 0)
        by.setdefault(r.grade, []).append(r.expected_severity)
    means = [np.mean(by[g]) for g in sorted(by)]
    assert means == sorted(means) and len(means) > 2
    kept = toxicity.filter_civil(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.toxic}


def test_toxicity_without_toxic_labels(spark):
    docs, labels, _ = labelled(spark, 30)
    for few in (labels.where("false"), labels.where("toxic = 0")):
        model = toxicity.fit_toxicity(docs, few)
        assert not any(r.toxic for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(spark.createDataFrame([], KIND), model).count() == 0
    assert toxicity.score_toxicity(documents(spark), model).count() == documents(spark).count()


@pytest.mark.parametrize("word", [b"", b"###", b"Word!", "Éa".encode()])
def test_features(word):
    found = toxicity.features(word)
    assert all(0 <= b < toxicity.BUCKETS for b in found) and (len(found) > 0) == any(chr(c).isalnum() or c > 127 for c in word)


def test_severity_equals_the_formula(spark):
    """Recomputed text by text from weights and thresholds."""
    docs, labels, _ = labelled(spark, 300)
    model = toxicity.fit_toxicity(docs, labels)
    assert model.weights and 0 < model.cutoff < 1
    for r, s in zip(docs.orderBy("doc_id").collect(), toxicity.score_toxicity(docs, model).orderBy("doc_id").collect(), strict=True):
        counts = {}
        for word in (r.text or "").encode().split():
            for b in toxicity.features(word):
                counts[b] = counts.get(b, 0) + 1
        z = sum(w * np.log(1 + counts[b]) for b, w in model.weights.items() if b in counts)
        p = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert s.expected_severity == pytest.approx(sum(p), abs=1e-9) and s.grade == sum(x >= model.cutoff for x in p)


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of one id Vilename" + "!" * (i % 3), None) for i in range(200)] + [(2, "fine words", "x")] * 50, "doc_id long, text string, _same string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, sample_rows=40)
    assert model.thresholds == sorted(model.thresholds) and toxicity.score_toxicity(docs, model).count() == 250


def test_statistics_keep_clashing_columns(spark):
    docs, labels, _ = labelled(spark, 60)
    docs = docs.withColumns({"_stats": F.lit("mine"), "_STATS_": F.lit(1)})
    model = rule_ensemble.fit_quality(docs, labels)
    assert rule_ensemble.score_quality(docs, model, into="s").select("_stats").distinct().first()[0] == "mine"
    assert rule_ensemble.filter_good(docs, model, least=0.0).columns == docs.columns


def test_texts_of_one_id_are_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rule_ensemble, "fit", lambda x, y: seen.append(len(y)) or rule_ensemble.RuleModel())
    docs = spark.range(200).selectExpr("id % 2 * 100 as doc_id", "repeat('word ', cast(id as int)) as text")
    labels = spark.createDataFrame([(0, 1), (100, 0), (100, 1)], "doc_id long, quality int")
    rule_ensemble.fit_quality(docs, labels, sample_rows=30)
    rule_ensemble.fit_quality(docs, labels, sample_rows=1000)
    assert seen == [30, 200]
