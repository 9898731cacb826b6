import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lm

from .helpers import KIND, documents


def brute(rows, order=3, least=2, discount=0.75):
    """rows: (text, held out). Scores straight from the formulas."""
    words = [[*(t or "").encode().lower().split(), b"\n"] for t, _ in rows]
    train = [w for w, (_, h) in zip(words, rows) if not h]
    one = Counter(w for ws in train for w in ws)
    n, v = sum(one.values()), len(one)
    uni = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    grams, ctx = Counter(), Counter()
    for ws in train:
        run = [b"\t", *ws]
        for i in range(1, len(run)):
            for k in range(1, order):
                if i - k >= 0:
                    grams[tuple(run[i - k : i + 1])] += 1
                    ctx[tuple(run[i - k : i])] += 1
    kept = {g: c for g, c in grams.items() if c >= least}
    of = defaultdict(list)
    for g, c in kept.items():
        of[g[:-1]].append(c)

    def p(h, w):
        if not h:
            return uni(w)
        rest = p(h[1:], w)
        if h not in of:
            return rest
        back = 1 - sum((c - discount) / ctx[h] for c in of[h])
        return (kept[*h, w] - discount) / ctx[h] * ((*h, w) in kept) + back * rest if (*h, w) in kept else back * rest

    out = []
    for ws in words:
        run = [b"\t", *ws]
        out.append((len(ws), sum(w in one for w in ws), n, sum(math.log10(uni(w)) for w in ws), sum(math.log10(p(tuple(run[max(0, i - order + 1) : i]), run[i])) for i in range(1, len(run)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_formulas(spark, order):
    docs = documents(spark)
    rows = docs.collect()
    want = Counter()
    for r, x in zip(rows, brute([(r.text, r.doc_id % 10 == 3) for r in rows], order)):
        want[r.doc_id, r.doc_id % 10 == 3, *x[:3], round(x[3], 6), round(x[4], 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.scores(docs, F.col("doc_id") % 10 == 3, order=order).collect())
    assert got == want


def test_rare_words_are_counted_beyond_the_kept_ones(spark):
    docs = documents(spark)
    few, all_ = (lm.scores(docs, F.lit(False), share=s).select("doc_id", "n_known", F.round("base_score", 6)).collect() for s in (0.05, 1e-6))
    assert sorted(few) == sorted(all_)


def test_probabilities_add_up(spark):
    docs = documents(spark, ["a b a b c", "a b c d", "b a d", "a b a b"])
    training = docs.select("text")
    counts = lm.word_counts(training)
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    g = lm.kept_grams(training, counts, 2, 3)
    auto = lm.Automaton(g, lm.Base(n, v))
    vocabulary = {r.word for r in counts.collect()}
    kept = [i for i, w in enumerate(g.words) if i != lm.BEGIN_ID and (w in vocabulary)]
    rare = vocabulary - {g.words[i] for i in kept}
    unseen = sum(10 ** lm.Base(n, v).log(next(r.n for r in counts.collect() if r.word == w)) for w in rare) + 10 ** lm.Base(n, v).log(0)
    for context in ([], [kept[1]], [kept[1], kept[2]]):
        before = auto.score(context)
        total = sum(10 ** (auto.score([*context, w]) - before) for w in kept) + unseen * 10 ** (auto.score([*context, g.width - 1]) - before)
        assert abs(total - 1) < 1e-9


def test_empty(spark):
    assert lm.scores(spark.createDataFrame([], KIND), F.lit(False)).count() == 0
    r = lm.scores(documents(spark, ["a b"]), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_runs_of_any_length_give_the_same(spark, monkeypatch, order):
    texts = ["a b c a b d " * 40, "", "b", "x a b c", "c c c c a b c a b " * 7]
    training = documents(spark, texts).select("text")
    counts = lm.word_counts(training)
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    g = lm.kept_grams(training, counts, 2, order)
    auto = lm.Automaton(g, lm.Base(n, v))
    ids = [[i if i >= 0 else g.width - 1 for i in g.ids([*t.encode().split(), lm.END]).tolist()] for t in [*texts, "a b nothing c a b c d a"]]
    whole = [auto.score(x) for x in ids]
    for run in (order + 1, 5, 64):
        monkeypatch.setattr(lm, "RUN", run)
        flat, ends = lm.np.concatenate([lm.np.array(x) for x in ids]), lm.np.cumsum([len(x) for x in ids])
        assert auto.scores(flat, ends).tolist() == pytest.approx(whole, abs=1e-9)


def test_ngrams_seen_twice_are_kept_at_any_size(spark):
    rows = [("a b c", False), ("a b c", False), ("a b c", True), *((" ".join(["z"] * 50_000), False) for _ in range(42))]  # over 2 million tokens
    got = lm.scores(spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, h boolean"), F.col("h")).where("held_out").first()
    assert got.score == pytest.approx(brute(rows)[2][4], abs=1e-6)


def test_many_parts_give_the_same(spark, monkeypatch):
    docs = documents(spark)
    key = lambda rows: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    whole = key(lm.scores(docs, F.col("doc_id") % 10 == 3).collect())
    monkeypatch.setattr(lm, "BLOCK", 500)  # the driver's, which sets the parts
    assert key(lm.scores(docs, F.col("doc_id") % 10 == 3).collect()) == whole
