"""PartEnum signatures and the classes they give against brute force."""

import random

import numpy as np

from tallyspark.llm import part_enum
from tallyspark.llm.part_enum import F

from .helpers import by_id, documents


def shingles(text, width=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return bool(a) and 100 * len(a & b) >= 85 * len(a | b)


def components(values):
    sets, least = [shingles(t) for t in values], list(range(len(values)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [root(i) for i in range(len(sets))]


def corpus(seed, n=260):
    """Texts of all sizes, copies with few and with many changed words, copies of copies, shared passages, repeated words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    out = [None, "", "  ", "one", "One", "one two", "one two three", "a a a a a a a", "a a a a a"]
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.45 or not out[9:]:
            words = rnd.choices(vocabulary, k=int(10 ** rnd.uniform(0.5, 2.8)))
            if rnd.random() < 0.3:
                at = rnd.randrange(len(words) + 1)
                words[at:at] = passage
        else:
            words = rnd.choice(out[9:]).split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3, max(1, len(words) // 40)])):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.randrange(2)] = rnd.choices(vocabulary, k=rnd.randrange(2))
        out.append(" ".join(words) or "x")
    return out


def test_similar_sets_share_a_signature():
    rnd, pairs, lost = random.Random(1), 0, 0
    for size in [*range(5, 90), 150, 300, 700, 1500]:
        for _ in range(6):
            common = rnd.sample(range(1 << 60), size)
            k = rnd.randint(0, max(1, size // 5))
            one, two = set(common[rnd.randint(0, k) :]) | set(rnd.sample(range(1 << 60), rnd.randint(0, k))), set(common)
            if not alike(one, two) or one == two:
                continue
            whose, sig = part_enum.signatures([np.array(sorted(x), np.uint64) for x in (one, two)])
            pairs, lost = pairs + 1, lost + (not set(sig[whose == 0]) & set(sig[whose == 1]))
    assert pairs > 150 and not lost


def test_sets_with_many_thin_parts_meet_too(monkeypatch):
    """Schemes with hardly any shingles for a signature: all are given then."""
    monkeypatch.setattr(part_enum, "scheme", lambda low, high: (2 * (6 * high // 37) + 3, 1, ((0,),), 1))
    test_similar_sets_share_a_signature()


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        values = corpus(seed)
        got = by_id(part_enum.similar_texts(documents(spark, values)))
        want = components(values)
        assert len(set(want)) < 0.8 * len(want)
        for i, text in enumerate(values):
            assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(shingles(text)), want[i])


def test_group_of_near_copies_whose_copies_are_not_alike(spark):
    """All copies are near what they were copied from, most not near each other."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    values = []
    for i in range(90):
        words = list(base)
        for at in rnd.sample(range(10, 110), 2):
            words[at] = f"x{i}_{at}"
        values.append(" ".join(words))
    values.append(" ".join(base))
    got = by_id(part_enum.similar_texts(documents(spark, values)))
    assert [got[i]["component_id"] for i in range(91)] == components(values) == [0] * 91


def test_rows_without_ids_repeated_ids_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(None, long), (7, long + " end"), (7, "other words in this text"), (9, "other words in this text"), (None, None), (3, "")], "doc_id long, text string").withColumn("own", F.lit("x"))
    got = sorted(map(str, part_enum.similar_texts(rows).collect()))
    assert got == sorted(f"Row(doc_id={a}, n_shingles={n}, component_id={c})" for a, n, c in [(None, 47, 7), (7, 48, 7), (7, 2, 7), (9, 2, 7), (None, 0, None), (3, 0, 3)])
    assert part_enum.similar_texts(rows.where("false")).count() == 0


def test_copies_unlike_their_centre_are_not_compared_with_all_others(spark, monkeypatch):
    """Copies with two or three changes each, without what they were copied from: four changes apart is alike, six are not."""
    rnd = random.Random(8)
    values = []
    for i in range(150):
        words = [f"b{k}" for k in range(200)]
        for at in rnd.sample(range(5, 195, 5), rnd.choice([1, 2, 2, 3])):
            words[at] = f"x{i}_{at}"
        values.append(" ".join(words))
    compared, verified = [], part_enum._verified
    monkeypatch.setattr(part_enum, "_verified", lambda wholes, pairs: compared.append(pairs.count()) or verified(wholes, pairs))
    got = by_id(part_enum.similar_texts(documents(spark, values)))
    assert [got[i]["component_id"] for i in range(150)] == components(values)
    assert sum(compared) <= 3 * len(values)


def test_members_just_not_alike_are_ruled_out_by_the_join(spark, monkeypatch):
    """Copies with five changes each, ten apart: similarities of about 0.82, which parities of 256 bits don't tell from 0.85."""
    rnd = random.Random(5)
    values = []
    for i in range(70):
        words = [f"b{k}" for k in range(400)]
        for at in rnd.sample(range(5, 395, 5), 5):
            words[at] = f"x{i}_{at}"
        values.append(" ".join(words))
    compared, verified = [], part_enum._verified
    monkeypatch.setattr(part_enum, "_verified", lambda wholes, pairs: compared.append(pairs.count()) or verified(wholes, pairs))
    got = by_id(part_enum.similar_texts(documents(spark, values)))
    assert [got[i]["component_id"] for i in range(70)] == components(values)
    assert compared[-1] <= len(values)


def test_wide_parities_fold_and_never_rule_out_alike_sets(spark):
    rnd = random.Random(6)
    rows = []
    for size in [5, 900, 1020, 1024, 1025, 1100, 2048, 2100, 5000]:
        common = [rnd.getrandbits(63) for _ in range(size)]
        for k in (0, size // 30, 15 * size // 200):
            one, two = np.array(sorted(common[k:]), np.uint64), np.array(sorted(common + [rnd.getrandbits(63) for _ in range(k)]), np.uint64)
            both = len(set(one.tolist()) & set(two.tolist()))
            if 100 * both >= 85 * (len(one) + len(two) - both):
                rows.append((len(one), part_enum.wide(one).tolist(), len(two), part_enum.wide(two).tolist()))
    assert len(rows) > 15 and any(len(r[1]) != len(r[3]) for r in rows)
    df = spark.createDataFrame(rows, "n long, wide array<long>, m long, other array<long>").select(F.struct("n", "wide").alias("a"), F.struct(F.col("m").alias("n"), F.col("other").alias("wide")).alias("b"))
    assert df.where(part_enum._fits_widely("a.", "b.")).count() == len(rows)
