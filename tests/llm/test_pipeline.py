import random
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import rule_ensemble, shingles, simhash, stages, toxicity

from .helpers import KIND, broadcast_joins, documents
from .test_quality import labelled
from .test_simhash import slow_components, slow_fingerprint

pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels, _ = labelled(spark)
    copies = docs.where("doc_id % 50 = 1").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars", "score", "fp")
    docs.unionByName(copies).unionByName(documents(spark, first=20_000)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_one_by_one_and_together(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]

    civil = stages.keep_civil(spark, docs, folder)
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("toxic").collect()}
    assert {r.doc_id for r in civil.collect()} == {r.doc_id for r in docs.collect()} - toxic
    good = stages.keep_good(spark, civil, folder)
    model = rule_ensemble.fit_quality(civil, labels)
    assert good.count() == rule_ensemble.score_quality(civil, model, into="s").where("s >= 0.5").count()
    once = stages.keep_one_of_each(spark, good, folder)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in good.collect()]
    least = slow_components(rows)
    assert sorted(r.doc_id for r in once.collect()) == sorted({least[f] for _, f in rows})
    for df in (civil, good, once):
        assert df.columns == columns
        sizes.append(df.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0

    spans = defaultdict(Counter)
    total = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        spans[r.doc_id].update(range(r.start, r.start + r.length))
        total[r.doc_id] = r.doc_tokens
    assert spans.keys() == {r.doc_id for r in once.collect()}
    assert all(spans[d] == Counter(range(n)) for d, n in total.items())


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d", "en", "s", 1, 0.1, "x"), (1, "a b c d", "en", "s", 1, 0.1, "x"), (2, "a b c d", "en", "s", 1, 0.1, "x")], KIND)
    assert Counter(r.doc_id for r in stages.keep_one_of_each(spark, docs, "").collect()) == Counter([None, 1])


def near_copies(seed=5):
    """Texts of 60 words, and copies of each with one to five words changed."""
    rnd = random.Random(seed)
    texts = [[f"w{rnd.randrange(5000)}" for _ in range(60)] for _ in range(30)]
    out = [" ".join(t) for t in texts]
    for i, t in enumerate(texts):
        copy = list(t)
        for at in rnd.sample(range(60), 1 + i % 5):
            copy[at] = "changed"
        out.append(" ".join(copy))
    return out


def test_near_copies_by_shingles_go(spark):
    texts = near_copies()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.1, "x") for i, t in enumerate(texts)], KIND)
    near = {j for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    bits = slow_components([(i, slow_fingerprint(t)) for i, t in enumerate(texts)])
    assert any(bits[slow_fingerprint(texts[j])] == j for j in near)  # two bits alone keep some of them
    gone = near | {i for i, t in enumerate(texts) if bits[slow_fingerprint(t)] != i}
    assert sorted(r.doc_id for r in stages.keep_one_of_each(spark, docs, "").collect()) == sorted(set(range(len(texts))) - gone)


def test_rows_with_arrays_are_not_broadcast(spark, monkeypatch):
    seen, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda found, pairs: seen.append(broadcast_joins(pairs)) or verified(found, pairs))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.1, "x") for i, t in enumerate(near_copies())], KIND)
    assert shingles.links(shingles.sets(docs, ["doc_id"])).count() and seen == [[], []]


def test_other_texts_of_the_same_id_stay(spark):
    texts = near_copies()[:3]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.1, "x") for i, t in ((1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (3, texts[2]))], KIND)
    assert Counter((r.doc_id, r.text) for r in stages.keep_one_of_each(spark, docs, "").collect()) == Counter([(1, texts[0]), (1, texts[1]), (3, texts[2])])


def test_empty(spark):
    docs = spark.createDataFrame([], KIND)
    assert stages.keep_one_of_each(spark, docs, "").count() == 0 and stages.pack(spark, docs, "").count() == 0
    assert simhash.near_duplicates(docs).count() == 0
