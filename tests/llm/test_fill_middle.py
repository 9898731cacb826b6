"""Fill-in-the-middle rows against a plain form of the same rules, and the way back."""

import hashlib
import re

from tallyspark.llm import fill_middle

from .helpers import by_id, documents, texts


def plainly(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["<", "<S", "<<S>>", "a<P", "P>", "<M", "S>b", "<P>", "x <M> y", "x\0y\n\r\tz", "é𝒳日Á", "a'b\"c", "e" * 100_000 + " " * 50_000] * 8


def test_rows_equal_the_plain_form_and_come_back(spark):
    docs = documents(spark, texts() + ODD)
    got = by_id(fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored()))
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for i, text in enumerate(texts() + ODD):
        assert tuple(got[i][1:6]) == plainly(i, text)
        assert got[i]["back"] == (text or "")


def test_digests_are_those_of_the_texts(spark):
    docs = documents(spark, ODD)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, r in by_id(fill_middle.digests(docs)).items():
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(plainly(i, ODD[i])[-1]), sha(ODD[i]))


def test_order_partitions_and_repeated_rows_change_nothing(spark):
    docs = documents(spark)
    one = sorted(map(tuple, fill_middle.digests(docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, fill_middle.digests(docs.repartition(7)).collect()))
    assert len(one) == docs.count()


def test_null_ids_other_kinds_of_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "some words here", "a"), ("x'y", "some words here", "b")], "doc_id string, text string, form string")
    got = by_id(fill_middle.fill_in_middle(rows))
    assert tuple(got[None][1:]) == plainly(None, "some words here") and tuple(got["x'y"][1:]) == plainly("x'y", "some words here")
    assert fill_middle.digests(rows.where("false")).count() == 0
