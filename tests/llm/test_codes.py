import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import codes, common


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.integers(0, 60))
def test_ascending_numbers_come_back(values, shift):
    x = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    assert codes.numbers(codes.ascending(x)).tolist() == x.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=60))
def test_squeezed_numbers_come_back(values):
    assert codes.spread(codes.squeezed(np.array(values, np.int64))).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.sampled_from([51, 2**40, 2**64]))
def test_grouped_is_unique(values, top):
    own, which = codes.grouped(np.array(values, np.uint64), top)
    assert own.tolist() == sorted(set(values)) and own[which].tolist() == values


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, how):
    left = spark.createDataFrame([(i, 7 if i % 2 else i % 40) for i in range(600)] + [(-1, None)], "i long, k long").repartition(5)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30)], "k long, v string")
    key = lambda df: sorted((r.i, str(r.k), str(r.v)) for r in df.select("i", "k", "v").collect())
    assert key(common.join_hot(left, right, "k", how)) == key(left.join(right, "k", how))
    assert key(common.join_hot(left.where(F.lit(False)), right, "k", how)) == []


def test_a_shared_folder_is_demanded_on_a_cluster(monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
