"""Token counts by a map-side lookup in two tiers.

Tier one: a compact table, broadcast, of the lengths of frequent pre-tokens. Tier two: the library encodes what the
table misses, once for each worker, whose cache is bounded. No pre-token is shuffled: to choose tier one, each task
packs the most frequent pre-tokens of its rows into one sketch of bounded size, and the sketches are merged.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; an empty table gives none.
Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_text, slices
from .pieces import check_model, processor, segments

#: Entries of tier one, entries a task's sketch holds while it counts and when it is done, groups of sketches, entries
#: of a worker's cache. They bound memory and don't change results.
FREQUENT, COUNTING, SKETCH, MERGES, CACHED = 32_768, 200_000, 4_096, 64, 600_000


def _lighter(counts: Counter, keep: int) -> Counter:
    """The keep heaviest, less the weight of the heaviest that goes, so that sums of sketches stay lower bounds."""
    if len(counts) <= keep:
        return counts
    top = counts.most_common(keep + 1)
    floor = top[-1][1]
    return Counter({k: n - floor for k, n in top[:-1] if n > floor})


def _pack(counts: Counter) -> bytes:
    return zlib.compress(json.dumps(counts.most_common(SKETCH)).encode(), 1)


def _unpack(data: bytes) -> dict[str, int]:
    return dict(json.loads(zlib.decompress(data)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts: Counter = Counter()
    for batch in slices(batches):
        counts.update(chain.from_iterable(map(segments, as_text(batch))))
        if len(counts) > COUNTING:
            counts = _lighter(counts, COUNTING // 2)
    yield arrow({"part": ([TaskContext.get().partitionId() % MERGES], pa.int32()), "sketch": ([_pack(counts)], pa.binary())})


def _merge(key, frame):
    import pandas as pd

    counts: Counter = Counter()
    for data in frame["sketch"]:
        counts.update(_unpack(data))
        if len(counts) > COUNTING:
            counts = _lighter(counts, COUNTING // 2)
    return pd.DataFrame({"sketch": [_pack(counts)]})


def frequent_pretokens(docs: DataFrame, text: str = "text", keep: int = FREQUENT) -> list[str]:
    """About the keep most frequent pre-tokens of all texts; MERGES sketches of SKETCH entries reach the driver."""
    sketches = docs.select(F.col(text).alias("text")).mapInArrow(_sketch, "part int, sketch binary").groupBy("part").applyInPandas(_merge, "sketch binary")
    counts: Counter = Counter()
    for row in sketches.toLocalIterator():
        counts.update(_unpack(row["sketch"]))
    return [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]]


class _Lengths:
    """Lengths by pre-token: the broadcast table, and the misses of this worker up to a bound."""

    def __init__(self, frequent: dict[str, int], path: str) -> None:
        self.frequent, self.sp = frequent, processor(path)
        self.known = dict(frequent)
        self.lone = len(lone_space(self.sp))

    def totals(self, texts: list[str]) -> list[int]:
        parts = [segments(x) for x in texts]
        missing = set(chain.from_iterable(parts)).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > len(self.frequent) + CACHED:
                self.known = dict(self.frequent)
                missing = set(chain.from_iterable(parts)).difference(self.known)
            keys = list(missing)
            self.known.update(zip(keys, map(len, self.sp.encode(keys, num_threads=1))))
            if "" in missing:
                self.known[""] = self.lone
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in parts]


def lone_space(sp) -> list[int]:
    """The ids of a last space: encoded alone, a text has its own space in front."""
    return sp.encode("a ")[len(sp.encode("a")) :]


_worker: dict = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs, as the library counts them without begin and end."""
    check_model(model)
    sc = docs.sparkSession.sparkContext
    frequent = frequent_pretokens(docs, text)
    sp = processor(model)
    lengths = [len(x) for x in sp.encode(frequent, num_threads=1)]
    lengths = [len(lone_space(sp)) if k == "" else n for k, n in zip(frequent, lengths)]
    tier_one = sc.broadcast((frequent, lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("of") != (tier_one.value is not None and id(tier_one.value), model):
            _worker.update(of=(id(tier_one.value), model), lengths=_Lengths(dict(zip(*tier_one.value)), model))
        lengths = _worker["lengths"]
        for batch in slices(batches):
            texts = as_text(batch)
            n = lengths.totals(texts)
            yield arrow({
                "doc_id": (batch.column("doc_id"), None),
                "n_bytes": ([len(x) if x.isascii() else len(x.encode()) for x in texts], pa.int64()),
                "n_tokens": (n, pa.int64()),
                "over_limit": ([x > limit for x in n], pa.bool_()),
            })

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
