"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Grades are 0 to top. A text's features are its words, lower-cased and without symbols at their ends, and how these begin
(their first 4 to 8 bytes), hashed into 2^20 buckets, each with log(1 + count); the 4,096 buckets that differ most between toxic and other texts can
have weights. One weight vector is shared by all thresholds: P(grade > k) is the logistic function of w.x - theta_k, with
theta ascending. The expected severity is the sum of these probabilities over k.

The labels only say toxic or not. Their grades are set like this: 0 if not toxic; else by the number of markers
in the text, features whose share of toxic texts is at least lift times their share of others: the sample's toxic texts
are split into top equal parts by that number. Fitting uses a bounded sample (the sample_rows labelled ids of least hash, a parameter) and
an L1 penalty, so that few features have weights. Everything else covers all texts, whole.

Null and empty texts have no features and the severity of the intercept. Repeated rows are scored each; of repeated
labels the largest counts; repeated texts in the sample count once, and are counted in Spark: the driver gets the kept
features only. The cutoff of probability is the one that separates best a fourth of the sample from a model of the rest,
as the penalty draws probabilities towards the share of toxic texts. Without toxic labels nothing is toxic. An empty
table gives no rows. Other columns are ignored, and kept by filter_civil.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_bytes, sample_by_hash, slices, stash

BUCKETS = 1 << 20
#: Bytes of a word's beginnings.
BEGINNINGS = range(4, 9)
#: Buckets that can get a weight, and texts that must hold one.
KEEP, MIN_TEXTS = 4096, 5
#: Symbols that don't belong to a word at its ends.
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words whose bucket a worker remembers.
CACHED = 400_000


def features(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings; none for one of symbols only."""
    word = word.lower().strip(EDGES)
    if not word:
        return []
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"^" + word[:k]) % BUCKETS for k in BEGINNINGS if k <= len(word))]


@dataclass
class OrdinalModel:
    """weights by bucket, ascending thresholds, and the probability from which on a text counts as beyond a threshold."""

    weights: dict[int, float]
    thresholds: list[float]
    cutoff: float = 0.5

    def exceed(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(-(z[:, None] - np.array(self.thresholds)[None, :])))


class _Scorer:
    def __init__(self, model: OrdinalModel) -> None:
        self.model, self.known = model, {}

    def link(self, text: bytes) -> float:
        hits = Counter(chain.from_iterable(filter(None, map(self._look, text.split()))))
        return sum(self.model.weights[b] * np.log1p(n) for b, n in sorted(hits.items()))

    def _look(self, word: bytes) -> list[int] | None:
        """The word's buckets that have a weight."""
        known = self.known.get(word, False)
        if known is False:
            known = [b for b in features(word) if b in self.model.weights] or None
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[word] = known
        return known

    def links(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.link(x) for x in texts], float)


def fit(sizes: np.ndarray, col: np.ndarray, counts: np.ndarray, grades: np.ndarray, top: int, penalty: float = 0.002, steps: int = 300, min_texts: int = MIN_TEXTS, keep: int = KEEP) -> OrdinalModel:
    """sizes: features of each text; col, counts: their buckets and counts, text after text. Proximal gradient with momentum on the cumulative-link loss.

    Only the keep buckets whose share of toxic texts differs most from their share of others get a weight.
    """
    y = np.asarray(grades)
    theta = np.log((np.array([(y <= k).sum() for k in range(top)]) + 0.5) / (np.array([(y > k).sum() for k in range(top)]) + 0.5)) if len(y) else np.full(top, 8.0)
    theta = np.maximum.accumulate(theta + np.arange(top) * 1e-3)
    if not len(y) or not (y > 0).any() or not (y == 0).any():
        return OrdinalModel({}, [float(t) for t in theta])
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    in_toxic, in_all = np.bincount(col[(y > 0)[row]], minlength=BUCKETS), np.bincount(col, minlength=BUCKETS)
    gap = np.abs(in_toxic / (y > 0).sum() - (in_all - in_toxic) / (y == 0).sum())
    gap[in_all < min_texts] = -1
    best = np.sort(np.argsort(-gap, kind="stable")[:keep])
    best = best[gap[best] > 0]
    if not len(best):
        return OrdinalModel({}, [float(t) for t in theta])
    at = np.full(BUCKETS, -1)
    at[best] = np.arange(len(best))
    ok = at[col] >= 0
    row, val, col = row[ok], np.log1p(counts[ok]), at[col[ok]]
    n, scale = len(y), np.sqrt(np.bincount(col, val**2, len(best)) / len(y)) + 1e-3
    val = val / np.sqrt(scale[col])  # rare words keep a chance against the penalty
    above = (y[:, None] > np.arange(top)[None, :]).astype(float)
    w, t, momentum = np.zeros(len(best)), theta.copy(), 1.0
    wv, tv = w.copy(), t.copy()
    v = np.ones(len(best))
    for _ in range(30):  # the largest eigenvalue of x'x / n
        v /= np.linalg.norm(v)
        v = np.bincount(col, np.bincount(row, v[col] * val, n)[row] * val, len(best)) / n
    bound = top * (1.1 * np.linalg.norm(v) + 1) / 4
    for _ in range(steps):
        z = np.bincount(row, wv[col] * val, n)
        r = 1 / (1 + np.exp(-(z[:, None] - tv[None, :]))) - above  # gradient of the summed binary losses, thresholds tied by order
        new = wv - np.bincount(col, r.sum(1)[row] * val, len(best)) / n / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / bound, 0)
        nt = np.maximum.accumulate(tv + r.mean(0) / bound)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        wv, tv = new + (momentum - 1) / after * (new - w), nt + (momentum - 1) / after * (nt - t)
        w, t, momentum = new, nt, after
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return OrdinalModel({int(best[i]): float(w[i] / np.sqrt(scale[i])) for i in kept}, [float(x) for x in t])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, lift: float = 10.0, top: int = 3, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Fit on at most sample_rows labelled rows, those of least hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = []
            for x in as_bytes(batch, "_text"):
                c: Counter = Counter()
                for word, n in Counter(x.split()).items():
                    for b in features(word):
                        c[b] += n
                counts.append(sorted(c.items()))
            yield arrow({
                "_same": (batch.column("_same"), None), "_y": (batch.column("_y"), None),
                "_b": ([[b for b, _ in c] for c in counts], pa.list_(pa.int32())), "_n": ([[n for _, n in c] for c in counts], pa.list_(pa.int32())),
            })

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(b, n)) for b, n in zip(batch.column("_b").to_pylist(), batch.column("_n").to_pylist())]
            kept = [[b for b in row if b in best] for row in rows]
            yield arrow({
                "_same": (batch.column("_same"), None), "_y": (batch.column("_y"), None), "_hits": ([sum(b in marks for b in row) for row in rows], pa.int32()),
                "_b": (kept, pa.list_(pa.int32())), "_n": ([[row[b] for b in k] for k, row in zip(kept, rows)], pa.list_(pa.int32())),
            })

    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).dropna()
    chosen = sample_by_hash(rows.groupBy("_id").agg(F.max("_y").cast("int").alias("_y")), "_id", sample_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_y", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_same"), "_text")
    kind = "_same long, _y int, _b array<int>, _n array<int>"
    found = stash(texts.dropDuplicates(["_same", "_y"]).mapInArrow(run, kind), "features")
    first = found.select("_same", "_y").orderBy("_same", "_y").limit(sample_rows)  # an id may have several texts
    found = found.join(F.broadcast(first), ["_same", "_y"], "left_semi")
    n, n_yes = found.agg(F.count("*"), F.count_if(F.col("_y") > 0)).first()
    held = found.select("_y", F.explode("_b").alias("b")).groupBy("b").agg(F.count("*").alias("in_all"), F.count_if(F.col("_y") > 0).alias("yes")).withColumn("no", F.col("in_all") - F.col("yes"))
    best, marks = _best(held, n_yes, n - n_yes), _markers(held, n_yes, n - n_yes, lift)
    rows = found.mapInArrow(thin, "_same long, _y int, _hits int, _b array<int>, _n array<int>").toArrow().sort_by([("_same", "ascending"), ("_y", "ascending")])
    lists = rows["_b"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    col, counts, hits, same = (x.to_numpy() for x in (lists.flatten(), rows["_n"].combine_chunks().flatten(), rows["_hits"], rows["_same"]))
    toxic = rows["_y"].to_numpy() > 0
    edges = np.quantile(hits[toxic], np.arange(1, top) / top) if toxic.any() else []
    grades = np.where(toxic, 1 + np.searchsorted(edges, hits, side="left"), 0)
    model = fit(sizes, col, counts, grades, top)
    model.cutoff = _cutoff(sizes, col, counts, grades, top, same)
    return model


def _best(held: DataFrame, yes: int, no: int, keep: int = KEEP) -> set[int]:
    """Buckets (b, in_all, yes, no: texts that hold them) whose share of toxic texts differs most from their share of others."""
    gap = F.abs(F.col("yes") / max(1, yes) - F.col("no") / max(1, no))
    rows = held.where(F.col("in_all") >= MIN_TEXTS).select("b", gap.alias("gap")).where("gap > 0")
    return {r["b"] for r in rows.orderBy(F.desc("gap"), "b").limit(keep).collect()}


def _markers(held: DataFrame, yes: int, no: int, lift: float) -> set[int]:
    """Buckets whose share of toxic texts is at least lift times their (smoothed) share of the others, in enough toxic texts: at most 50 times the features of a text."""
    rare = F.col("yes") >= max(MIN_TEXTS, 0.02 * max(1, yes))
    return {r["b"] for r in held.where(rare & (F.col("yes") / max(1, yes) >= lift * (F.col("no") + 1) / (max(1, no) + 1))).select("b").collect()}


def _cutoff(sizes: np.ndarray, col: np.ndarray, counts: np.ndarray, grades: np.ndarray, top: int, same: np.ndarray) -> float:
    """The probability that separates toxic texts best (F1) on a fourth of the sample, by a model of the rest; of several the middle one."""
    held = same.view(np.uint64) % np.uint64(4) == 0
    at = held[np.repeat(np.arange(len(sizes)), sizes)]
    toxic = grades[held] > 0
    if not toxic.any() or toxic.all():
        return 0.5
    model = fit(sizes[~held], col[~at], counts[~at], grades[~held], top)
    weights = np.zeros(BUCKETS)
    weights[list(model.weights)] = list(model.weights.values())
    row = np.repeat(np.arange(len(toxic)), sizes[held])
    p = model.exceed(np.bincount(row, weights[col[at]] * np.log1p(counts[at]), len(toxic)))[:, 0]
    steps = np.arange(5, 96) / 100
    right = np.array([2 * (toxic & (p >= c)).sum() / max(1, toxic.sum() + (p >= c).sum()) for c in steps])
    best = steps[right == right.max()]
    return float(best[len(best) // 2])


def score_toxicity(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade (how many thresholds are exceeded with probability model.cutoff or more) and toxic (grade > 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in slices(batches):
            p = model.exceed(scorer.links(as_bytes(batch)))
            yield arrow({"doc_id": (batch.column("doc_id"), None), "expected_severity": (p.sum(1), pa.float64()), "grade": ((p >= model.cutoff).sum(1).astype(np.int32), pa.int32()), "toxic": (p[:, 0] >= model.cutoff, pa.bool_())})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_severity double, grade int, toxic boolean")


def filter_civil(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in slices(batches):
            keep = model.exceed(scorer.links(as_bytes(batch, text)))[:, 0] < model.cutoff
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
