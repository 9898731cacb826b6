"""Sparse rule ensemble: tree paths become conjunctive rules over text statistics, a lasso picks and weighs them.

Fitting: a bounded sample of labelled texts (the sample_rows labelled ids of least hash; the only bound, a parameter)
gives statistics; small boosted trees are grown on subsamples; each path from a root to a node is a rule; an
L1-penalised logistic regression over the rules' indicators keeps few. Scoring: the rules are compiled into Spark column
expressions over the statistics, and the score is the logistic function of the weights of the rules that hold.

Null and empty texts have all statistics zero and are scored like any text. Repeated rows are scored each; of repeated
labels the largest counts; labels without a text or value are ignored. Without labelled rows all scores are 0.5; with
one class only, they lean to it. An empty table gives no rows. Language, source and ids are never read by a rule, and
columns that clash with the statistics' names are kept apart in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, sample_by_hash, slices
from .stats import BLANK, repeated_lines, repeated_words, words_of

FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "repeated_words", "lines", "line_words", "repeated_lines",
    "upper", "lower", "digits", "symbols", "pipes", "stops", "bangs", "commas", "quotes", "brackets", "other_ascii", "beyond_ascii", "capitalised",
)
#: Bytes counted for each of the features from upper on, but for the last; beyond_ascii and other_ascii are the rest.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "symbols": b"#$%&*+=@^~_\\", "pipes": b"|", "stops": b".", "bangs": b"!?", "commas": b",;:", "quotes": b"\"'`", "brackets": b"()[]{}<>/"}


def _class_matrix() -> np.ndarray:
    names = [*_CLASSES, "other_ascii", "beyond_ascii"]
    m = np.zeros((256, len(names)))
    for k, chars in enumerate(_CLASSES.values()):
        m[list(chars), k] = 1
    rest = m.sum(1) == 0
    rest[list(BLANK)] = False
    m[:128, len(_CLASSES)] = rest[:128]
    m[128:, len(_CLASSES) + 1] = rest[128:]
    return m


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; counts of characters and repeats are shares of the words."""
    words = words_of(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    n = np.array([len(x) for x in words], float)
    safe = np.maximum(n, 1)
    chars = np.stack([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in texts]) if texts else np.zeros((0, 256))
    classes = chars @ _class_matrix()
    inside = classes.sum(1)
    lines = [repeated_lines(x) for x in texts]
    out[:, 0] = n
    out[:, 1] = inside / safe
    out[:, 2] = [max(map(len, x), default=0) for x in words]
    out[:, 3] = [len(set(x)) for x in words] / safe
    out[:, 4] = repeated_words(words) / safe
    out[:, 5] = [x[0] for x in lines]
    out[:, 6] = n / np.maximum(out[:, 5], 1)
    out[:, 7] = [x[1] for x in lines] / np.maximum(out[:, 5], 1)
    out[:, 8:-1] = classes / np.maximum(inside, 1)[:, None]
    out[:, -1] = [sum(x[:1].isupper() for x in w) for w in words] / safe
    return out


@dataclass
class RuleModel:
    """Rules (conjunctions of (feature, above, threshold)) with weights."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * np.all([(x[:, f] > t) == above for f, above, t in rule], axis=0)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str) -> Column:
        """The score over a struct column that holds FEATURES."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, above, t in rule:
                x = F.col(f"{stats}.{FEATURES[f]}")
                holds &= (x > t) if above else (x <= t)
            z += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, rules: set) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value) of a tree of least squared loss; paths go to rules."""
    leaf = [(rows, float(grad[rows].sum() / (hess[rows].sum() + 1)))]
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, g, h = (1e-6, None, None), grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        b = bins[rows, f]
        n, sg, sh = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (None, g, h))
        ok = (n >= least) & (len(rows) - n >= least)
        gain = np.where(ok, sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - whole, 0)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, k)
    if best[1] is None:
        return leaf
    f, k = best[1], best[2]
    left = bins[rows, f] <= k
    out = []
    for above, part in ((False, rows[left]), (True, rows[~left])):
        longer = (*path, (f, above, float(cuts[f][k])))
        rules.add(longer)
        out += _grow(x, cuts, bins, grad, hess, part, depth - 1, least, longer, rules)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 12, penalty: float = 0.003, steps: int = 400, seed: int = 7) -> RuleModel:
    """Boosted trees on half samples for the rules, then logistic regression with an L1 penalty (proximal gradient with momentum)."""
    if not len(y):
        return RuleModel()
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    base = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return RuleModel(base)
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49), method="lower"))
        cuts.append(v[v < x[:, f].max()])
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rnd, z, rules = np.random.default_rng(seed), np.full(len(y), base), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rnd.permutation(len(y))[: max(2 * least, len(y) // 2)])
        own: set = set()
        _grow(x, cuts, bins, y - p, p * (1 - p), rows, depth, least, (), own)
        rules |= own
        for part, value in _leaves(x, own, y - p, p * (1 - p), rows):
            z[part] += rate * value
    paths = sorted(rules)
    on = np.stack([np.all([(x[:, f] > t) == above for f, above, t in r], axis=0) for r in paths], axis=1)
    _, first = np.unique(on, axis=1, return_index=True)  # of rules that hold on the same rows, one
    paths, a = [paths[i] for i in sorted(first)], on[:, sorted(first)].astype(np.float64)
    mean = a.mean(0)
    a -= mean
    bound = np.linalg.norm(a, 2) ** 2 / (4 * len(y)) + 0.25
    w, b, momentum, wv, bv = np.zeros(a.shape[1]), base, 1.0, np.zeros(a.shape[1]), base
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ wv + bv))) - y
        new = wv - (a.T @ r / len(y)) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / bound, 0)
        nb = bv - r.mean() / bound
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        wv, bv = new + (momentum - 1) / after * (new - w), nb + (momentum - 1) / after * (nb - b)
        w, b, momentum = new, nb, after
    return RuleModel(float(b - w @ mean), [(r, float(v)) for r, v in zip(paths, w) if abs(v) > 1e-4])


def _leaves(x: np.ndarray, rules: set, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """All rows by leaf of a tree given as its paths, with the value that the sampled rows give it."""
    out, sampled = [], np.zeros(len(x), bool)
    sampled[rows] = True
    for path in rules:
        if any(len(p) > len(path) and p[: len(path)] == path for p in rules):
            continue
        on = np.all([(x[:, f] > t) == above for f, above, t in path], axis=0)
        use = on & sampled
        out.append((on, float(grad[use].sum() / (hess[use].sum() + 1))))
    return out


def with_statistics(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    """docs and a struct column of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = statistics(as_bytes(batch, text))
            struct = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(FEATURES))], names=list(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {into} struct<{', '.join(f'{x}: double' for x in FEATURES)}>")


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    """Fit on at most sample_rows labelled rows (those of least hash of the id) for which use, a condition on id, holds.

    An id may have several texts: of those, too, only sample_rows rows reach the driver, by hash of the id and then by their statistics."""
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).dropna()
    if use is not None:
        rows = rows.where(use)
    chosen = sample_by_hash(rows.groupBy("_id").agg(F.max("_y").alias("_y")), "_id", sample_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = with_statistics(texts, "_text").select("_id", "_y", "_stats.*").orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(sample_rows)
    found = rows.toPandas().sort_values(["_id", *FEATURES])
    return fit(found[list(FEATURES)].to_numpy(float), found["_y"].to_numpy(float))


def _free(docs: DataFrame) -> str:
    """A name that no column of docs has, whatever its case."""
    name, taken = "_stats", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text", into: str = "score") -> DataFrame:
    """docs and its score."""
    columns, stats = [F.col(f"`{c}`") for c in docs.columns], _free(docs)
    return with_statistics(docs, text, stats).select(*columns, model.column(stats).alias(into))


def filter_good(docs: DataFrame, model: RuleModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least least."""
    stats = _free(docs)
    return with_statistics(docs, text, stats).where(model.column(stats) >= least).select([F.col(f"`{c}`") for c in docs.columns])
