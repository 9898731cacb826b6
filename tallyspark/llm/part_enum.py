"""Texts whose sets of word shingles have a Jaccard similarity of at least 0.85, found by PartEnum signatures.

Two sets of sizes r and s are similar if they differ in at most 3 (r + s) / 37 shingles. Sizes are dealt into bands; in the
instance of a band, which holds all sets that can be similar to one of the band, similar sets differ in at most k. The
domain of shingles is cut by hash into n1 parts, each of these into n2 smaller ones. In some part similar sets differ in at
most k2 = k / n1 shingles, so they agree on some n2 - k2 of its smaller parts: a signature for each part and each such
subset (the band, the place and a hash of what the set holds there) lets them meet at least once. For large sets k + 1 parts
and k2 = 0 are the least signatures that still hold several shingles each, for small ones real subsets are; `scheme` picks.

A signature of no shingle or a single one would let many sets meet. So t parts more than needed are made: similar sets agree
in at least t + 1 parts then, and a set with at most t parts that have such a thin signature needn't give any of these. A set
with more gives all its signatures, and no pair is lost.

Equal sets are one. Of a signature's sets each is compared first with the one that meets others most for its size, one
comparison a set: in a group of near copies that is what they were copied from. Then components that meet are compared by
the likeliest pair of one's sets and members drawn from the signatures' most frequent component, one comparison for two
components: near copies that are unlike their centre are mostly like some other member. Then those that meet and aren't in
the same component yet are compared, where of a signature's sets those of the most frequent component aren't compared among
themselves. Sizes and the sets' parities (bits flipped by each shingle; they differ in no more places than the sets do) rule
pairs out before that; the last comparison, which meets sets in pairs, asks parities of as many bits as a set has shingles or
more, so that what comes out of its join is hardly less than 0.82 alike. Of signatures that the same sets give, one is kept.
Similarity is exact but for 64-bit hashes of words, shingles and sets, and 128-bit ones of signatures' sets.

Null, empty and blank texts have no shingles and link with nothing, not even with each other; a text of fewer words than a
shingle is one. Rows without an id have a result, but give no component its id; rows that share an id but not the text are
on their own. Repeated rows have a row each. Very long texts are taken whole. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import mixed
from .common import arrow, as_bytes, join_hot, pieces_of, stash
from .components import components

#: Words of a shingle; similarity in hundredths.
WIDTH, ALIKE = 4, 85
#: Bands grow by this ratio; bits of a signature; bytes of texts that are worked on together.
RATIO, SIGNATURE, AT_ONCE = 1.2, 48, 1 << 24
#: Longs of a set's parities.
PARITY = 4
#: Shingles for each long of the wide parities that the last comparison asks, and the least longs of these (powers of two).
EACH, WIDE = 64, 16
#: Bits of the filters that spare signatures of a single set the way to the others, and sets that meet no other the way to the comparison.
FILTER = 1 << 24


def shingles(text: bytes) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    flat = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WIDTH + 1)
    if not words:
        return flat
    keys = np.sort(reduce(mixed, [flat[k : k + n] for k in range(min(WIDTH, len(words)))]))
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


@lru_cache(None)
def bands(most: int) -> tuple[int, ...]:
    """Least sizes of the bands that hold sizes up to most, and of the one after them."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return tuple(out)


@lru_cache(None)
def scheme(low: int, high: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int] | None:
    """n1, n2, the subsets of n2 - k2 smaller parts, and t, for sets of low to high shingles; None if only equal ones are similar."""
    k = 2 * (100 - ALIKE) * high // (100 + ALIKE)
    found = []
    for k2 in range(4):
        for n2 in range(k2 + 1, 9) if k2 else [1]:
            least, subsets = k // (k2 + 1) + 1, math.comb(n2, k2)
            for t in [0, *range(1, least // 2 + 4, max(1, least // 64))]:
                held = low * (n2 - k2) / ((least + t) * n2)  # shingles of a signature
                thin = (least + t) * subsets * math.exp(-held) * (1 + held)
                if t and held >= 3 and t >= thin + 3 * math.sqrt(thin) + 1 or not t and held >= min(6, 0.75 * low):
                    found.append(((least + t) * subsets, k2, n2, least + t, t))
                    break
    if not k:
        return None
    _, k2, n2, n1, t = min(found, default=(0, 0, 1, k + 1, 0))
    return n1, n2, tuple(combinations(range(n2), n2 - k2)), t


def signatures(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which set (place in keys) and signature, for all signatures of the sets."""
    sizes = np.array([len(k) for k in keys], np.int64)
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    ends = np.cumsum(n)
    flat = np.concatenate([np.zeros(0, np.uint64), *(keys[i] for i in order)])
    whose, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = bands(int(n[-1]) if len(n) else 0)
    for band, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        low, high = -(-ALIKE * start // 100), stop - 1
        a, b = np.searchsorted(n, [low, high + 1])
        plan = scheme(low, high)
        if plan is None or b - a < 1:
            continue
        n1, n2, subsets, t = plan
        salt = mixed(np.array([band], np.uint64), np.array([0x5BD1E995], np.uint64))
        x = mixed(flat[ends[a] - n[a] : ends[b - 1]], salt)
        at = np.repeat(np.arange(b - a), n[a:b]) * (n1 * n2) + (x % np.uint64(n1 * n2)).astype(np.int64)
        held = np.bincount(at, minlength=(b - a) * n1 * n2).reshape(b - a, n1, n2)
        content = np.zeros((b - a) * n1 * n2, np.uint64)
        np.add.at(content, at, mixed(x, salt))
        content = content.reshape(b - a, n1, n2)
        count = np.stack([held[:, :, list(s)].sum(-1) for s in subsets], -1)
        said = np.stack([content[:, :, list(s)].sum(-1) for s in subsets], -1)
        thin = (count < 2).any(-1).sum(-1)
        given = (count >= 2) | (thin > t)[:, None, None]
        place = mixed(np.arange(n1 * len(subsets), dtype=np.uint64), salt).reshape(n1, len(subsets))
        whose.append(order[a:b][np.nonzero(given)[0]])
        out.append((mixed(said, place[None]) >> np.uint64(64 - SIGNATURE))[given].astype(np.int64))
    return np.concatenate(whose), np.concatenate(out)


def parities(key: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """So many longs, of which each shingle flips a bit."""
    bit = (key >> np.uint64(40)) % np.uint64(64 * longs)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=64 * longs) % 2 == 1, bitorder="little").view(np.int64)


def wide(key: np.ndarray) -> np.ndarray:
    """Parities of as many longs as the set's size asks for; of twice as many, halves that are XORed are those of the half."""
    return parities(key, max(WIDE, 1 << (max(1, -(-len(key) // EACH)) - 1).bit_length()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Pieces of the batches with the sets of their texts and hashes of these."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for piece in pieces_of(batch, AT_ONCE):
            keys = [shingles(x) for x in as_bytes(piece)]
            yield piece, keys, np.array([xxh64_intdigest(k.tobytes()) for k in keys], np.uint64).view(np.int64)


def _new(keys: list[np.ndarray], own: np.ndarray, met: set[int]) -> list[int]:
    """Places of sets that the task hasn't met yet, empty ones left out."""
    out = []
    for i, (key, x) in enumerate(zip(keys, own.tolist())):
        if len(key) and x not in met:
            met.add(x)
            out.append(i)
    return out


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of its set), own (the set's hash) and parities p0, p1, ... of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, keys, own in _sets(batches):
            flips = np.array([parities(k) for k in keys], np.int64).reshape(-1, PARITY)
            yield arrow({"doc_id": (piece.column("doc_id"), None), "n": ([len(k) for k in keys], pa.int64()), "own": (own, pa.int64())} | {f"p{k}": (flips[:, k], pa.int64()) for k in range(PARITY)})

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, own long" + "".join(f", p{k} long" for k in range(PARITY)))


def _bits(named: DataFrame, key: str) -> Broadcast:
    """A filter of FILTER bits, whatever the number of rows, with those of the keys set; _asked reads it."""
    words = named.select(F.expr(f"pmod({key}, {FILTER}) div 64").cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER / 64 rows at most
    bits = np.zeros(FILTER // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return named.sparkSession.sparkContext.broadcast(bits)


def _asked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[keys % FILTER // 64] >> (keys % 64)) & 1 == 1


def signature_rows(docs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """sig and own of every signature of every set; a task gives a set once. shared: the signatures asked for (sig); most others aren't sent then."""
    sent = _bits(shared, "sig") if shared is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for _, keys, own in _sets(batches):
            new = _new(keys, own, met)
            whose, sig = signatures([keys[i] for i in new])
            if sent is not None:
                asked = _asked(sent.value, sig)
                whose, sig = whose[asked], sig[asked]
            yield arrow({"sig": (sig, pa.int64()), "own": (own[new][whose], pa.int64())})

    return docs.select("text").mapInArrow(run, "sig long, own long")


def whole_sets(docs: DataFrame, owns: DataFrame) -> DataFrame:
    """own and whole (its shingles' hashes) of the sets named in owns (own). A filter keeps most others from being sent."""
    sent = _bits(owns, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for _, keys, own in _sets(batches):
            asked = _asked(sent.value, own)
            new = [i for i in _new(keys, own, met) if asked[i]]
            yield arrow({"own": (own[new], pa.int64()), "whole": ([keys[i].tobytes() for i in new], pa.binary())})

    return docs.select("text").mapInArrow(run, "own long, whole binary").join(owns, "own", "left_semi").groupBy("own").agg(F.first("whole").alias("whole"))


def _apart(a: str, b: str) -> Column:
    """In how many places parities differ, at most as many as there are shingles that only one set has."""
    return sum((F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(1, PARITY)), F.bit_count(F.col(f"{a}p0").bitwiseXOR(F.col(f"{b}p0"))))


def _fits(a: str, b: str) -> Column:
    """Sizes and parities that let two sets be similar. a, b: where their n and parities are."""
    n, m, apart = F.col(f"{a}n"), F.col(f"{b}n"), _apart(a, b)
    return (100 * F.least(n, m) >= ALIKE * F.greatest(n, m)) & ((100 + ALIKE) * apart <= (100 - ALIKE) * (n + m))


def _wides(wholes: DataFrame, owns: DataFrame) -> DataFrame:
    """own and wide (its wide parities) of the sets named in owns (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flips = [wide(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column("whole")]
            yield arrow({"own": (batch.column("own"), None), "wide": (flips, pa.list_(pa.int64()))})

    return wholes.join(owns, "own", "left_semi").mapInArrow(run, "own long, wide array<long>")


def _fits_widely(a: str, b: str) -> Column:
    """_fits of wide parities, for sets that fit: one of them may have twice as many longs."""
    x, y = F.col(f"{a}wide"), F.col(f"{b}wide")
    longs = F.least(F.size(x), F.size(y))
    xor = lambda p, q: p.bitwiseXOR(q)
    short = lambda c: F.when(F.size(c) == longs, c).otherwise(F.zip_with(F.slice(c, 1, longs), F.slice(c, longs + 1, longs), xor))
    apart = F.aggregate(F.zip_with(short(x), short(y), xor), F.lit(0), lambda have, v: have + F.bit_count(v))
    return (100 + ALIKE) * apart <= (100 - ALIKE) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _verified(wholes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are similar. The set of a moves to b, of which many pairs may be; Spark splits such a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, last, one = [], None, np.zeros(0, np.uint64)
            for x, y in zip(batch.column("b_whole"), batch.column("a_whole")):
                x, y = x.as_buffer(), np.frombuffer(y.as_buffer(), np.uint64)
                if last is None or x != last:
                    last, one = x, np.frombuffer(x, np.uint64)
                both = len(np.intersect1d(one, y, assume_unique=True))
                near.append(100 * both >= ALIKE * (len(one) + len(y) - both))
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    of = lambda c: wholes.select(F.col("own").alias(c), F.col("whole").alias(f"{c}_whole"))
    return stash(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_whole", "b_whole").mapInArrow(run, "a long, b long"), "near")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links a, b between sets (own) that connect all similar ones; rows: set_rows of docs (text)."""
    shared = stash(signature_rows(docs).groupBy("sig").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least != most").select("sig"), "shared")
    hits = stash(signature_rows(docs, shared).join(shared, "sig", "left_semi").distinct(), "hits")
    flips = [f"p{k}" for k in range(PARITY)]
    sizes = rows.where("n > 0").groupBy("own").agg(*[F.first(c).alias(c) for c in ("n", *flips)])
    owns = stash(hits.groupBy("own").agg(F.count("*").alias("meets")).join(sizes, "own").select("own", "n", *flips, (F.col("meets") / F.col("n")).alias("share")), "owns")
    # near copies share many signatures; of those that the same sets give, one is enough
    same = hits.groupBy("sig").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("own")).alias("x"), F.bit_xor(F.xxhash64("own", F.lit(1))).alias("y"))
    hits = stash(hits.join(same.groupBy("sets", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig").join(owns, "own"), "met")
    wholes = stash(whole_sets(docs, owns.select("own")), "wholes")

    centre = hits.groupBy("sig").agg(F.max(F.struct("share", "own", "n", *flips)).alias("centre"))
    stars = hits.join(centre, "sig").where((F.col("own") != F.col("centre.own")) & _fits("", "centre.")).groupBy(F.col("own").alias("a")).agg(F.max("centre").alias("centre")).select("a", F.col("centre.own").alias("b"))
    stars = stash(stars, "stars")
    first = _verified(wholes, stars)

    roots = components(first).withColumnRenamed("node", "own")
    rooted = stash(hits.join(roots, "own", "left").withColumn("root", F.coalesce("root", "own")), "rooted")
    most = rooted.groupBy("sig", "root").count().groupBy("sig").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("sig", "most")
    several = stash(rooted.join(most, "sig"), "several")

    # what its centre didn't link meets one member of its signature's largest component, another one for each signature; one comparison for two components
    member = several.where("root = most").groupBy("sig").agg(F.max(F.struct(F.xxhash64("sig", "own").alias("h"), "own", "n", *flips)).alias("member"))
    likely = F.min_by(F.struct(F.col("own").alias("a"), F.col("member.own").alias("b")), _apart("", "member.") / (F.col("n") + F.col("member.n")))
    tried = several.where("root != most").join(member, "sig").where(_fits("", "member.")).groupBy("root", "most").agg(likely.alias("pair")).select("pair.*", "root", "most")
    tried = stash(tried, "tried")
    second = _verified(wholes, tried.select("a", "b").distinct())
    joined = components(tried.join(second, ["a", "b"], "left_semi").select(F.col("root").alias("a"), F.col("most").alias("b")))
    for c in ("root", "most"):
        several = several.join(joined.select(F.col("node").alias(c), F.col("root").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    several = stash(several.where("root != most").select("sig").distinct().join(several, "sig"), "several")
    several = several.select("sig", "own", "root", "most", "n", *flips).join(stash(_wides(wholes, several.select("own").distinct()), "wides"), "own")
    a, b = several.where("root != most").alias("a"), several.alias("b")
    once = (F.col("b.root") == F.col("b.most")) | (F.col("a.own") < F.col("b.own"))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.root") != F.col("b.root")) & once & _fits("a.", "b.") & _fits_widely("a.", "b.")).select(F.col("a.own").alias("a"), F.col("b.own").alias("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known = stars.unionByName(tried.select("a", "b"))
    rest = pairs.join(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    return first.unionByName(second).unionByName(_verified(wholes, rest))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links, itself included) of each row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stash(set_rows(docs), "rows")
    found = stash(components(links(docs, rows)), "components")
    members = found.select(F.col("node").alias("own"), "root").unionByName(found.select(F.col("root").alias("own"), "root").distinct())  # roots are members too
    firsts = rows.where("n > 0").groupBy("own").agg(F.min("doc_id").alias("first")).join(members, "own", "left").select("own", "first", F.coalesce("root", "own").alias("root"))
    firsts = stash(firsts, "firsts")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = join_hot(firsts.select("own", "root"), least, "root").select("own", "component_id")
    texts = join_hot(rows.where("n > 0").select("doc_id", "n", "own"), classes, "own").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return texts.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
