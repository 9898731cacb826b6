"""Near copies by word shingles: pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

No pair is lost. In any order of all shingles, sets of similarity s share one of the first n - ceil(s n) + 1 of each (n:
its size). The order here is by the number of sets that hold a shingle, the rarest first, then by hash: so passages that
many texts share come last, and a text with enough shingles of its own is compared with none. Blocks of texts ask parts
for these numbers, as in lm; a number may count another shingle too (a sixteenth of them), which changes the order, the
same for all, but loses nothing. Of the first shingles only those in several sets become rows.

Shingles that only one set has also bound a pair's similarity: they are in the union and not in the intersection. Sets are
compared first with the one that shares a shingle and has the least share of such own ones, one each: in a large group of
near copies that is what they were copied from, so most of the group is linked in rows in proportion to its members, and
those that aren't have too many shingles of their own. Then with all that share a shingle and aren't in the same component
yet, where of each shingle's sets those of the most frequent component aren't compared among themselves. A pair is met at
its first common shingle, whose places bound the similarity too. Equal sets are one. Similarity is exact but
for 64-bit hashes of words and shingles, of which 40 bits are compared.

Null, empty and blank texts have the empty set; texts of fewer words are one shingle. Repeated rows have a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lm
from .codes import ascending, mixed, numbers, spread, squeezed
from .common import arrow, bucketed, join_long, stash
from .components import components

#: Similarity from which texts are near copies, in fifths; words of a shingle; bits of a shingle's hash that are compared.
FIFTHS, WIDTH, BITS = 4, 5, 40
#: Shingles of a part, and places for each, so that few are counted together.
PART, ROOM = 1 << 21, 16


class Sets:
    """Of a block's texts: ascending shingles of each (key, text by text, from starts on), hashes of the sets, fingerprints."""

    def __init__(self, words: bytes, codes: bytes, lens: bytes) -> None:
        from xxhash import xxh64_intdigest

        lens = spread(lens)
        n, begins = lens - 1, np.cumsum(lens) - lens  # without the end
        flat = np.frombuffer(words, np.uint64)[spread(codes)]
        windows = np.where(n >= WIDTH, n - WIDTH + 1, n > 0)
        text = np.repeat(np.arange(len(n)), windows)
        at = begins[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        long = n[text] >= WIDTH
        key = flat[at]
        for k in range(1, WIDTH):
            go = long | (k < n[text])
            key[go] = mixed(key[go], flat[at[go] + k])
        self.prints = self._fingerprints(key, windows)
        by = np.lexsort((key, text))
        key, text = key[by], text[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        self.key, self.text = key[new], text[new]
        self.n = np.bincount(self.text, minlength=len(n))
        self.starts = np.cumsum(self.n) - self.n
        self.own = np.array([xxh64_intdigest(self.key[a : a + m].tobytes()) for a, m in zip(self.starts, self.n)], np.uint64)
        _, first = np.unique(self.own, return_index=True)
        self.first = np.zeros(len(n), bool)  # of equal sets one
        self.first[first] = True

    def _fingerprints(self, key: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """A bit is 1 if it is set in over half of a text's shingles."""
        counts, ends = np.zeros((len(windows), 64), np.int64), np.cumsum(windows)
        for k in range(64):
            ones = np.r_[0, np.cumsum(((key >> np.uint64(k)) & np.uint64(1)).astype(np.int64))]
            counts[:, k] = ones[ends] - ones[ends - windows]
        return np.packbits(2 * counts > windows[:, None], axis=1, bitorder="little").view("<u8").ravel()

    def asked(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending part * PART * ROOM + place of each shingle of distinct sets, how many of these hold it, and for each key which it is."""
        room = np.uint64(PART * ROOM)
        code = (self.key % np.uint64(parts)) * room + (self.key // np.uint64(parts)) % room
        own, back = np.unique(code, return_inverse=True)
        return own, np.bincount(back[self.first[self.text]], minlength=len(own)), back

    def heads(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are among the first of their distinct set and in several sets, in their order, text by text, and their places in it; held: how many sets hold each."""
        by = np.lexsort((self.key, held, self.text))
        text = self.text[by]
        place, n = np.arange(len(by)) - self.starts[text], self.n[text]
        keep = (place < n - -(-FIFTHS * n // 5) + 1) & (held[by] > 1) & self.first[text]
        return by[keep], place[keep]


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, pa.Array, Sets]]:
    for i in range(table.num_rows):
        r = {n: table.column(n)[i] for n in table.schema.names}
        yield r["block"].as_py(), r["doc_id"].values, Sets(*(r[c].as_py() for c in ("words", "codes", "lens")))


MESSAGE = "part long, block long, keys binary, n binary"


def sets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of each row, the hash of its set (own), its fingerprint fp, size n and number of shingles that no other set has (alone); for one row of each set, if it may have near copies, the shingles to compare it by (head, in the order of all shingles, at places) and all (whole)."""
    rows = docs.select(F.struct(*keep).alias("doc_id"), F.lit(False).alias("held_out"), F.col(text).alias("text"))
    found = bucketed(lm.blocks(rows), "texts", "block", 2 * rows.rdd.getNumPartitions())
    parts = max(1, -(-int(found.agg(F.sum("tokens")).first()[0] or 0) // PART))
    room = PART * ROOM

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, found in _rows(batch):
                own, n, _ = found.asked(parts)
                cuts = np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64) * np.uint64(room))
                to = np.flatnonzero(np.diff(cuts))
                yield arrow({
                    "part": (to, pa.int64()), "block": (np.full(len(to), block), pa.int64()),
                    "keys": ([ascending(own[cuts[p] : cuts[p + 1]] % np.uint64(room)) for p in to], pa.binary()), "n": ([squeezed(n[cuts[p] : cuts[p + 1]]) for p in to], pa.binary()),
                })

    def add(table: pa.Table) -> pa.Table:
        keys = [numbers(x) for x in table.column("keys").to_pylist()]
        all_, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate([spread(x) for x in table.column("n").to_pylist()]), minlength=len(all_)).astype(np.int64)
        ends = np.cumsum([len(x) for x in keys])
        told = [squeezed(n[back[e - len(x) : e]]) for x, e in zip(keys, ends)]
        return pa.table({"part": table.column("part"), "block": table.column("block"), "n": pa.array(told, pa.binary())})

    def head(own: pa.Table, told: pa.Table) -> pa.Table:
        ((_, ids, found),) = _rows(own)
        answers = dict(zip(told.column("part").to_pylist(), told.column("n").to_pylist()))
        held = np.concatenate([np.zeros(0, np.int64), *(spread(answers[p]) for p in sorted(answers))])[found.asked(parts)[2]]
        at, place = found.heads(held)
        cuts = np.searchsorted(found.text[at], np.arange(len(found.n) + 1))
        some = np.diff(cuts) > 0
        key = found.key[at].view(np.int64)
        short = found.key >> np.uint64(64 - BITS)
        whole = [ascending(np.unique(short[a : a + m])) if x else None for a, m, x in zip(found.starts, found.n, some)]
        return pa.table({
            **{c: x for c, x in zip(keep, ids.flatten())}, "own": pa.array(found.own.view(np.int64)), "fp": pa.array(found.prints.view(np.int64)), "n": pa.array(found.n, pa.int32()), "alone": pa.array(np.bincount(found.text[held == 1], minlength=len(found.n)), pa.int32()),
            "head": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key)), "places": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place, pa.int32())), "whole": pa.array(whole, pa.binary()),
        })

    answers = found.mapInArrow(ask, MESSAGE).groupBy("part").applyInArrow(add, "part long, block long, n binary")
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return stash(found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(head, f"{kinds}own long, fp long, n int, alone int, head array<long>, places array<int>, whole binary"), "sets")


def _near(a: str, b: str) -> Column:
    """Sizes and numbers of shingles of their own that let two sets be similar. a, b: where their n and alone are."""
    n, m, x, y = (F.col(f"{of}{c}") for c in ("n", "alone") for of in (a, b))
    both = F.least(n - x, m - y)
    return ((5 + FIFTHS) * both >= FIFTHS * (n + m)) & (5 * (n - x) >= FIFTHS * (n + y)) & (5 * (m - y) >= FIFTHS * (m + x))


def _verified(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, last, one = [], None, None
            for x, y in zip(batch.column("a_whole"), batch.column("b_whole")):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, one = x, numbers(x)
                other = numbers(y)
                both = len(np.intersect1d(one, other, assume_unique=True))
                near.append(5 * both >= FIFTHS * (len(one) + len(other) - both))
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    whole = found.where("whole is not null").select("own", "whole").dropDuplicates(["own"])
    of = lambda c: whole.select(F.col("own").alias(c), F.col("whole").alias(f"{c}_whole"))
    return stash(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "a_whole", "b_whole").mapInArrow(run, "a long, b long"), "near")


def links(found: DataFrame) -> DataFrame:
    """Links a, b between hashes of sets that connect all similar ones. found: sets of texts."""
    rows = stash(found.where("size(head) > 0").dropDuplicates(["own"]).select("own", "n", "alone", F.inline(F.arrays_zip(F.col("head").alias("hash"), F.col("places").alias("place")))), "heads")
    central = F.struct((F.col("alone") / F.col("n")).alias("share"), "own", "n", "alone")
    groups = rows.groupBy("hash").agg(F.min(central).alias("centre"), F.count("*").alias("of")).where("of > 1")
    shared = stash(rows.join(groups, "hash"), "shared")
    stars = shared.where((F.col("own") != F.col("centre.own")) & _near("", "centre.")).groupBy(F.col("own").alias("a")).agg(F.min("centre").alias("centre")).select("a", F.col("centre.own").alias("b"))
    stars = stash(stars, "stars")
    first = _verified(found, stars)
    roots = components(first)
    at = stash(shared.select("own", "n", "alone", "hash", "place").join(roots.withColumnRenamed("node", "own"), "own", "left").withColumn("root", F.coalesce("root", "own")), "rooted")
    most = at.groupBy("hash", "root").count().groupBy("hash").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("hash", "most")
    heads = found.where("size(head) > 0").dropDuplicates(["own"]).select("own", "head")
    several = stash(join_long(at.join(most, "hash"), heads, "own"), "several")
    a, b = several.where("root != most").alias("a"), several.alias("b")
    # a pair is met at its first common shingle only; those before it aren't in both
    first_common = F.array_intersect("a.head", "b.head")[0] == F.col("a.hash")
    both = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    enough = (5 + FIFTHS) * both >= FIFTHS * (F.col("a.n") + F.col("b.n"))
    # two sets that both lie outside the most frequent component meet once
    once = (F.col("b.root") == F.col("b.most")) | (F.col("a.own") < F.col("b.own"))
    meet = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.root") != F.col("b.root")) & _near("a.", "b.") & enough & once & first_common
    pairs = join_long(a, b, meet).select(F.greatest("a.own", "b.own").alias("a"), F.least("a.own", "b.own").alias("b")).distinct()
    return first.unionByName(_verified(found, pairs.join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")))
