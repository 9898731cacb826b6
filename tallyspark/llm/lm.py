"""Language-model scores by a weighted backoff automaton.

Counting. All words of the training texts are counted exactly, and all n-grams that occur at least twice are kept, at
any corpus size. Nothing that grows is broadcast or gathered. Texts are cut into blocks of about BLOCK tokens, written
once in buckets, so that no later step shuffles them. Twice a block sends messages to parts, of which there are as many
as the tokens need, and is answered. First it sends its words, by 64-bit hashes, and the places of its longer n-grams in
a table of counters, each part of which has ROOM places for an n-gram. It is told the words' counts and numbers, and
which places were met twice: an n-gram alone in its place is out. Then it sends the others, exactly, as pairs of context
and word, in ascending contexts by numbers of words, and is told their counts, and what the kept n-grams after each
context add up to. A context's part gets what follows it; what follows a context of frequent words is split over as many
parts as their count needs. Then each block walks its own automaton of what it was told, which has every arc of the
whole automaton that its texts can take. Two of N words share a hash with a chance of about N^2 / 2^65; contexts of more
than two words are hashes too.

Model. Interpolated absolute discounting: p(w | h) = (c(hw) - d) / c(h) + b(h) p(w | h'), the first term only for kept
hw, where h' is h without its first word and b(h) is what the kept terms leave. Without context, p is the base's
additive smoothing, which also covers words that were never seen. Probabilities add up to 1.

Automaton. States are kept n-grams below the highest order, and the empty one. A state has an arc for each kept
continuation, and a failure arc with weight log b(h) to the state of h'. One traversal from left to right carries the
state and adds weights. Words that aren't kept lead from the empty state to itself; their own probability is added.

Null and empty texts hold the end only. Repeated rows are scored each and counted each. Very long texts are in one
block each. An empty table gives no rows; without training texts all words are unknown. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import ascending, grouped, hashes, mixed, numbers, spread, squeezed
from .common import arrow, bucketed, slices, stash

#: The end as a word, which no word equals; numbers of the end and the begin.
END, END_ID, BEGIN_ID = b"\n", 0, 1
#: Distinct words, or n-grams, that a counting task holds before it hands on what it has.
HELD_WORDS, HELD_GRAMS = 1_000_000, 4_000_000
#: Tokens of a block, and for each part, and rows of texts that are split at a time.
BLOCK, SPLIT = 1 << 20, 256
#: Places for each n-gram in the table of counters.
ROOM = 16

#: Words of a text that are walked one after another; the runs of all texts of a block are walked side by side.
RUN = 128


def coded(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the batch's texts, the end last; the texts' words by number, each text closed by the end; where each text ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").fill_null("")))
    flat = lists.flatten().dictionary_encode()
    keys = flat.dictionary.cast(pa.large_binary() if pa.types.is_large_string(flat.dictionary.type) else pa.binary()).to_pylist()
    codes, ends = flat.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
    if b"" in keys:  # white space at the ends of texts leaves empty words
        real = codes != keys.index(b"")
        ends = np.r_[0, np.cumsum(real)][ends]
        codes = codes[real]
    return [*keys, END], np.insert(codes, ends, len(keys)), ends + np.arange(1, len(ends) + 1)


@dataclass
class Grams:
    """Kept n-grams: word numbers, and for each order from 2 sorted keys (number of the prefix * width + word) with counts."""

    words: list[bytes]
    counts: list[np.ndarray]  # by order, from 1
    keys: list[np.ndarray]  # by order, from 2
    number: dict[bytes, int] = field(default_factory=dict)

    @property
    def width(self) -> int:
        """Word numbers and, last, the number of all other words."""
        return len(self.words) + 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": {}}

    def ids(self, words: list[bytes]) -> np.ndarray:
        if not self.number:
            self.number = dict(zip(self.words, range(len(self.words))))
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def next_keys(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of the next order in a run of words, whose two parts are kept."""
        own = ids
        for keys in self.keys:
            key = self._keys(own, ids)
            own = np.full(len(ids), -1)
            at = np.flatnonzero(key >= 0)
            found = np.minimum(np.searchsorted(keys, key[at]), max(len(keys) - 1, 0))
            ok = keys[found] == key[at] if len(keys) else np.zeros(len(at), bool)
            own[at[ok]] = found[ok]
        key = self._keys(own, ids)
        return key[key >= 0]

    def _keys(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Key of the n-gram of the next order that ends at each place; -1 where a part isn't kept or a begin is inside."""
        key = np.full(len(ids), -1)
        if len(ids) > 1:
            ok = (own[:-1] >= 0) & (own[1:] >= 0) & (ids[1:] >= 0) & (ids[1:] != BEGIN_ID)
            key[1:][ok] = own[:-1][ok] * self.width + ids[1:][ok]
        return key


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and n over all texts, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            keys, codes, _ = coded(batch)
            n = np.bincount(codes, minlength=len(keys))
            counts.update({w: k for w, k in zip(keys, n.tolist()) if k})
            if len(counts) > HELD_WORDS:
                yield from _handed(counts)
                counts = Counter()
        yield from _handed(counts)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _handed(counts: Counter, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    words, n = list(counts), list(counts.values())
    for at in range(0, len(words), rows):
        yield arrow({"word": (words[at : at + rows], pa.binary()), "n": (n[at : at + rows], pa.int64())})


def gram_counts(texts: DataFrame, grams) -> DataFrame:
    """key and n of the next order's n-grams; grams: broadcast Grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            g = grams.value
            keys, codes, ends = coded(batch)
            ids = np.insert(g.ids(keys)[codes], np.r_[0, ends[:-1]], BEGIN_ID)
            held.append(g.next_keys(ids))
            size += len(held[-1])
            if size > HELD_GRAMS:
                yield from _counted(held)
                held, size = [], 0
        yield from _counted(held)

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    if held:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(keys), rows):
            yield arrow({"key": (keys[at : at + rows].astype(np.int64), pa.int64()), "n": (n[at : at + rows], pa.int64())})


@dataclass
class Base:
    """Training tokens, distinct ones, and additive smoothing."""

    tokens: int
    distinct: int
    extra: float = 0.1

    def log(self, n):
        return np.log10((np.asarray(n) + self.extra) / (self.tokens + self.extra * (self.distinct + 1)))


DISCOUNT = 0.75


class Automaton:
    """Arcs (state * width + word to arc), and for each arc its weight and next state; failure arcs by state.

    States: 0 is empty, then kept n-grams order by order below the highest.
    """

    def __init__(self, grams: Grams, base: Base, discount: float = DISCOUNT, backs: list[np.ndarray] | None = None) -> None:
        """backs: b of the n-grams by order from 1, where grams are only some of those that b was taken from."""
        width, orders = grams.width, len(grams.counts)
        first = [0, *np.cumsum([1, *(len(c) for c in grams.counts)]).tolist()]  # state of number 0 of each order
        p = [10 ** base.log(grams.counts[0])]
        shorter = [np.zeros(len(grams.words), np.int64)]  # number of each n-gram without its first word
        back = []
        for k, keys in enumerate(grams.keys, start=1):
            prefix, word = keys // width, keys % width
            alpha = (grams.counts[k] - discount) / grams.counts[k - 1][prefix]
            b = backs[k - 1] if backs else np.maximum(1 - np.bincount(prefix, alpha, minlength=len(grams.counts[k - 1])), 1e-12)
            back.append(b)
            cut = word if k == 1 else np.searchsorted(grams.keys[k - 2], shorter[k - 1][prefix] * width + word)
            shorter.append(cut.astype(np.int64))
            p.append(alpha + b[prefix] * p[k - 1][cut])
        back += [np.ones(len(c)) for c in grams.counts[len(back) : orders - 1]]
        arcs, weights, nexts = [np.append(np.arange(len(grams.words)), width - 1)], [np.append(np.log10(p[0]), 0.0)], []
        to = lambda k, n: first[k] + n if k < orders else first[k - 1] + shorter[k - 1][n] if k > 1 else np.zeros(len(n), np.int64)
        nexts.append(np.append(to(1, np.arange(len(grams.words))), 0))
        for k, keys in enumerate(grams.keys, start=1):
            prefix, word = keys // width, keys % width
            arcs.append((first[k] + prefix) * width + word)
            weights.append(np.log10(p[k]))
            nexts.append(to(k + 1, np.arange(len(keys))))
        self.width = width
        self.arcs, self.weights, self.nexts = np.concatenate(arcs), np.concatenate(weights), np.concatenate(nexts)  # ascending; those of the empty state come first, one for each word
        self.history = orders - 1
        self.back = np.concatenate([[0.0], *(np.log10(b) for b in back[: orders - 1])])
        self.fail = np.concatenate([[0], *((first[k - 1] + shorter[k - 1] if k > 1 else np.zeros(len(grams.counts[0]), np.int64)) for k in range(1, orders))])
        self.start = first[1] + BEGIN_ID if orders > 1 else 0

    def score(self, ids: list[int]) -> float:
        return float(self.scores(np.array(ids, np.int64), np.array([len(ids)]))[0])

    def scores(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log10 probability of each text after a begin. ids: words of all texts, numbers as in Grams, the last for others; ends: where each text ends.

        A state holds at most history words. So a text can be walked in runs: a run behind the first begins history
        words early, from the empty state, and is in the right state when its own words begin.
        """
        starts = np.r_[0, ends[:-1]]
        runs = np.maximum(1, -(-(ends - starts) // RUN))
        owner = np.repeat(np.arange(len(ends)), runs)
        begin = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        later = begin > starts[owner]
        first, stop = begin - self.history * later, np.minimum(begin + RUN, ends[owner])
        by = np.argsort(first - stop, kind="stable")  # the longest first, so that the runs still walked are the first ones
        owner, first, later, length = owner[by], first[by], later[by], (stop - first)[by]
        state, total = np.where(later, 0, self.start), np.zeros(len(by))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))
            s, w, add = state[:n], ids[first[:n] + t], np.zeros(n)
            a, rest = w.copy(), np.flatnonzero(s)  # the empty state's arc of a word has the word's number
            while len(rest):
                key = s[rest] * self.width + w[rest]
                found = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[found] == key
                a[rest[hit]] = found[hit]
                rest = rest[~hit]
                add[rest] += self.back[s[rest]]
                s[rest] = self.fail[s[rest]]
                rest = rest[s[rest] > 0]
            add += self.weights[a]
            total[:n] += np.where(later[:n], 0.0, add) if t < self.history else add
            state[:n] = self.nexts[a]
        return np.bincount(owner, total, minlength=len(ends))


def kept_grams(texts: DataFrame, counts: DataFrame, least: int, order: int) -> Grams:
    """Words and n-grams that occur at least least times, all on the driver: for small texts, as a check of scores()."""
    sc = texts.sparkSession.sparkContext
    common = counts.where(F.col("n") >= least).toArrow().to_pydict()
    known = dict(zip(common["word"], common["n"]))
    docs = counts.where(F.col("word") == F.lit(END)).agg(F.max("n")).first()[0] or 0
    known.pop(END, None)
    words = sorted(known)
    # the begin stands in every text; as a number it must be there, as a word it can't be met
    grams = Grams([END, b"\t", *words], [np.array([docs, docs, *(known[w] for w in words)], np.int64)], [])
    for _ in range(1, order):
        sent = sc.broadcast(grams)
        rows = gram_counts(texts, sent).where(F.col("n") >= least).toArrow()
        keys, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        by = np.argsort(keys)
        grams = Grams(grams.words, [*grams.counts, n[by].astype(np.int64)], [*grams.keys, keys[by].astype(np.int64)])
    return grams


BEGIN = b"\t"


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (doc_id, held_out, text): ids and marks, hashes of distinct words, words by number, lengths of texts, and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, SPLIT):
            keys, codes, ends = coded(batch)
            held.append((hashes(keys), codes, ends, batch.column("doc_id"), batch.column("held_out")))
            size += len(codes)
            if size >= BLOCK:
                yield _block(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, doc_id array<{kind}>, held_out array<boolean>, words binary, codes binary, lens binary, tokens long, training long")


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    words, at = np.unique(np.concatenate([h for h, *_ in held]), return_inverse=True)
    base, places, lens = np.cumsum([0, *(len(h[0]) for h in held)]), [], []
    for (_, codes, ends, *_), first in zip(held, base):
        places.append(at[codes + first])
        lens.append(np.diff(np.r_[0, ends]))
    codes, lens = np.concatenate(places), np.concatenate(lens)
    by = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small numbers, which compress
    rank = np.empty(len(words), np.int64)
    rank[by] = np.arange(len(words))
    ids, marks = (pa.chunked_array([h[i] for h in held]).combine_chunks() for i in (3, 4))
    of = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    packed = {"words": words[by].tobytes(), "codes": squeezed(rank[codes]), "lens": squeezed(lens)}
    return arrow({"block": ([number], pa.int64()), "doc_id": (of(ids), None), "held_out": (of(marks), None)} | {k: ([v], pa.binary()) for k, v in packed.items()} | {"tokens": ([len(codes)], pa.int64()), "training": ([int(lens[_training(marks)].sum())], pa.int64())})


def _training(marks: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.invert(marks), False).to_numpy(zero_copy_only=False)


class Block:
    """A block's places: each text's words behind a begin."""

    def __init__(self, words: bytes, codes: bytes, lens: bytes, marks: pa.Array, parts: int, order: int) -> None:
        self.words, self.codes, self.lens, self.parts, self.order = np.frombuffer(words, np.uint64), spread(codes), spread(lens), parts, order
        self.ids = np.insert(self.codes, np.cumsum(self.lens) - self.lens, len(self.words))
        self.inner = self.ids != len(self.words)
        self.learned = np.repeat(_training(marks), self.lens + 1)

    def ask_words(self) -> None:
        """Words and the begin by part; counters of longer n-grams by part, and for each order the counter of the n-gram that ends at a place, or -1."""
        parts, hashed = np.uint64(self.parts), np.append(self.words, hashes([BEGIN]))
        part = (hashed % parts).astype(np.int64)
        self.by_part = np.lexsort((hashed, part))
        self.word_parts, self.word_keys = part[self.by_part], (hashed // parts)[self.by_part]
        self.word_n = np.bincount(self.ids[self.learned], minlength=len(hashed))
        room, own = np.uint64(ROOM * self.order * BLOCK), hashed[self.ids]
        key, there, codes, places = own, np.ones(len(own), bool), [], []
        for _ in range(1, self.order):
            key = np.r_[np.zeros(1, np.uint64), mixed(key[:-1], own[1:])]
            there = np.r_[False, there[:-1] & self.inner[1:]]
            places.append(np.flatnonzero(there))
            codes.append((key[places[-1]] % parts) * room + (key[places[-1]] // parts) % room)
        flat = np.concatenate([np.zeros(0, np.uint64), *codes])
        self.slots, at = grouped(flat, self.parts * int(room))
        learned = np.concatenate([np.zeros(0, bool), *(self.learned[p] for p in places)])
        self.slot_n = np.minimum(np.bincount(at[learned], minlength=len(self.slots)), 2)
        self.slot_at = []
        for p, end in zip(places, np.cumsum([len(p) for p in places])):
            self.slot_at.append(np.full(len(own), -1, np.int32))
            self.slot_at[-1][p] = at[end - len(p) : end]
        self.slot_cuts = np.searchsorted(self.slots, np.arange(self.parts + 1, dtype=np.uint64) * room)
        self.slots %= room
        self.word_cuts = np.searchsorted(self.word_parts, np.arange(self.parts + 1))

    def words_sent(self, block: int) -> Iterator[pa.RecordBatch]:
        n, w, s = self.word_n[self.by_part], self.word_cuts, self.slot_cuts
        to = np.flatnonzero((np.diff(w) > 0) | (np.diff(s) > 0))
        rows = {"keys": [ascending(self.word_keys[w[p] : w[p + 1]]) for p in to], "n": [squeezed(n[w[p] : w[p + 1]]) for p in to], "more": [ascending(self.slots[s[p] : s[p + 1]]) for p in to], "m": [squeezed(self.slot_n[s[p] : s[p + 1]]) for p in to]}
        yield _message(block, to, rows)

    def words_told(self, rows: dict[int, tuple[bytes, bytes, bytes]]) -> None:
        """By part: counts of words, numbers of the kept ones (others: 0; else one more), and which counters were met twice."""
        (count, number), twice = np.zeros((2, len(self.by_part)), np.int64), np.zeros(len(self.slots), bool)
        for part, (n, ids, met) in rows.items():
            own = slice(self.word_cuts[part], self.word_cuts[part + 1])
            count[own], number[own] = spread(n), spread(ids) - 1
            own = slice(self.slot_cuts[part], self.slot_cuts[part + 1])
            twice[own] = np.unpackbits(np.frombuffer(met, np.uint8), count=own.stop - own.start).astype(bool)
        self.count, self.number = np.zeros((2, len(count)), np.int64)
        self.count[self.by_part], self.number[self.by_part] = count, number
        self.twice = np.append(twice, False)

    def ask_grams(self, width: int) -> None:
        """Contexts by part, and the n-grams that may be kept as context and word, by part and context."""
        self.width = width
        word = self.number[self.ids]
        before, low, key = word >= 0, self.count[self.ids], word.astype(np.uint64)
        may = before & self.inner
        contexts, least, follow, grams = [], [], [], []
        for k in range(1, self.order):
            at = np.flatnonzero(np.r_[False, before[:-1]] & self.inner)  # places behind a context of k words
            follow.append(at)
            contexts.append(key[at - 1])
            least.append(low[at - 1])
            may = np.r_[False, before[:-1]] & may & self.twice[self.slot_at[k - 1]]
            grams.append(np.flatnonzero(may))
            longer = (key[:-1] + np.uint64(1)) * np.uint64(width) + key[1:] if k == 1 else mixed(key[:-1], key[1:])
            key, low, before = np.r_[np.zeros(1, np.uint64), longer], np.minimum(low, np.r_[0, low[:-1]]), may
        flat = np.concatenate([np.zeros(0, np.uint64), *contexts])
        own, back = grouped(flat, (width + 1) * width if self.order < 4 else 1 << 64)
        pieces = np.empty(len(own), np.int64)
        pieces[back] = np.concatenate([np.zeros(0, np.int64), *least]) // BLOCK + 1
        ends = np.cumsum([len(x) for x in follow])
        self.context_at, codes = [], []
        for at, end, places in zip(follow, ends, grams):
            self.context_at.append(np.full(len(self.ids), -1, np.int32))
            self.context_at[-1][at] = back[end - len(at) : end]
            codes.append(self.context_at[-1][places] * np.int64(width) + word[places])
        items, at = grouped(np.concatenate([np.zeros(0, np.int64), *codes]), max(1, len(own)) * width)
        items = items.astype(np.int64)
        self.gram_at = []
        for places, end in zip(grams, np.cumsum([len(x) for x in grams])):
            self.gram_at.append(np.full(len(self.ids), -1, np.int32))
            self.gram_at[-1][places] = at[end - len(places) : end]
        n = np.bincount(at[np.concatenate([np.zeros(0, bool), *(self.learned[p] for p in grams)])], minlength=len(items))
        context, words, parts = items // width, items % width, np.uint64(self.parts)
        part = (mixed(own[context], words.astype(np.uint64) % pieces[context].astype(np.uint64)) % parts).astype(np.int64)
        self.gram_by = np.argsort(part, kind="stable")
        each = np.repeat(np.arange(len(own)), pieces)
        piece = (np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)).astype(np.uint64)
        where = (mixed(own[each], piece) % parts).astype(np.int64)
        rows = grouped(where * max(1, len(own)) + each, self.parts * max(1, len(own)))[0].astype(np.int64)  # pieces of a context may fall into one part
        self.context_parts, self.context_rows = np.divmod(rows, max(1, len(own)))
        self.contexts = own
        part, context = part[self.gram_by], context[self.gram_by]
        self.gram_words, self.gram_n = words[self.gram_by], n[self.gram_by]
        self.following = np.bincount(np.searchsorted(rows, part * max(1, len(own)) + context), minlength=len(rows))
        cuts = np.arange(self.parts + 1)
        self.context_cuts, self.gram_cuts = np.searchsorted(self.context_parts, cuts), np.searchsorted(part, cuts)

    def grams_sent(self, block: int) -> Iterator[pa.RecordBatch]:
        c, g = self.context_cuts, self.gram_cuts
        to = np.flatnonzero(np.diff(c) > 0)
        keys = self.contexts[self.context_rows]
        rows = {"keys": [_contexts_sent(keys[c[p] : c[p + 1]], self.width) for p in to], "n": [squeezed(self.following[c[p] : c[p + 1]]) for p in to], "more": [squeezed(self.gram_words[g[p] : g[p + 1]]) for p in to], "m": [squeezed(self.gram_n[g[p] : g[p + 1]]) for p in to]}
        yield _message(block, to, rows)

    def grams_told(self, rows: dict[int, tuple[bytes, bytes, bytes]], discount: float) -> None:
        """By part: counts of n-grams (0 for those that aren't kept), and how many are kept after each context, and their sum."""
        sums, times, count = np.zeros(len(self.context_rows)), np.zeros(len(self.context_rows)), np.zeros(len(self.gram_words), np.int64)
        for part, (n, total, of) in rows.items():
            own = slice(self.context_cuts[part], self.context_cuts[part + 1])
            sums[own], times[own] = spread(total), spread(of)
            count[self.gram_cuts[part] : self.gram_cuts[part + 1]] = spread(n)
        self.taken = np.bincount(self.context_rows, sums - discount * times, minlength=len(self.contexts))
        self.gram_count = np.zeros(len(count), np.int64)
        self.gram_count[self.gram_by] = count

    def automaton(self, base: Base) -> tuple[Automaton, np.ndarray]:
        """Automaton of what was told, and the number in it of each distinct word of the block, the begin's last."""
        begin, end = len(self.words), int(np.flatnonzero(self.words == hashes([END])[0])[0])
        kept = np.flatnonzero(self.number >= 0)
        listed = np.r_[end, begin, kept[(kept != end) & (kept != begin)]]
        number = np.full(len(self.words) + 1, len(listed))
        number[listed] = np.arange(len(listed))
        word = number[self.ids]
        own, count = np.where(word < len(listed), word, -1), self.count[listed]
        grams, backs = Grams(range(len(listed)), [count], []), []
        for at, context in zip(self.gram_at, self.context_at):
            back = np.ones(len(count))
            places = np.flatnonzero(context >= 0)
            places = places[own[places - 1] >= 0]
            of = own[places - 1]
            back[of] = np.maximum(1 - self.taken[context[places]] / np.maximum(count[of], 1), 1e-12)
            backs.append(back)
            places = np.flatnonzero(at >= 0)
            places = places[self.gram_count[at[places]] > 0]
            found, first, back = np.unique(own[places - 1] * grams.width + word[places], return_index=True, return_inverse=True)
            count = self.gram_count[at[places[first]]]
            own = np.full(len(self.ids), -1)
            own[places] = back
            grams.keys.append(found)
            grams.counts.append(count)
        return Automaton(grams, base, backs=[*backs, np.ones(len(count))]), number


MESSAGE = "part long, block long, keys binary, n binary, more binary, m binary"
ANSWER = "kind int, part long, block long, a binary, b binary, c binary, distinct long, widest long"


def _contexts_sent(contexts: np.ndarray, width: int) -> bytes:
    """Ascending contexts as steps of what comes before the last word, and last words: both small numbers, as frequent words have small ones."""
    first, last = np.divmod(contexts, np.uint64(max(2, width)))
    a, b = squeezed(np.diff(first.astype(np.int64), prepend=0)), squeezed(last.astype(np.int64))
    return len(a).to_bytes(4, "little") + a + b


def _contexts(data: bytes, width: int) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    return np.cumsum(spread(data[4:cut])).astype(np.uint64) * np.uint64(max(2, width)) + spread(data[cut:]).astype(np.uint64)


def _message(block: int, to: np.ndarray, rows: dict[str, list[bytes]]) -> pa.RecordBatch:
    return arrow({"part": (to, pa.int64()), "block": (np.full(len(to), block), pa.int64())} | {k: (v, pa.binary()) for k, v in rows.items()})


def _answer(kind: int, table: pa.Table, columns: list[list[bytes]], distinct: int = 0, widest: int = 0) -> pa.Table:
    """One row for each of table's; the first says how many words the part has, and its largest number."""
    n = table.num_rows
    once = lambda x: pa.array([x] + [0] * (n - 1), pa.int64())
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "part": table.column("part"), "block": table.column("block"), **{k: pa.array(v, pa.binary()) for k, v in zip("abc", columns)}, "distinct": once(distinct), "widest": once(widest)})


def words_answered(messages: DataFrame, parts: int, least: int) -> DataFrame:
    """Each part adds up words and counters. Frequent words get small numbers."""
    special = hashes([END, BEGIN])

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        read = lambda name, f: [f(x) for x in table.column(name).to_pylist()]
        keys, slots = read("keys", numbers), read("more", numbers)
        all_, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(read("n", spread)), minlength=len(all_)).astype(np.int64)
        full = all_ * np.uint64(parts) + np.uint64(part)
        kept = (n >= least) | ((n > 0) & np.isin(full, special))
        by = np.flatnonzero(kept)[np.argsort(-n[kept], kind="stable")]
        number = np.full(len(all_), -1)
        number[by] = np.arange(len(by)) * parts + part
        counters, at = np.unique(np.concatenate(slots), return_inverse=True)
        twice = np.bincount(at, np.concatenate(read("m", spread)), minlength=len(counters)) >= 2
        split = lambda x, of: np.split(x, np.cumsum([len(k) for k in of])[:-1])
        own, met = split(back, keys), split(twice[at], slots)
        columns = [[squeezed(n[x]) for x in own], [squeezed(number[x] + 1) for x in own], [np.packbits(x).tobytes() for x in met]]
        return _answer(1, table, columns, int(((n > 0) & (full != special[1])).sum()), int(number.max()) if len(number) else 0)

    return messages.groupBy("part").applyInArrow(add, ANSWER)


def grams_answered(messages: DataFrame, width: int, least: int) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        read = lambda name, f: [f(x) for x in table.column(name).to_pylist()]
        contexts, words = [_contexts(x, width) for x in table.column("keys").to_pylist()], read("more", spread)
        all_, at = np.unique(np.concatenate(contexts), return_inverse=True)
        context = np.repeat(at, np.concatenate(read("n", spread)))
        items, back = np.unique(context * width + np.concatenate(words), return_inverse=True)
        n = np.bincount(back, np.concatenate(read("m", spread)), minlength=len(items)).astype(np.int64)
        n[n < least] = 0
        total = np.bincount(items // width, n, minlength=len(all_)).astype(np.int64)
        times = np.bincount(items // width, n > 0, minlength=len(all_)).astype(np.int64)
        split = lambda x, of: [squeezed(y) for y in np.split(x, np.cumsum([len(k) for k in of])[:-1])]
        return _answer(2, table, [split(n[back], words), split(total[at], contexts), split(times[at], contexts)])

    return messages.groupBy("part").applyInArrow(add, ANSWER)


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3, share: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows that held_out doesn't mark are learned from.

    N-grams that occur at least twice are kept; share asks for a share of the training tokens beyond that.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    found = bucketed(blocks(rows), "blocks", "block", 2 * rows.rdd.getNumPartitions())
    sizes = found.agg(F.sum("tokens"), F.sum("training")).first()
    parts, least = max(1, -(-int(sizes[0] or 0) // BLOCK)), max(2, int(np.ceil(share * (sizes[1] or 0))))

    def block_of(table: pa.Table | pa.RecordBatch) -> tuple[int, Block]:
        r = {n: table.column(n)[0] for n in table.schema.names}
        return r["block"].as_py(), Block(*(r[c].as_py() for c in ("words", "codes", "lens")), r["held_out"].values, parts, order)

    def told(table: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes, bytes]]:
        table = table.filter(pc.equal(table.column("kind"), kind))
        return dict(zip(table.column("part").to_pylist(), zip(*(table.column(c).to_pylist() for c in "abc"))))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, block = block_of(batch.slice(i, 1))
                block.ask_words()
                yield from block.words_sent(number)

    words = stash(words_answered(found.mapInArrow(send_words, MESSAGE), parts, least), "words")  # read again by the walk
    known = words.agg(F.max("widest"), F.sum("distinct")).first()
    width, base = max(0, int(known[0] or 0)) + 1, Base(int(sizes[1] or 0), int(known[1] or 0))

    def send_grams(own: pa.Table, answers: pa.Table) -> pa.Table:
        number, block = block_of(own)
        block.ask_words()
        block.words_told(told(answers, 1))
        block.ask_grams(width)
        return pa.Table.from_batches(list(block.grams_sent(number)))

    answers = words
    if order > 1:
        messages = found.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(send_grams, MESSAGE)
        answers = words.unionByName(grams_answered(messages, width, least))

    def walk(own: pa.Table, answers: pa.Table) -> pa.Table:
        _, block = block_of(own)
        block.ask_words()
        block.words_told(told(answers, 1))
        block.ask_grams(width)
        block.grams_told(told(answers, 2), DISCOUNT)
        automaton, number = block.automaton(base)
        n, lens, ends = block.count[:-1], block.lens, np.cumsum(block.lens)
        owner, logs, rare = np.repeat(np.arange(len(ends)), lens), base.log(n), number[:-1] == automaton.width - 1
        of = lambda x: np.bincount(owner, x[block.codes], minlength=len(ends))
        path = automaton.scores(number[block.codes], ends) + of(np.where(rare, logs, 0.0))
        ids, marks = (own.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out"))
        return pa.table({"doc_id": ids, "held_out": marks, "n_tokens": pa.array(lens, pa.int64()), "n_known": pa.array(of(n > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(ends), base.tokens), pa.int64()), "base_score": pa.array(of(logs)), "score": pa.array(path)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
