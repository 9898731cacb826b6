"""Bounded-space online packing of tokenised documents into sequences of a fixed size.

Each task keeps a fixed number of open windows. Documents come one after another: whole windows are cut off, and the
rest goes where it fits best, that is, where it leaves the least room. When it fits nowhere, the fullest window is
emitted: if both parts of a cut hold at least min_piece tokens, the document first fills it up; else its room, which
is below min_piece or almost a document's whole rest, is padding. What is open at the end of a task is merged: the
pieces of all tasks' open windows are laid end to end, by prefix sums over the tasks' token totals, and cut into windows.
So only the last window of a table, and windows emitted with a little room, hold padding.

Null and empty texts hold the closing id only. Repeated rows are packed each; an empty table gives no rows. Very long
texts are cut into as many windows as they need. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash
from .rounds import Remembered, Rounds

#: Chunks, and words inside chunks, whose ids a worker remembers.
CACHED = 800_000
#: Chunks that are split into words here: ASCII and accented Latin letters, which have one code point each, without
#: special strings. The library encodes all other chunks.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]+")
#: The model's own pattern of words, for lower-cased simple chunks.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


class ChunkEncoder:
    """Ids of whole texts by those of their chunks between ASCII white space.

    The model drops white space, and neither its words nor its special strings hold any, so a text's ids are those of
    its chunks one after another. New chunks are split into words, whose merges run in rounds.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError(f"{path}: words of this model can't be merged here")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rounds = Rounds({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}, len(vocab) + 2)
        chars = _byte_chars()
        self.inner, self.last = (np.array([vocab[c + end] for c in chars]) for end in ("", "</w>"))
        self.words = Remembered(self._merge, CACHED)
        self.chunks = Remembered(self._split, CACHED)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [x.encode() for x in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.inner[data], np.cumsum(lens) - 1
        sym[ends] = self.last[data[ends]]
        seg, sym = self.rounds.run(np.repeat(np.arange(len(raw)), lens), sym)
        return sym.astype(np.uint32), np.bincount(seg, minlength=len(raw))

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [_WORD.findall(x.lower()) if _SIMPLE.fullmatch(x) and "<|" not in x else None for x in texts]
        odd = [x for x, p in zip(texts, parts) if p is None]
        odd = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(odd, add_special_tokens=False)] if odd else []
        self.words.know(set(chain.from_iterable(p for p in parts if p)))
        flat = list(chain.from_iterable(p for p in parts if p))
        at = np.fromiter(map(self.words.at.__getitem__, flat), np.int64, len(flat))
        ids, each = self.words.spread(at), self.words.lens[at]
        counts = np.fromiter((len(p) for p in parts if p is not None), np.int64)
        ends = np.cumsum(counts)
        total = np.r_[0, np.cumsum(each)]
        own = total[ends] - total[ends - counts]
        if not odd:
            return ids, own
        # put the library's ids between the others, in the order of the chunks
        lens = np.empty(len(parts), np.int64)
        is_odd = np.array([p is None for p in parts])
        lens[~is_odd], lens[is_odd] = own, [len(x) for x in odd]
        out = np.empty(int(lens.sum()), np.uint32)
        mine = np.repeat(~is_odd, lens)
        out[mine], out[~mine] = ids, np.concatenate(odd)
        return out, lens

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lens = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lens)[:-1])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; null counts as empty. Each distinct chunk is looked up once."""
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = parts.flatten().dictionary_encode()
        keys = flat.dictionary.to_pylist()
        self.chunks.know(set(keys))
        at = np.fromiter(map(self.chunks.at.__getitem__, keys), np.int64, len(keys))[flat.indices.to_numpy()]
        ends = np.r_[0, np.cumsum(self.chunks.lens[at], dtype=np.int64)]
        cuts = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(), dtype=np.int64)]
        return self.chunks.spread(at), np.diff(ends[cuts])


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one from U+0100."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


_worker: dict[str, ChunkEncoder] = {}


class Windows:
    """A fixed number of open windows; place() gives pieces (window, offset, start, length), sealed() is called at emission."""

    def __init__(self, size: int, count: int, min_piece: int) -> None:
        self.size, self.count, self.min_piece = size, count, min_piece
        self.open: dict[int, int] = {}  # window to tokens
        self.next = 0

    def place(self, n: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
        """Where a document of n tokens goes, and the windows that are emitted meanwhile."""
        pieces, sealed, start = [], [], 0
        while n - start >= self.size:
            pieces.append((self.next, 0, start, self.size))
            sealed.append(self.next)
            self.next += 1
            start += self.size
        while start < n:
            rest = n - start
            fits = [(self.size - used, w) for w, used in self.open.items() if self.size - used >= rest]
            if fits:
                room, w = min(fits)
                pieces.append((w, self.open[w], start, rest))
                self.open[w] += rest
                start = n
                if room == rest:
                    sealed.append(w)
                    del self.open[w]
            elif len(self.open) < self.count:
                self.open[self.next] = 0
                self.next += 1
            else:
                used, w = max((used, -w) for w, used in self.open.items())
                w = -w
                room = self.size - used
                if room >= self.min_piece and rest - room >= self.min_piece:
                    pieces.append((w, used, start, room))
                    start += room
                sealed.append(w)
                del self.open[w]
        return pieces, sealed


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, ids binary"


def pack(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, windows: int = 32, min_piece: int = 16, close: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; with keep_ids its ids (little-endian uint32) too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if model not in _worker:
            _worker[model] = ChunkEncoder(model)
        space, held = Windows(size, windows, min_piece), {}  # held: rows of the open windows

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [kind, *[pa.int64()] * 7, pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip([*cols[:5], [part] * len(rows), *cols[5:]], kinds)], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

        kind = None
        for batch in slices(batches, 1024):
            kind, ready = batch.schema.field("doc_id").type, []
            ids, lens = _worker[model].encode_column(batch.column("text"))
            data = memoryview(np.insert(ids, np.cumsum(lens), np.uint32(close)).astype("<u4").tobytes())
            for doc, n in zip(batch.column("doc_id").to_pylist(), (lens + 1).tolist()):
                own, data = data[: 4 * n], data[4 * n :]
                pieces, sealed = space.place(n)
                for w, offset, start, length in pieces:
                    raw = bytes(own[4 * start : 4 * (start + length)])
                    held.setdefault(w, []).append((doc, start, length, zlib.crc32(raw), n, w, offset, raw))
                for w in sealed:
                    ready += held.pop(w) if keep_ids else [(*r[:-1], None) for r in held.pop(w)]
            yield out(ready)
        # the open windows: window -1, offsets from 0 over all of them; their ids go along, as they may be cut again
        rows, at = [], 0
        for w in sorted(held):
            for r in held[w]:
                rows.append((*r[:5], -1, at, r[-1]))
                at += r[2]
        if rows:
            yield out(rows)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = stash(rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}"), "packing")
    whole = placed.where("window >= 0").withColumn("sequence_id", F.col("part") * F.lit(1 << 32) + F.col("window"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    result = whole.select(names).unionByName(_merged(placed.where("window < 0"), size).select(names))
    return result if keep_ids else result.drop("ids")


def _merged(left: DataFrame, size: int) -> DataFrame:
    """The pieces of open windows laid end to end over all tasks and cut at every size tokens; ids of windows are negative."""
    spark = left.sparkSession
    totals = left.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()  # a row for each task
    bases, at = [], 0
    for row in totals:
        bases.append((row["part"], at))
        at += row["n"]
    base = spark.createDataFrame(bases, "part long, base long")
    kind = left.schema["doc_id"].dataType.simpleString()
    first = F.col("base") + F.col("offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, start, length, n, at, ids in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "start", "length", "doc_tokens", "at", "ids"))):
                while length:
                    take = min(length, size - at % size)
                    raw = ids[: 4 * take]
                    for col, v in zip(cols, (doc, start, take, zlib.crc32(raw), n, -1 - at // size, at % size, raw)):
                        col.append(v)
                    ids, start, at, length = ids[4 * take :], start + take, at + take, length - take
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return left.join(base, "part").withColumn("at", first).select("doc_id", "start", "length", "doc_tokens", "at", "ids").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
