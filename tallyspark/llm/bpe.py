"""BPE encoding by vectorised merge rounds, and decoding, exactly as the sentencepiece library does both.

All new segments of a block of texts are encoded at once: their symbols lie in one flat numpy array, on which
rounds.Rounds works until no segment has a pair that merges.

Null and empty texts give the begin and end ids only. Repeated rows give repeated results; an empty table gives none.
Very long texts are handled whole: memory grows with the longest block. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_text, slices
from .pieces import SPACE, check_model, segments
from .rounds import Remembered, Rounds

#: Segments whose ids a worker remembers.
CACHED = 1_000_000


class Merges:
    """A BPE model with byte fallback: merge ranks and pieces as arrays."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        check_model(path)
        m = pb.ModelProto()
        m.ParseFromString(open(path, "rb").read())
        pieces = list(m.pieces)
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
        self.bytes_at = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if p.type == 6:
                self.bytes_at[int(p.piece[1:-1], 16)] = i
        self.begin, self.end = (next(i for i, p in enumerate(pieces) if p.piece == x) for x in ("<s>", "</s>"))
        #: symbols: the pieces, and behind them every character that is no piece
        self.size = len(pieces)
        self.char_at = np.arange(self.size, self.size + 0x110000)
        for c, i in normal.items():
            if len(c) == 1:
                self.char_at[ord(c)] = i
        symbol = lambda x: normal.get(x, self.size + ord(x) if len(x) == 1 else None)
        #: equal scores have equal ranks; a higher score merges first
        at = {s: r for r, s in enumerate(sorted({p.score for p in pieces if p.type == 1}, reverse=True))}
        pairs = {}
        for x, i in normal.items():
            for cut in range(1, len(x)):
                left, right = symbol(x[:cut]), symbol(x[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (at[pieces[i].score], i)
        self.rounds = Rounds(pairs, self.size + 0x110000)
        self.surface = [_surface(p) for p in pieces]
        self.byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(pieces) if p.type == 6}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after another, and how many each has; its space in front added, no begin or end."""
        marked = [(SPACE + x).replace(" ", SPACE) for x in texts]
        lens = np.fromiter(map(len, marked), np.int64, len(marked))
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        return self._ids(*self.rounds.run(np.repeat(np.arange(len(texts)), lens), self.char_at[chars]), len(texts))

    def _ids(self, seg: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids; a character without a piece becomes its bytes."""
        plain = sym < self.size
        if not plain.all():
            lens = np.ones(len(sym), np.int64)
            other = np.flatnonzero(~plain)
            raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in (sym[other] - self.size).tolist()]
            lens[other] = [len(x) for x in raw]
            to = np.cumsum(lens) - lens
            out = np.empty(int(lens.sum()), np.int64)
            out[to[plain]] = sym[plain]
            spots = np.repeat(to[other] - np.cumsum(np.r_[0, lens[other][:-1]]), lens[other]) + np.arange(int(lens[other].sum()))
            out[spots] = self.bytes_at[np.concatenate(raw)]
            seg, sym = np.repeat(seg, lens), out
        return sym.astype(np.uint32), np.bincount(seg, minlength=n)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: control ids vanish, the first space goes, bytes that aren't UTF-8 become U+FFFD each."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        return text[1:] if text.startswith(" ") and self._starts_with_space(ids) else text

    def _starts_with_space(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.surface[i] or i in self.byte_of), None)
        return first is not None and first not in self.byte_of and self.surface[first] != UNKNOWN

    def _repaired(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


UNKNOWN = " ⁇ ".encode()


def _surface(p) -> bytes:
    if p.type == 6:
        return bytes([int(p.piece[1:-1], 16)])
    return {2: UNKNOWN, 3: b""}.get(p.type, p.piece.replace(SPACE, " ").encode())


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Ids of whole texts; remembers the ids of a bounded number of segments."""

    def __init__(self, path: str) -> None:
        self.model = merges(path)
        self.known = Remembered(self.model.encode, CACHED)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [segments(x) for x in texts]
        self.known.know(set(chain.from_iterable(parts)))
        return [self.known.joined(x) for x in parts]


_worker: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (with begin and end) and decoded text of each row."""
    return _apply(docs, model, doc_id, text, lambda ids, decoded: {"ids": (pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), None), "decoded": (decoded, pa.string())}, "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (little-endian uint32, begin and end included) and of the decoded text."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _apply(docs, model, doc_id, text, lambda ids, decoded: {"n_tokens": ([len(x) for x in ids], pa.int64()), "ids_sha256": ([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()), "decoded_sha256": ([sha(x.encode()) for x in decoded], pa.string())}, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _apply(docs: DataFrame, model: str, doc_id: str, text: str, columns, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        ends = [np.array([x], np.uint32) for x in (enc.model.begin, enc.model.end)]
        for batch in slices(batches, 256):
            ids = [np.concatenate([ends[0], x, ends[1]]) for x in enc.encode(as_text(batch))]
            yield arrow({"doc_id": (batch.column("doc_id"), None)} | columns(ids, [enc.model.decode(x.tolist()) for x in ids]))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
