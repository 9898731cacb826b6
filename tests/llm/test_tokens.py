import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import bpe, packing, token_counts
from tallyspark.llm.queries import tokenizer

from .helpers import KIND, documents, texts

spm = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")
PIECE, WORD = "piece_bpe_32k.model", "word_bpe_49k.json"
ALPHABETS = ["ab", "the in tion erer ", " \n\t▁é", "  ", "中文日本語", "😀‍👨", "aaaa", "ing ed 4567", ".,!?##$$ ", "<s></s><unk><0x41>", "\x00\x01\x7f　﻿́", "İΣς ﬁ½²", "'s 're <|endoftext|>"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    out = ["", " ", "  ", "a ", "a  ", "▁", "▁▁a", "a" * 3000, "ab" * 1500, " " * 1000, "".join(rnd.choice("abcdeinghto") for _ in range(5000))]
    for _ in range(n):
        letters = rnd.choice(ALPHABETS) + rnd.choice(ALPHABETS)
        out.append("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))))
    return out


def library():
    return spm.SentencePieceProcessor(model_file=tokenizer(PIECE))


def test_merge_rounds_equal_the_library():
    sp, enc, values = library(), bpe.encoder(tokenizer(PIECE)), odd_texts(1500)
    for text, ids in zip(values, enc.encode(values)):
        assert ids.tolist() == sp.encode(text)
        assert enc.model.decode([1, *ids.tolist(), 2]) == sp.decode([1, *ids.tolist(), 2])


def test_decoding_any_ids_equals_the_library():
    sp, model, rnd = library(), bpe.merges(tokenizer(PIECE)), random.Random(2)
    for _ in range(300):
        ids = [rnd.choice([0, 1, 2, *range(3, 259), *[rnd.randrange(259, 32000) for _ in range(200)]]) for _ in range(rnd.randint(0, 30))]
        assert model.decode(ids) == sp.decode(ids)


def test_digests(spark):
    sp, docs = library(), documents(spark)
    want = Counter()
    for r in docs.collect():
        ids = [1, *sp.encode(r.text or ""), 2]
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_digests(docs, tokenizer(PIECE)).collect())) == want
    for r in bpe.encode_texts(docs, tokenizer(PIECE)).collect():
        assert sp.decode(r.ids) == r.decoded
    assert bpe.encode_digests(spark.createDataFrame([], KIND), tokenizer(PIECE)).count() == 0


def test_counts(spark, monkeypatch):
    sp, docs = library(), documents(spark, texts() + odd_texts(100))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 50) for r in docs.collect())
    assert Counter(map(tuple, token_counts.token_counts(docs, tokenizer(PIECE), limit=50).collect())) == want
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    assert Counter(map(tuple, token_counts.token_counts(docs, tokenizer(PIECE), limit=50).collect())) == want
    assert token_counts.token_counts(spark.createDataFrame([], KIND), tokenizer(PIECE)).count() == 0


def test_lighter_sketches_are_lower_bounds():
    rnd = random.Random(3)
    stream = [f"w{min(int(rnd.paretovariate(1)), 500)}" for _ in range(20_000)]
    true, sketch = Counter(stream), Counter()
    for at in range(0, len(stream), 500):
        sketch = token_counts._lighter(sketch + Counter(stream[at : at + 500]), 60)
    assert all(n <= true[w] for w, n in sketch.items()) and {w for w, _ in true.most_common(8)} <= set(sketch)


def test_chunks_equal_the_library():
    enc = packing.ChunkEncoder(tokenizer(WORD))
    values = odd_texts(1500, 5)
    for text, ids in zip(values, enc.encode(values)):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, ids_of, size):
    """Every id in one piece, pieces gapless in their sequences; the padding."""
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert by.keys() == ids_of.keys()
    for doc, pieces in by.items():
        ids, times = ids_of[doc]
        spots = Counter()
        for r in pieces:
            assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            spots.update(range(r.start, r.start + r.length))
        assert spots == Counter(dict.fromkeys(range(len(ids)), times))
    padding = 0
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += size - at
    return padding, len(seq)


@pytest.mark.parametrize(("size", "windows"), [(64, 3), (2048, 32)])
def test_packing(spark, size, windows):
    docs = documents(spark, texts(150))
    lib = packing.ChunkEncoder(tokenizer(WORD)).tokenizer
    times = Counter(r.doc_id for r in docs.collect())
    ids_of = {r.doc_id: ([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], times[r.doc_id]) for r in docs.collect()}
    rows = packing.pack(docs, tokenizer(WORD), size=size, windows=windows, min_piece=4, keep_ids=True).collect()
    padding, n = check_packing(rows, ids_of, size)
    assert padding <= 0.03 * n * size + size
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert packing.pack(spark.createDataFrame([], KIND), tokenizer(WORD)).count() == 0


def test_windows_stay_few():
    rnd, space = random.Random(9), packing.Windows(100, 4, 5)
    used, sealed = Counter(), set()
    for _ in range(2000):
        n = rnd.choice([1, 3, 40, 99, 100, 101, 350, rnd.randint(1, 120)])
        pieces, done = space.place(n)
        assert sum(p[3] for p in pieces) == n
        for w, offset, _, length in pieces:
            assert w not in sealed and used[w] == offset
            used[w] += length
        sealed |= set(done)
        assert len(space.open) <= 4
    assert all(used[w] > 100 - 10 for w in sealed)
