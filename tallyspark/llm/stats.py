"""Statistics of whole texts, computed for a block of texts at a time inside a worker."""

from __future__ import annotations

from itertools import chain

import numpy as np

BLANK = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    return [x.split() for x in texts]  # bytes split at ASCII white space only


def repeated_words(words: list[list[bytes]], width: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of width words that it has twice or more, first ones included.

    Windows are compared by 64-bit hashes of their words and text.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if n < width:
        return np.zeros(len(words), np.int64)
    flat = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, n).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    m = n - width + 1
    key = doc[:m].astype(np.uint64) * _MIX[4]
    for k in range(width):
        key = (key ^ flat[k : k + m]) * _MIX[k % 5]
        key ^= key >> np.uint64(29)
    starts = np.flatnonzero(doc[:m] == doc[width - 1 :])
    key = key[starts]
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts[again], 1)
    np.subtract.at(cover, starts[again] + width, 1)
    return np.bincount(doc, weights=np.cumsum(cover)[:n] > 0, minlength=len(words)).astype(np.int64)


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    return len(lines), len(lines) - len(set(lines))
