"""Hashes of words and runs of them, and compact bytes for arrays of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes or numbers."""
    x = prefix * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below top, ascending, and for each value which it is. Where both fit into 64 bits, value and place are sorted as one number."""
    bits = max(1, len(values) - 1).bit_length()
    if max(0, top - 1).bit_length() + bits <= 64:
        packed = np.sort((values.astype(np.uint64) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64))
        keys, places = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        places = np.argsort(values)
        keys = values[places].astype(np.uint64)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.int32)
    which[places] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], which


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers of any order, none negative: the bytes of each place together, compressed."""
    planes = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)
    used = next((k for k in range(8, 0, -1) if planes[:, k - 1].any()), 1)
    return len(values).to_bytes(8, "little") + bytes([used]) + pa.compress(np.ascontiguousarray(planes[:, :used].T).tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * used, codec="zstd", asbytes=True), np.uint8).reshape(used, n).T
    return planes.view("<i8").ravel()


def ascending(values: np.ndarray) -> bytes:
    """Ascending distinct numbers below 2^64: low bits as they are, high bits as places of ones (Elias and Fano's code)."""
    n = len(values)
    if not n:
        return b""
    low = max(0, int(values[-1]).bit_length() - n.bit_length())
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    ones = np.zeros(int(high[-1]) + 1, np.uint8)
    ones[high] = 1
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=low) if low else np.zeros((n, 0), np.uint8)
    return n.to_bytes(8, "little") + bytes([low]) + np.packbits(bits.ravel()).tobytes() + np.packbits(ones).tobytes()


def numbers(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, low, raw = int.from_bytes(data[:8], "little"), data[8], np.frombuffer(data, np.uint8)[9:]
    cut = -(-n * low // 8)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :low] = np.unpackbits(raw[:cut], count=n * low).reshape(n, low)
    high = (np.flatnonzero(np.unpackbits(raw[cut:]))[:n] - np.arange(n)).astype(np.uint64)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel() | (high << np.uint64(low))
