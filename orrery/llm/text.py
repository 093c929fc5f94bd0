"""Words and shingles of whole texts, for the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept per process, as long as the longest text."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            table = np.empty(size, np.uint64)
            table[0], have = 1, 1
            while have < size:
                step = np.uint64(pow(base, have, 2**64))
                table[have : 2 * have] = table[:have] * step
                have *= 2
            _powers[k] = table
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of table[byte] * base**position over data[i:j]."""
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    _, inverse = _power_tables(len(prefix))
    raw = (prefix[end] - prefix[start]) * inverse[start]
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text: A-Z lower-cased, words
    without the ASCII white space 09-0D and 20. Fewer than n words: the whole sequence as one
    shingle; no words: empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    prefix = prefix_hash(np.frombuffer(joined, np.uint8))
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    if len(words) < n:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: len(words) - n + 1], end[n - 1 :]
    return np.unique(span_hash(prefix, start, end))
