"""Hashes of byte spans, many at a time.

A span's hash is a sum of random values of its bytes times powers of an odd
number, so all spans of a text come from one running sum; it depends on the
span's bytes alone.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG_WORD = 256
WORDS_PER_BLOCK = 3000
_BASE = 0x9E3779B97F4A7C15 | 1
_LIMIT = (WORDS_PER_BLOCK + 64) * (LONG_WORD + 1)

_random = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n of a base modulo 2^64; kept, and grown by doubling."""
    table = _tables.get(base)
    if table is None or len(table) <= n:
        size = 1 << max(12, int(n).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _tables[base] = table
    return table


_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (one-to-one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def running(data: np.ndarray) -> np.ndarray:
    """Running sum over bytes; element i covers the first i bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, len(data))[:len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the text behind ``sums``."""
    back = _powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts])


def _short(word: bytes) -> bytes:
    if len(word) <= LONG_WORD:
        return word
    return b"\x00" + hashlib.blake2b(word, digest_size=32).digest()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence if it is
    shorter; none without words.  A word of over 256 bytes counts by its digest."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    every = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if every.max() > LONG_WORD:
        words = [_short(w) for w in words]
        every = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    size = min(size, len(words))
    parts = []
    for at in range(0, len(words) - size + 1, WORDS_PER_BLOCK):
        block = words[at:at + WORDS_PER_BLOCK + size - 1]
        lengths = every[at:at + len(block)]
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        sums = running(np.frombuffer(b" ".join(block), dtype=np.uint8))
        parts.append(spans(sums, starts[:len(block) - size + 1], ends[size - 1:]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
