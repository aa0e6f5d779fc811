"""Words and word shingles of many texts as 64-bit hashes, in numpy passes over their bytes.

Hashes are the same in every process. A word's hash is a polynomial over its
bytes with random 64-bit values for bytes, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 64, 256, dtype=np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; grown as needed."""
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            out = np.full(n, p, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, hash of each word in order). Words: runs outside space and \\t..\\r; A-Z lower-cased if asked."""
    buffer = b"\n".join(texts) + b"\n"
    if lower:
        buffer = buffer.translate(LOWER)
    raw = np.frombuffer(buffer, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[::2], edge[1::2]
    p, inv = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.diff(np.searchsorted(begin, ends), prepend=0), words


def shingle_sets(texts: list[bytes], width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(set size per text, sorted distinct shingle hashes text by text).

    A text with fewer than ``width`` words has its whole sequence as one shingle; without words, none.
    """
    count, words = word_hashes(texts, lower)
    first = np.cumsum(count) - count
    n = np.maximum(count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    h = np.zeros(len(owner), np.uint64)
    last = np.repeat(first + count, n)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for d in range(width):
        h = mix(h + _U(_P)) + np.where(at + d < last, padded[at + d], _U(d + 1))
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=len(texts)).astype(np.int64), h[fresh]
