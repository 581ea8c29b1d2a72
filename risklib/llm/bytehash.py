"""Vectorised hashing of words, word shingles and byte strings inside tasks (numpy only).

Hashes are polynomials over random 64-bit values per byte, modulo 2**64, taken
from prefix sums: the hash of bytes [a, b) is (S[b] - S[a]) * P**-a. A final
mix spreads them over all bits.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F88691, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P**0 ... P**n modulo 2**64 (or of its inverse), kept per worker."""
    have = _POWERS.get(inverse)
    if have is None or len(have) <= n:
        p = np.full(max(n + 1, 1 << 20), P_INV if inverse else P, np.uint64)
        p[0] = 1
        have = _POWERS[inverse] = np.multiply.accumulate(p)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of value(byte j) * P**j for j < i."""
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(BYTE[buf] * powers(len(buf))[:len(buf)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of byte spans, given the prefix sums."""
    return mix((s[end] - s[start]) * powers(len(s), True)[start] + (end - start).astype(np.uint64))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space separated words of the texts, and the number of words of each text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~SPACE[buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(start, ends, "left"), prepend=0)
    return span_hash(prefix_sums(buf), start, end), counts


def shingles_of(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``k`` words, and their number per text.

    A text of 1 to k - 1 words has one shingle of all its words; none has none.
    """
    n = len(words)
    ends = np.cumsum(counts)
    chain = np.repeat(np.arange(len(counts)), counts)
    end = ends[chain]
    at = np.arange(n)
    total = np.zeros(n, np.uint64)
    mixed = mix(words)
    for j in range(k):
        there = np.minimum(at + j, max(n - 1, 0))
        total += np.where(at + j < end, mixed[there] if n else 0, np.uint64(0)) * SHINGLE[j % len(SHINGLE)] * np.uint64(1 + 2 * (j // len(SHINGLE)))
    first = at == (ends - counts)[chain]
    use = (at + k <= end) | (first & (counts[chain] < k))
    per = np.bincount(chain[use], minlength=len(counts)) if n else np.zeros(len(counts), np.int64)
    return mix(total[use]), per
