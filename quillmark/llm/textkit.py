"""Word hashes and rolling hashes over whole texts, vectorised with numpy.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r. All hashes are
unsigned 64-bit, wrap on overflow, and depend on nothing but the words.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the two hash families.
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_LONG = 1 << 14
_POWERS = [np.concatenate(([U(1)], np.cumprod(np.full(_LONG - 1, base)))) for base in BASES]
_BLOCK = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text, and byte offsets of the starts and ends of its words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = np.ones(data.size + 2, np.int8)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(np.diff(space))
    return data, edge[0::2], edge[1::2]


def hash_words(text: str, families: int = 1) -> list[np.ndarray]:
    """One array of word hashes for each family; empty arrays for a text without words."""
    data, starts, ends = spans(text)
    lens = ends - starts
    out = [np.empty(starts.size, U) for _ in range(families)]
    at = 0
    while at < starts.size:
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK)))
        piece, n = data[starts[at] : ends[upto - 1]], lens[at:upto]
        own = piece[~_SPACE[piece]].astype(U) + U(1)
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        off = np.arange(own.size) - np.repeat(first, n)
        for k in range(families):
            out[k][at:upto] = mix(np.add.reduceat(own * _POWERS[k][off & (_LONG - 1)], first) + n.astype(U) * BASES[1 - k])
        at = upto
    for i in np.flatnonzero(lens > _LONG):  # beyond the table of powers
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        for k in range(families):
            out[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out


def rolling(h: np.ndarray, k: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values, by doubling; empty if there are fewer than k."""
    n = h.size - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, done, block, size, power = None, 0, h, 1, base
    while size <= k:
        if k & size:
            part = block[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        if 2 * size <= k:
            block = block[:-size] * power + block[size:]
        with np.errstate(over="ignore"):
            power, size = power * power, 2 * size
    return mix(out)


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive values, by doubling."""
    size = 1
    while size < k:
        step = min(size, k - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def shingles(text: str, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words and their counts; a shorter text is one shingle, an empty one none."""
    words = hash_words(text)[0]
    if not words.size:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.unique(rolling(words, min(k, words.size)), return_counts=True)
