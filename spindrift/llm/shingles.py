"""Word and shingle hashes of whole texts, computed over Arrow buffers with no loop over words.

A word is a run of bytes other than space and \\t..\\r, with A-Z lower-cased. Its 64-bit hash is a polynomial over
random byte values, taken from one running sum and mixed; a shingle's hash combines those of its words in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import CACHES, text_bytes

U = np.uint64
_RNG = np.random.default_rng(7151)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE = U(0x9E3779B97F4A7C15)
_UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
#: Bytes that are summed at once; bounds memory.
BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []
CACHES["shingles"] = _POWERS.clear


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK)
        _POWERS[:] = [np.cumprod(np.concatenate(([U(1)], np.full(size - 1, base)))) for base in (_BASE, _UNBASE)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and the word numbers at which the texts (cut at offsets) begin."""
    n = len(data)
    space = _SPACE[data]
    opens = ~space
    opens[1:] &= space[:-1]
    closes = ~space
    closes[:-1] &= space[1:]
    heads = offsets[(offsets > 0) & (offsets < n)]  # words do not run on from text to text
    opens[heads] = ~space[heads]
    closes[heads - 1] = ~space[heads - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return token_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in rising order that do not overlap."""
    found = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        high = ends[to - 1]
        power, back = _powers(int(high - low))
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        found[at:to] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        at = to
    return found


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, U(size))
    for k in range(size):
        total += words[k : k + n] * PLACES[k]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order, one text after another, and their numbers.

    A text of fewer words is one shingle, its whole sequence; one without words, null or empty, has none.
    """
    data, offsets = text_bytes(texts)
    words, _, _, bounds = word_hashes(data, offsets)
    every = windows(words, size)
    parts = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            part = every[a : b - size + 1].copy()
            part.sort()
        else:
            part = windows(words[a:b], b - a) if b > a else words[:0]
        parts.append(part)
    flat = np.concatenate(parts) if parts else words[:0]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    doc = np.repeat(np.arange(len(parts)), counts)
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[new], np.bincount(doc[new], minlength=len(parts)).astype(np.int64)
