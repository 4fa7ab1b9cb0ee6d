"""Words and substring hashes of text blocks, whole columns at a time.

A word is ``[^\\x20\\x09-\\x0D]+``. Every substring of a block has a 64-bit hash
in constant time: prefix sums of ``byte * P**i`` modulo 2**64, of which a
difference is divided by ``P**start`` (P is odd, so it has an inverse) and mixed.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
P, Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: ASCII capitals to small letters, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to ``n``; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums for :func:`spans`, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    p, _ = powers(base, len(values))
    np.cumsum(values.astype(np.uint64) * p[: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans ``[start, end)``."""
    _, inv = powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


class Words:
    """Words of a block of rows: ``start``, ``end`` (bytes), ``row``, ``hash``; ``first[row]`` is the row's first word.

    ``space``: a table of the bytes that end a word.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        n, rows = len(buf), len(offsets) - 1
        word = ~space[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        left = word.copy()
        left[1:] &= ~word[:-1] | edge[1:n]
        right = word.copy()
        right[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.prefix = sums(buf.astype(np.uint64) + np.uint64(1), P)
        self.hash = spans(self.prefix, self.start, self.end, P)
        self.rows = rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of ``k`` words that lies in one row; window i starts at word ``at[i]``."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    h = words.hash[at]
    for j in range(1, k):
        h = h * np.uint64(Q) + words.hash[at + j]
    return mix(h), at
