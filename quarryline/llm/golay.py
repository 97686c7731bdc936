"""Keys of fingerprints from the perfect binary Golay code.

Every 23-bit word lies within distance 3 of exactly one of the 4096 codewords.
A 64-bit fingerprint is cut into three segments, filled with zeros to 23 bits.
If two fingerprints differ in at most 4 bits, the errors of some two segments
add up to at most 2 (all three pairs of segments together see each error
twice).  For each pair of segments (A, B) the keys of a fingerprint are

- (a, b) with a within distance 4 of A and b the codeword nearest to B,
- (a, b) with a the codeword nearest to A and b within distance 4 of B.

Two fingerprints with at most 2 errors in A and B share one of them:

- one error each: the nearest codeword of A in one lies within 4 of A in the
  other, and that of B in the other within 4 of B in the one;
- two errors in A: a word halfway is at distance 1 of both, so its nearest
  codeword lies within 4 of both, and B is equal; likewise for B.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011
"""x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the cyclic [23, 12, 7] code."""

#: First bits and widths of the segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
PAIRS = [(0, 1), (0, 2), (1, 2)]


@lru_cache
def _syndromes() -> np.ndarray:
    """Remainders of x^i by the generator."""
    out = np.zeros(N, np.int64)
    for i in range(N):
        r = 1 << i
        for j in range(N - 1, N - K - 1, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - (N - K))
        out[i] = r
    return out


@lru_cache
def _low_byte_tables() -> list[np.ndarray]:
    """Syndromes of the words' bytes."""
    s = _syndromes()
    out = []
    for byte in range(3):
        t = np.zeros(256, np.int64)
        for i in range(8):
            if 8 * byte + i < N:
                t ^= np.where(np.arange(256) >> i & 1, s[8 * byte + i], 0)
        out.append(t)
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    a, b, c = _low_byte_tables()
    return a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16 & 127]


@lru_cache
def _errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome its pattern of at most 3 errors; all its patterns of 4 errors (filled up with the first), and their number."""
    s = _syndromes()
    near = np.zeros(1 << (N - K), np.int64)
    far: list[list[int]] = [[] for _ in range(1 << (N - K))]
    for weight in range(5):
        for bits in combinations(range(N), weight):
            syn, pattern = 0, 0
            for i in bits:
                syn ^= int(s[i])
                pattern |= 1 << i
            if weight < 4:
                near[syn] = pattern
            else:
                far[syn].append(pattern)
    count = np.array([len(x) for x in far])
    table = np.array([x + [x[0] if x else 0] * (count.max() - len(x)) for x in far])
    return near, table, count


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (information bits) of the codeword nearest to each word."""
    return (words ^ _errors()[0][syndrome(words)]) >> (N - K)


def within_four(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within distance 4, the nearest first, and how many each word has."""
    near, far, count = _errors()
    s = syndrome(words)
    return np.concatenate([(words ^ near[s])[:, None], words[:, None] ^ far[s]], axis=1) >> (N - K), count[s] + 1


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys (26 bits) of 64-bit fingerprints, and the fingerprint of each."""
    rows = np.arange(len(fingerprints))
    words = [(fingerprints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]
    lists = [within_four(w) for w in words]
    out, of = [], []
    for p, (i, j) in enumerate(PAIRS):
        (a, na), (b, nb) = lists[i], lists[j]
        for k in range(a.shape[1]):
            own = rows[k < na]
            out.append(p << 2 * K | a[own, k] << K | b[own, 0])
            of.append(own)
        for k in range(1, b.shape[1]):
            own = rows[k < nb]
            out.append(p << 2 * K | a[own, 0] << K | b[own, k])
            of.append(own)
    return np.concatenate(out), np.concatenate(of)


#: First bits and widths of the parts of a segment that further keys are made of.
PARTS = [(0, 7), (7, 7), (14, 8)]


def further_keys(fingerprints: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Further keys (44 bits) of fingerprints that share a long key, and the row of each.

    The key's two segments have at most 2 errors, the third at most 4.  Cut into
    three parts, some two of its parts have at most 2 errors together, so two
    words of these parts that take all words within distance 1 share one.
    """
    out, of = [], []
    pair_of = keys >> 2 * K
    for p, (i, j) in enumerate(PAIRS):
        rows = np.flatnonzero(pair_of == p)
        if not len(rows):
            continue
        first, width = SEGMENTS[3 - i - j]
        word = (fingerprints[rows] >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        part = [word >> a & (1 << w) - 1 for a, w in PARTS]
        for q, (a, b) in enumerate(PAIRS):
            both = part[a] << PARTS[b][1] | part[b]
            for flip in [0, *(1 << k for k in range(PARTS[a][1] + PARTS[b][1]))]:
                out.append((keys[rows] << 2 | q) << 16 | both ^ flip)
                of.append(rows)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out]), np.concatenate([none, *of])
