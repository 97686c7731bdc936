"""Blockwise suffix sorting of bytes with a difference cover.

``SuffixSorter`` ranks a sample of the suffixes first: those at positions
whose residue modulo ``V`` lies in a difference cover, so that for any two
positions i and j some shift k < V puts both i + k and j + k into the sample.
Buckets of suffixes are then sorted one at a time: by their first V bytes,
and where these agree by the ranks of the sample suffixes k further on, so a
long tie costs one comparison of two numbers.  Besides the text and the
sample's ranks only one bucket is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

V = 7
COVER = (0, 1, 3)
"""Every residue modulo 7 is a difference of two members."""
_SLOT = np.full(V, -1)
_SLOT[list(COVER)] = range(len(COVER))
SHIFT = np.array([[next(k for k in range(V) if (a + k) % V in COVER and (b + k) % V in COVER) for b in range(V)] for a in range(V)])


def first_alike(*keys: np.ndarray) -> np.ndarray:
    """In sorted keys, for each place the first place with the same key."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


#: Suffixes of a bucket, about; suffixes with the same first V bytes stay together.
BUCKET = 1 << 18


def words8(text: np.ndarray) -> np.ndarray:
    """A view of the 8 bytes at every position as one big-endian number; ``text`` must have 8 bytes to spare."""
    return np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))


class SuffixSorter:
    def __init__(self, text: np.ndarray):
        self.size = len(text)
        self.text = np.concatenate([np.asarray(text, np.uint8), np.zeros(4 * V + 16, np.uint8)])
        self.words = words8(self.text)
        columns = self.size // V + 3
        place = V * np.arange(columns)[None, :] + np.array(COVER)[:, None]
        place = np.minimum(place, len(self.words) - 1)
        word = (self.words[place].astype(np.uint64) >> np.uint64(8)).astype(np.int64)
        # a suffix that ends within the word comes before one that goes on with zero bytes
        left = np.clip(self.size - place, 0, V)
        key = (word * (V + 1) + left).reshape(-1)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = first_alike(key[order])
        # ranks are places of groups of equal suffixes; doubling splits the groups that are left
        step, real = 1, left.reshape(-1) > 0
        while step < columns:
            tied = np.flatnonzero((np.bincount(rank, minlength=len(rank)) > 1)[rank] & real)
            if not len(tied):
                break
            further = np.where(tied % columns + step < columns, rank[np.minimum(tied + step, len(rank) - 1)] + 1, 0)
            order = np.lexsort((further, rank[tied]))
            own, further = rank[tied[order]], further[order]
            rank[tied[order]] = own + first_alike(own, further) - first_alike(own)
            step *= 2
        self.rank = rank.reshape(word.shape)

    def _rank(self, at: np.ndarray) -> np.ndarray:
        return self.rank[_SLOT[at % V], at // V]

    def sort(self, suffixes: np.ndarray) -> np.ndarray:
        """The suffixes of one bucket in order; equal ones (as far as they are compared) stay next to each other."""
        word = (self.words[suffixes].astype(np.uint64) >> np.uint64(8)).astype(np.int64)
        head = np.unique(word * (V + 1) + np.minimum(self.size - suffixes, V), return_inverse=True)[1]
        scale = self.rank.size + 1
        residue = suffixes % V
        lists, heads = [], []
        for r in range(V):
            own = np.flatnonzero(residue == r)
            order = np.argsort(head[own] * scale + self._rank(suffixes[own] + SHIFT[r, r]), kind="stable")
            lists.append(suffixes[own[order]])
            heads.append(head[own[order]] * scale)
        out = np.empty_like(suffixes)
        for a in range(V):
            if not len(lists[a]):
                continue
            place = np.arange(len(lists[a]))
            for b in range(V):
                if a != b and len(lists[b]):
                    k = SHIFT[a, b]
                    mine, theirs = heads[a] + self._rank(lists[a] + k), heads[b] + self._rank(lists[b] + k)
                    place = place + np.searchsorted(theirs, mine, "right" if b < a else "left")
            out[place] = lists[a]
        return out

    def buckets(self, suffixes: np.ndarray, size: int = BUCKET) -> Iterator[np.ndarray]:
        """Sorted buckets, in order."""
        if len(suffixes) <= size:
            if len(suffixes):
                yield self.sort(suffixes)
            return
        word = self.words[suffixes].astype(np.uint64) >> np.uint64(8)
        sample = np.sort(word[:: max(1, len(word) // 4096)])
        pieces = -(-len(suffixes) // size)
        cuts = np.unique(sample[(np.arange(1, pieces) * len(sample)) // pieces])
        bucket = np.searchsorted(cuts, word, "right")
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(cuts) + 2))
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield self.sort(suffixes[order[a:b]])

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n bytes at a and at b agree."""
        if n < 8:
            out = np.ones(len(a), bool)
            for k in range(n):
                out &= self.text[a + k] == self.text[b + k]
            return out
        out = self.words[a] == self.words[b]
        for k in [*range(8, n - 7, 8), n - 8]:
            out &= self.words[a + k] == self.words[b + k]
        return out


def suffix_array(text: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """All suffixes in order, a shorter one before those that it begins."""
    sorter = SuffixSorter(text)
    return np.concatenate([*sorter.buckets(np.arange(len(text), dtype=np.int64), bucket), np.zeros(0, np.int64)]).astype(np.int64)
