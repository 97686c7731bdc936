"""Suffix arrays of word sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

from .suffixes import first_alike


class Words:
    """Word ids from 1 to ``n_words``; 0 ends a text, or stands for a word that equals nothing. Several ids are packed into one 63-bit key; words behind a 0 count as 0."""

    def __init__(self, tokens: np.ndarray, n_words: int):
        self.tokens = np.append(tokens.astype(np.int64), 0)
        self.bits = max(1, int(n_words).bit_length())
        self.per_key = max(1, 63 // self.bits)
        #: How many words there are from each place to the next 0.
        ends = np.flatnonzero(self.tokens == 0)
        self.run = ends[np.searchsorted(ends, np.arange(len(self.tokens)))] - np.arange(len(self.tokens))

    def packed(self, at: np.ndarray, level: int, most: np.ndarray | None = None, fill: bool = False) -> np.ndarray:
        """Words ``level * per_key`` and following of the suffixes; those from word ``most`` on count as 0, or with ``fill`` as larger than all."""
        key, run = np.zeros(len(at), np.int64), self.run[at]
        for j in range(self.per_key):
            k = level * self.per_key + j
            word = np.where(k < run, self.tokens[np.minimum(at + k, len(self.tokens) - 1)], 0)
            if most is not None:
                word = np.where(k < most, word, (1 << self.bits) - 1 if fill else 0)
            key = key << self.bits | word
        return key


class WordSuffixArray(Words):
    """All suffixes that begin with a word, in order, each up to its next 0: sorted by their first key, then ties by the ranks of the suffixes behind, twice as far in every round."""

    def __init__(self, tokens: np.ndarray, n_words: int):
        super().__init__(tokens, n_words)
        at = np.flatnonzero(self.tokens)
        key = self.packed(at, 0)
        order = np.argsort(key, kind="stable")
        self.suffixes, self.first_keys = at[order], key[order]
        group = first_alike(self.first_keys)
        rank = np.zeros(len(self.tokens), np.int64)
        rank[self.suffixes] = group + 1
        step = self.per_key
        while True:
            tied = np.flatnonzero((np.bincount(group, minlength=len(group)) > 1)[group] & (self.run[self.suffixes] >= step))
            if not len(tied):
                break
            further = rank[self.suffixes[tied] + step]
            order = np.lexsort((further, group[tied]))
            moved, own, further = self.suffixes[tied[order]], group[tied[order]], further[order]
            self.suffixes[tied] = moved
            group[tied] = tied[first_alike(own, further)]
            rank[moved] = group[tied] + 1
            step *= 2

    def _bound(self, lo: np.ndarray, hi: np.ndarray, key: list[np.ndarray], after: bool) -> np.ndarray:
        """For each range the first suffix that is not smaller than the keys, or with ``after`` that is larger."""
        lo, hi = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            below, same = np.zeros(len(live), bool), np.ones(len(live), bool)
            for level in range(1, len(key)):
                own = self.packed(self.suffixes[mid], level)
                below |= same & (own < key[level][live])
                same &= own == key[level][live]
            right = below | same if after else below
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        return lo

    def ranges(self, low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of patterns, given level by level by the smallest and largest keys of suffixes that begin with them: the places in ``suffixes`` of those."""
        lo, hi = np.searchsorted(self.first_keys, low[0], "left"), np.searchsorted(self.first_keys, high[0], "right")
        more = np.flatnonzero(hi > lo)
        if len(low) > 1 and len(more):
            a, b = lo[more], hi[more]
            lo[more] = self._bound(a, b, [k[more] for k in low], False)
            hi[more] = self._bound(a, b, [k[more] for k in high], True)
        return lo, np.maximum(lo, hi)


def extend(text: np.ndarray, at: np.ndarray, pattern: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Length of the common prefix of text[at[i]:] and pattern[begin[i]:]; 0 ends either."""
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    text, pattern = np.append(text, 0), np.append(pattern, 0)
    while len(live):
        a, b = at[live] + length[live], begin[live] + length[live]
        same = (a < len(text)) & (b < len(pattern))
        same[same] = (text[a[same]] == pattern[b[same]]) & (text[a[same]] != 0)
        live = live[same]
        length[live] += 1
    return length
