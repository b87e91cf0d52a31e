"""FM-index of word ids: suffix order, wavelet matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(key: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``key`` must end in a value that occurs once.
    Only suffixes that still tie are sorted again."""
    n = len(key)
    sa = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[sa]) != 0)))
    slot = np.repeat(first, np.diff(np.append(first, n)))  # each row's group, named by its first row
    rank = np.empty(n, np.int64)
    rank[sa] = slot
    rows = np.arange(n)
    h = 1
    while True:
        size = np.bincount(slot - slot[0] if len(slot) else slot, minlength=1)
        tied = size[slot - slot[0]] > 1 if len(slot) else np.zeros(0, bool)
        rows, slot = rows[tied], slot[tied]
        if not len(rows):
            return sa
        sub = sa[rows]
        second = rank[np.minimum(sub + h, n - 1)]
        order = np.lexsort((second, slot))
        sub, second = sub[order], second[order]
        sa[rows] = sub  # groups stay in their own rows
        new = np.concatenate(([True], (np.diff(slot) != 0) | (np.diff(second) != 0)))
        slot = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rank[sub] = slot
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit vector per bit of a symbol."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.n, self.levels = len(seq), []
        seq = seq.astype(np.int64)
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(seq) // 64 + 2, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.levels.append((bit, words, counts, int((~one).sum())))
            seq = np.concatenate((seq[~one], seq[one]))
        self.start = np.zeros(n_symbols, np.int64)
        self.start = self.rank(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return counts[w] + np.bitwise_count(words[w] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``i`` (elementwise)."""
        i = i.copy()
        for bit, words, counts, zeros in self.levels:
            ones = self._ones(words, counts, i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions ``i`` and their ranks there."""
        i, symbol = i.copy(), np.zeros(len(i), np.int64)
        for bit, words, counts, zeros in self.levels:
            one = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(words, counts, i)
            i = np.where(one, zeros + ones, i - ones)
            symbol |= one.astype(np.int64) << bit
        return symbol, i - self.start[symbol]


class FMIndex:
    """Index of segments of word ids (1 and up), each followed by a separator.

    Separators are different for the suffix order, so a match never crosses one, and symbol 0 in the
    transform. A position is sampled when it is a multiple of ``sample`` or
    begins a segment, so a walk back never meets a separator.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        sep = text == 0
        n_sep = int(sep.sum())
        key = text.astype(np.int64) + n_sep - 1
        key[sep] = np.arange(n_sep)
        sa = suffix_order(key)
        bwt = text[sa - 1]
        bwt[sa == 0] = 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))[:n_symbols].astype(np.int64)
        self.ranks = WaveletMatrix(bwt, n_symbols)
        begins = np.zeros(len(text), bool)
        begins[0] = True
        begins[1:] = sep[:-1]
        marked = begins[sa] | (sa % sample == 0)
        self.marked, self.place = marked, np.cumsum(marked) - 1
        self.samples = sa[marked]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once: row ranges [lo, hi).
        ``patterns``: one per row, aligned to the right end."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - step]
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one, count the steps."""
        at, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.samples[self.place[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, rank = self.ranks.access(at)
                at = self.first[symbol] + rank
                steps += 1
        return out
