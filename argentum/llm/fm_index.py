"""A compressed FM-index over arrays of symbols, in numpy.

The Burrows-Wheeler transform is kept as a wavelet matrix (one bit per level and symbol with
counts per 64-bit word) and suffix positions are sampled in text order. All queries are
answered for many patterns at a time.
"""

from __future__ import annotations

import numpy as np

#: Symbols below this are reserved: the end of the text, and separators.
END, SEPARATOR, FIRST = 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; the first key packs as many symbols as 62 bits hold.

    Only suffixes that still tie are sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max(initial=1)).bit_length())
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    ahead = np.concatenate([text.astype(np.int64), np.zeros(packed, np.int64)])
    for k in range(packed):
        key = key << bits | ahead[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
    group_start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group_start
    tied = ~(fresh & np.append(fresh[1:], True))
    at = np.flatnonzero(tied)
    h = packed
    while len(at):
        suffix = order[at]
        after = suffix + h
        key = rank[suffix] << 32 | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        new = np.argsort(key)
        key, suffix = key[new], suffix[new]
        order[at] = suffix
        fresh = np.append(True, key[1:] != key[:-1])
        rank[suffix] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        at = at[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order


class Bits:
    """A bit array with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words))).astype(np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits ahead of each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Index of one text of symbols >= SEPARATOR; the end symbol is added here."""

    def __init__(self, text: np.ndarray, rate: int = 16):
        text = np.append(text, END).astype(np.int64)
        n = self.n = len(text)
        order = suffix_array(text)
        self.n_symbols = int(text.max()) + 1
        self.levels = max(1, (self.n_symbols - 1).bit_length())
        column = text[order - 1]  # the symbol in front of each sorted suffix
        self.rows: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (column >> level & 1).astype(bool)
            self.rows.append(Bits(bit))
            column = np.concatenate([column[~bit], column[bit]])
            self.zeros.append(int(n - np.count_nonzero(bit)))
        # from the place in the last level to the row of the suffix that begins with the symbol
        symbols = np.arange(self.n_symbols)
        counts = np.bincount(text, minlength=self.n_symbols)
        self.shift = np.cumsum(counts) - counts - self._descend(np.zeros(self.n_symbols, np.int64), symbols)
        sampled = order % rate == 0
        self.rate, self.sampled, self.samples = rate, Bits(sampled), order[sampled]

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.rows[k].ones(at)
            at = np.where(symbols >> level & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def step_back(self, left: np.ndarray, right: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with a symbol followed by what the rows [left, right) begin with."""
        both = self._descend(np.concatenate([left, right]), np.concatenate([symbols, symbols])) + np.tile(self.shift[symbols], 2)
        return both[: len(left)], both[len(left) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [left, right) of each pattern (a row of `patterns`), from its last symbol to its first.

        Symbols that the text doesn't have give an empty range.
        """
        left, right = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.flatnonzero(((patterns > END) & (patterns < self.n_symbols)).all(axis=1))
        right[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            left[live], right[live] = self.step_back(left[live], right[live], patterns[live, k])
            live = live[left[live] < right[live]]
            if not len(live):
                break
        return left, np.maximum(right, left)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, wanted: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, left, right) of the longest text that ends ahead of each of `ends` and occurs `wanted` times or more.

        Lengths are counted up to `most`.
        """
        length = np.zeros(len(ends), np.int64)
        left, right = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for k in range(1, most + 1):
            live = live[ends[live] >= k]
            symbols = text[ends[live] - k]
            ok = (symbols >= FIRST) & (symbols < self.n_symbols)
            live, symbols = live[ok], symbols[ok]
            new_left, new_right = self.step_back(left[live], right[live], symbols)
            ok = new_right - new_left >= wanted
            live = live[ok]
            if not len(live):
                break
            left[live], right[live], length[live] = new_left[ok], new_right[ok], k
        return length, left, right

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of sorted suffixes, by walking back to the next sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, live = rows.copy(), np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.sampled.get(here)
            done = live[hit]
            out[done] = self.samples[self.sampled.ones(here[hit])] + steps[done]
            live, here = live[~hit], here[~hit]
            symbols, place = np.zeros(len(live), np.int64), here
            for k in range(self.levels):
                bit, ones = self.rows[k].get(place), self.rows[k].ones(place)
                place = np.where(bit, self.zeros[k] + ones, place - ones)
                symbols = symbols << 1 | bit
            at[live] = place + self.shift[symbols]
            steps[live] += 1
        return out
