"""A full-text index of a shard of words: suffix order, wavelet-tree ranks and sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8             # one text position in so many keeps its place; the others are walked to


class Wavelet:
    """Rank and access over whole numbers below 2 ** bits, one bit vector a level.

    Level by level, from the highest bit, the sequence is split stably into
    zeros and ones; a rank on a level is a stored count and one popcount.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        n = len(symbols)
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]).astype(np.int32)
            self.levels.append((words, ones, n - int(bit.sum())))
            one = bit.astype(bool)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        words, ones, _ = self.levels[level]
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[block] + np.bitwise_count(words[block] & mask)

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the occurrences of ``symbol`` before ``at`` end in the last level's order."""
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones = self.ones_before(level, at)
            at = np.where(bit == 1, self.levels[level][2] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and the place's end as ``down`` gives it."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            words, _, zeros = self.levels[level]
            bit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self.ones_before(level, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            symbol = symbol * 2 + bit
        return symbol, at


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes in order; 0 ends a piece, and of two ends the earlier is the smaller.

    The first words of each suffix are packed into one number and sorted. Of
    groups that are still equal the ranks so many words on are looked up, twice
    as far each time. Nothing looks beyond the end of a piece, so the number of
    rounds is the logarithm of the longest piece.
    """
    n, width = len(text), 63 // bits
    key, alive = text.astype(np.int64), text != 0
    for j in range(1, min(width, n)):      # a short text ends before
        after = np.zeros(n, np.int64)
        after[: n - j] = text[j:]
        after[~alive] = 0
        key = (key << bits) | after
        alive &= after != 0
    order = np.argsort(key, kind="stable")
    sorted_key, ended = key[order], ~alive[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ended[1:]
    del key, sorted_key, alive, ended
    rows = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, rows, 0))
    step = width
    while True:
        # Rows of groups of more than one suffix.
        open_ = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(open_):
            return order
        place = order[open_]
        pair = (rank[place] << 32) | rank[place + step]
        by = np.argsort(pair, kind="stable")
        order[open_], pair = place[by], pair[by]
        split = np.ones(len(open_), bool)
        split[1:] = pair[1:] != pair[:-1]
        fresh[open_] = split
        rank[order[open_]] = np.maximum.accumulate(np.where(split, open_, 0))
        step *= 2


class FMIndex:
    """Counts and finds phrases in pieces of words. Pieces are numbers from 1 on, each with a 0 behind it."""

    def __init__(self, text: np.ndarray, alphabet: int):
        """``text`` must end in 0; its numbers are below ``alphabet``."""
        self.n, self.bits = len(text), max(1, int(alphabet - 1).bit_length())
        order = suffix_order(text, self.bits)
        self.tree = Wavelet(text[order - 1], self.bits)      # the word before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.start = self.tree.down(np.arange(alphabet), np.zeros(alphabet, np.int64))
        # A piece's first word is sampled, so that no walk crosses an end.
        sampled = np.zeros(self.n, bool)
        sampled[::SAMPLE] = True
        sampled[0] = True
        sampled[1:] |= text[:-1] == 0
        marked = sampled[order]
        self.places = order[marked].astype(np.int32)
        self.marks = Wavelet(marked.astype(np.int64), 1)
        self.marked = marked

    def backward(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the suffixes that begin with each phrase.

        A phrase is a row of numbers from 1 on, right-aligned in ``phrases``.
        Phrases whose range is empty are not followed further.
        """
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        open_ = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            open_ = open_[(sizes[open_] >= back) & (low[open_] < high[open_])]
            if not len(open_):
                break
            word = phrases[open_, phrases.shape[1] - back]
            base = self.first[word] - self.start[word]
            low[open_] = base + self.tree.down(word, low[open_])
            high[open_] = base + self.tree.down(word, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row of the suffix order."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            here = self.marked[at]
            out[open_[here]] = self.places[self.marks.ones_before(0, at[here])] + steps
            open_, at = open_[~here], at[~here]
            symbol, end = self.tree.access(at)
            at = self.first[symbol] + end - self.start[symbol]
            steps += 1
        return out
