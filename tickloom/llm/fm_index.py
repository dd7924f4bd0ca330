"""A compressed full-text index over word sequences, and matching statistics of streamed texts.

The index of a shard keeps the Burrows-Wheeler transform of all its sequences in a wavelet matrix:
one bit vector for each bit of a word number, with counts every 64 bits. A pattern is searched from
its last word to its first; two ranks narrow the interval of suffixes that begin with what has
been read.

Suffixes are sorted by their first 64 words. For patterns of up to 64 words the intervals are the same as
with a full sort, since their borders only depend on the words of the pattern.
"""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by so many words; patterns may not be longer.
DEPTH = 64


class _WaveletMatrix:
    """How often a symbol occurs before a place, in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        start = np.zeros(alphabet, np.int64)
        every = np.arange(alphabet)
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros((len(packed) // 8 + 1) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(len(symbols) - int(bit.sum()))
            start = self._down(len(self.words) - 1, start, ((every >> level) & 1).astype(bool))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = start

    def _down(self, level: int, place: np.ndarray, one: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & below)
        return np.where(one, self.zeros[level] + ones, place - ones)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = self.start[symbol]
        for level in range(self.bits):
            place = self._down(level, place, ((symbol >> (self.bits - 1 - level)) & 1).astype(bool))
        return place - start


class FMIndex:
    """Index over sequences of 64-bit word hashes, each with an owner number."""

    def __init__(self, words: np.ndarray, edges: np.ndarray, owner: np.ndarray, window: int) -> None:
        if not 1 < window < DEPTH:
            raise ValueError(f"a window has 2 to {DEPTH - 1} words")
        self.window = window
        self.alphabet, number = np.unique(words, return_inverse=True)
        size = np.diff(edges)
        n = len(words) + len(size)
        text = np.zeros(n, np.int64)  # 0 closes a sequence
        place = np.arange(len(words)) + np.repeat(np.arange(len(size)), size)
        text[place] = number + 1
        whose = np.repeat(np.arange(len(size)), size + 1)

        ranks = [text]
        span = 1
        while span < DEPTH:
            rank = ranks[-1]
            ahead = np.zeros(n, np.int64)
            if span < n:
                ahead[:-span] = rank[span:]
            _, rank = np.unique((rank << 32) | ahead, return_inverse=True)
            ranks.append(rank)
            span *= 2
        order = np.argsort(ranks[-1], kind="stable")
        bwt = text[order - 1]
        self.symbols = len(self.alphabet) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.matrix = _WaveletMatrix(bwt, self.symbols)
        self.size = n

        def classes(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Suffixes that agree in ``depth`` words: number of the class, its first and last place."""
            half = ranks[depth.bit_length() - 1]
            shift = depth - (1 << (depth.bit_length() - 1))
            back = np.zeros(n, np.int64)
            back[: max(0, n - shift)] = half[shift:]
            x, y = half[order], back[order]
            fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            first = np.flatnonzero(fresh)
            return np.cumsum(fresh) - 1, first, np.append(first[1:], n)

        self.class_of, first, _ = classes(window)
        self.least_owner = np.minimum.reduceat(owner[whose][order], first)
        self.short_of, self.short_first, self.short_last = classes(window - 1)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the index does not have it."""
        if not len(self.alphabet):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def windows(self, words: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each place of the streamed sequences, the class of the window that starts there, or -1.

        All sequences are read at the same time, from right to left. The statistic of a place is
        the length of the longest match that starts there, up to the window. When a word cannot be put in
        front of a match of length k, no window over these k + 1 words occurs, so the search goes
        on with the window that ends one word earlier than the match.
        """
        number = self.numbers(words)
        out = np.full(len(words), -1)
        at = edges[1:] - 1
        begin = edges[:-1]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size)
        length = np.zeros(len(at), np.int64)
        lane = np.flatnonzero(edges[1:] - begin >= self.window)
        while len(lane):
            here = at[lane]
            symbol = number[here]
            known = np.maximum(symbol, 0)
            both = self.matrix.rank(np.tile(known, 2), np.concatenate([low[lane], high[lane]]))
            both += np.tile(self.before[known], 2)
            l, h = both[: len(lane)], both[len(lane) :]
            good = (symbol > 0) & (l < h)
            size = np.where(good, length[lane] + 1, 0)
            full = size == self.window
            out[here[full]] = self.class_of[l[full]]
            # the last word of a whole window is given up before the next word is read
            short = self.short_of[np.where(full, l, 0)]
            low[lane] = np.where(full, self.short_first[short], np.where(good, l, 0))
            high[lane] = np.where(full, self.short_last[short], np.where(good, h, self.size))
            size[full] -= 1
            # a failed lane starts again so that its match ends before the last word of the old one
            at[lane] = np.where(good, here - 1, here + np.maximum(length[lane] - 1, -1))
            length[lane] = size
            left = at[lane] - begin[lane] + 1 + length[lane]
            lane = lane[(at[lane] >= begin[lane]) & (left >= self.window)]
        return out
