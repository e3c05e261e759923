"""A compressed FM-index over sequences of 64-bit words, searched for many patterns at once with numpy.

What it keeps of a text is the wavelet matrix of its last column (a bit for each level of the alphabet, and a 32-bit
count for every 64 of them), one more such plane for the weights, the distinct words and their counts. Neither the
text nor the order of its suffixes stays.
"""

from __future__ import annotations

import numpy as np

#: For each place in a 64-bit word, the bits before it.
_BEFORE = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Plane:
    """A packed bit vector with the number of ones before every 64th bit."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.frombuffer(packed.tobytes().ljust((len(packed) // 8 + 1) * 8, b"\0"), np.uint64)
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each position (int32)."""
        word = at >> 6
        return self.ones.take(word) + np.bitwise_count(self.words.take(word) & _BEFORE.take(at & 63))


class WaveletMatrix:
    """Rank of any symbol up to any position; one plane per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.planes = []
        now, self.depth = symbols, max(1, (alphabet - 1).bit_length())
        for level in reversed(range(self.depth)):
            bit = (now >> level) & 1
            self.planes.append((level, Plane(bit), np.int32(len(bit) - bit.sum())))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.first = np.searchsorted(self._reversed_bits(now), self._reversed_bits(np.arange(alphabet))).astype(np.int32)

    def _reversed_bits(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols lie on the last level in the order of their bits read from the lowest."""
        out = np.zeros(len(symbols), np.int64)
        for i in range(self.depth):
            out |= ((symbols >> i) & 1).astype(np.int64) << (self.depth - 1 - i)
        return out

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position; `at` may hold several rows of positions."""
        for level, plane, zeros in self.planes:
            ones = plane.rank(at)
            at = np.where((symbols & (1 << level)).astype(bool), ones + zeros, at - ones)
        return at - self.first.take(symbols)


def order_of_suffixes(text: np.ndarray, upto: int) -> np.ndarray:
    """The suffixes of a text in the order of their first `upto` symbols at least, by prefix doubling.

    A sort takes as many ranks of neighbouring runs at once as fit into 63 bits: three where the text is short.
    """
    n = len(text)
    rank, step, bits = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1, int(n + 2).bit_length()
    while True:
        key = rank.copy()
        for i in range(1, 63 // bits):
            key <<= bits
            key[: max(0, n - i * step)] |= rank[i * step :]
        order, step = np.argsort(key), step * (63 // bits)
        if step >= upto:
            return order
        key = key[order]
        rank[order] = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))


class FMIndex:
    """Sequences sent once or more often, for patterns of fewer than DEPTH words: is a pattern found twice or more?"""

    DEPTH = 64

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray) -> None:
        flat = np.concatenate(sequences)
        self.words, coded = np.unique(flat, return_inverse=True)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.size = int(lengths.sum() + len(lengths))
        text, own = np.zeros(self.size, np.int64), np.ones(self.size, bool)  # symbol 0 ends each sequence
        own[np.cumsum(lengths + 1) - 1] = False
        text[own] = coded + 1
        order = order_of_suffixes(text, self.DEPTH)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.words) + 1)))).astype(np.int32)
        self.last = WaveletMatrix(text[order - 1], len(self.words) + 1)
        self.again = Plane(np.repeat(weights > 1, lengths + 1)[order])

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The symbols of words, all of which the index knows."""
        return np.searchsorted(self.words, words).astype(np.int32) + 1

    def longest(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Matching statistics of a streamed text (symbols): how many words back from each end (at most `most`) are found twice or more.

        Backward search: a step to the left maps the interval of suffixes through the rank of the next word. Suffixes
        of sequences that were sent again count twice.
        """
        found = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(most > 0)
        span = np.stack((np.zeros(len(live), np.int32), np.full(len(live), self.size, np.int32)))
        while len(live):
            c = text[ends[live] - found[live] - 1]
            span = self.below.take(c) + self.last.rank(c, span)
            again = self.again.rank(span)
            good = (span[1] - span[0]) + (again[1] - again[0]) >= 2
            live, span = live[good], span[:, good]
            found[live] += 1
            more = found[live] < most[live]
            live, span = live[more], span[:, more]
        return found
