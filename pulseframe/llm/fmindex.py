"""FM-index over word sequences: wavelet matrix, backward search, repeated windows.

The text of an index is a list of sequences with a separator (symbol 0) after each.  Its
suffixes are sorted by their first ``DEPTH`` words, by prefix doubling; counts of patterns
up to that length are exact.  Searches run for many patterns at once: a step extends all
of them by one word to the left.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletMatrix:
    """Rank of symbols in a sequence; one packed bit vector per bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
        self.base = np.zeros(symbols, np.int64)
        every = np.arange(symbols)
        self.base = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word, inside = position >> 6, (position & 63).astype(np.uint64)
            below = self.bits[k][word] & ((np.uint64(1) << inside) - np.uint64(1))
            ones = self.before[k][word] + np.bitwise_count(below)
            one = symbol >> (self.levels - 1 - k) & 1
            position = np.where(one == 1, self.zeros[k] + ones, position - ones)
        return position

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``position``."""
        return self._walk(symbol, position) - self.base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        self.size = len(text)
        order = _sorted_suffixes(text)
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of patterns after a word is put before each of them."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        start = self.first[symbol]
        return start + both[: len(low)], start + both[len(low) :]


def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
    n = len(text)
    rank, reach = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reach < DEPTH:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair)
        ordered = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        reach *= 2
    return order


def repeated_windows(sequences: list[np.ndarray], window: int) -> list[list[tuple[int, int]]]:
    """Per sequence the stretches of words whose windows occur twice or more in all sequences.

    Matching statistics against a threshold: a stretch is searched from its right end; if
    all of it occurs twice, so do its windows.  If the search fails at a word, no window
    that holds what was read so far occurs twice, and the next one starts after that word.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    if not len(sizes) or sizes.max() < window:
        return [[] for _ in sequences]
    values, codes = np.unique(np.concatenate(sequences), return_inverse=True)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    text[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))] = codes + 1
    index = FMIndex(text, len(values) + 1)
    found: list[list[tuple[int, int]]] = [[] for _ in sequences]
    most = DEPTH - window + 1
    item = np.flatnonzero(sizes >= window)
    at = np.zeros(len(item), np.int64)
    count = np.full(len(item), most)
    while len(item):
        count = np.minimum(count, sizes[item] - window + 1 - at)
        stop = _search(index, text, starts[item] + at, window - 1 + count) - starts[item]
        whole = stop < at
        for s, a, c in zip(item[whole].tolist(), at[whole].tolist(), count[whole].tolist()):
            spans, end = found[s], a + window - 1 + c
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((a, end))
        single = count == 1
        at = np.where(whole, at + count, np.where(single, stop + 1, at))
        count = np.where(whole, most, np.where(single, 1, np.maximum(count // 4, 1)))
        left = at + window <= sizes[item]
        item, at, count = item[left], at[left], count[left]
    return found


def _search(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Place of the word at which each pattern's count falls below two; before ``start`` if it does not."""
    place = start + length - 1
    active = np.arange(len(start))
    low, high = np.zeros(len(start), np.int64), np.full(len(start), index.size)
    while len(active):
        low, high = index.extend(text[place[active]], low, high)
        alive = high - low >= 2
        active, low, high = active[alive], low[alive], high[alive]
        place[active] -= 1
        more = place[active] >= start[active]
        active, low, high = active[more], low[more], high[more]
    return place
