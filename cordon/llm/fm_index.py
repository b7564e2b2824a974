"""A compressed FM-index over word ids: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

The suffixes are sorted by their first words only, as many as a search can ask for, which is enough:
a pattern no longer than that has one interval. Searches run side by side, one lane a pattern.

Of a text of n words with s different ones, the matrix keeps log2(s) bit vectors (1.5 bits a bit, with counts),
the intervals one bit vector, and the weights one or two bytes a word as a rule; nothing else stays.
"""

from __future__ import annotations

import numpy as np

_ALL = ~np.uint64(0)


class BitVector:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, one: np.ndarray):
        n = len(one)
        packed = np.zeros((n >> 6) + 1 << 3, np.uint8)
        packed[: n + 7 >> 3] = np.packbits(one, bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def last(self, at: np.ndarray) -> np.ndarray:
        """The place of the last one at or before each place; there must be one."""
        word = at >> 6
        x = self.words[word] & (_ALL >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        while len(none := np.flatnonzero(x == 0)):
            word[none] -= 1
            x[none] = self.words[word[none]]
        high = x >> np.uint64(32)
        top = np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] - 1)
        return (word << 6) + top

    def next(self, at: np.ndarray) -> np.ndarray:
        """The place of the first one at or after each place; there must be one."""
        word = at >> 6
        x = self.words[word] & (_ALL << (at & 63).astype(np.uint64))
        while len(none := np.flatnonzero(x == 0)):
            word[none] += 1
            x[none] = self.words[word[none]]
        return (word << 6) + np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1


class Sums:
    """Sums of the values before each place: a total for each 64 values, and what is added within these."""

    def __init__(self, values: np.ndarray):
        padded = np.zeros((len(values) >> 6) + 1 << 6, np.int64)
        padded[: len(values)] = values
        inside = np.cumsum(padded.reshape(-1, 64), 1)
        self.blocks = np.concatenate([[0], np.cumsum(inside[:, -1])])
        before = np.zeros_like(inside)
        before[:, 1:] = inside[:, :-1]
        self.inside = before.ravel().astype(np.min_scalar_type(int(before.max())))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.blocks[at >> 6] + self.inside[at]


class WaveletMatrix:
    """Rank of symbols in an array: a bit vector a level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, (symbols - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            one = (values >> level) & 1 == 1
            self.bits.append(BitVector(one))
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])
        symbol = np.arange(symbols, dtype=np.int64)
        self.start = self._descend(symbol, np.zeros(symbols, np.int64)).astype(np.uint32)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, at) - self.start[symbol]


class FmIndex:
    """Of texts of word ids from 1 on, each with a weight; `depth` is the length of the windows asked for."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, depth: int):
        self.depth = depth
        lens = np.array([len(t) for t in texts], np.int64)
        text = np.zeros(int(lens.sum()) + len(texts), np.int64)  # a 0 ends each text
        begin = np.cumsum(lens + 1) - lens - 1
        text[np.repeat(begin - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))] = np.concatenate(texts) if texts else []
        n, symbols = len(text), int(text.max(initial=0)) + 1
        rank, h = text, 1
        part, gap = text, 0  # ranks by the first `depth - 1` words, from two that overlap
        while True:
            if h <= depth - 1:
                part, gap = rank, depth - 1 - h
            after = np.zeros(n, np.int64)
            after[: max(0, n - h)] = rank[h:]
            key = rank * np.int64(n + symbols) + after
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            ordered = key[order]
            new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            rank, h = new, 2 * h
            if h >= depth:
                break
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.uint32)
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        second = np.zeros(n, np.int64)
        second[: n - gap if gap else n] = part[gap:]
        a, b = part[order], second[order]
        new_group = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.groups = BitVector(np.append(new_group, True))  # where the first `depth - 1` words change
        owner = np.repeat(np.arange(len(texts)), lens + 1)
        whole = np.arange(n) + depth <= np.repeat(begin + lens, lens + 1)  # a window starts here
        self.weight = Sums((weights[owner] * whole)[order])
        self.n = n

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.counts[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def matches(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text, the weight of each of its windows of `depth` words in the index: its matching statistics,
        cut at `depth`, and how often a match that long occurs. Words are ids of the index or larger (unknown)."""
        lens = np.array([len(t) for t in texts], np.int64)
        out = [np.zeros(max(0, int(m) - self.depth + 1), np.int64) for m in lens]
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] >= self.depth]
        if not len(order):
            return out
        ends = np.cumsum(lens[order])
        flat = np.concatenate([texts[i] for i in order])
        windows = lens[order] - self.depth + 1
        found, base = np.zeros(int(windows.sum()), np.int64), np.cumsum(windows) - windows
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        dead, known = np.zeros(len(order), bool), len(self.counts) - 1
        for t in range(int(lens[order[0]])):
            k = int(np.searchsorted(-lens[order], -t, "left"))  # lanes with a word left
            c = flat[ends[:k] - 1 - t]
            dead[:k] |= c >= known
            lo, hi = self.step(np.where(dead[:k], 0, c), lo[:k], hi[:k])
            dead[:k] |= hi <= lo
            if t >= self.depth - 1:
                found[base[:k] + lens[order[:k]] - 1 - t] = self.weight[hi] - self.weight[lo]
                at = np.minimum(lo, self.n - 1)  # drop the last word: the interval of the first depth - 1 words
                lo, hi = self.groups.last(at), self.groups.next(at + 1)
        for lane in np.flatnonzero(dead).tolist():  # part of the text is not in the index: each window by itself
            text, b = texts[order[lane]], base[lane]
            single = len(text) == self.depth
            found[b : b + windows[lane]] = 0 if single else np.concatenate(self.matches([text[i : i + self.depth] for i in range(windows[lane])]))
        for i, b, w in zip(order.tolist(), base.tolist(), windows.tolist()):
            out[i] = found[b : b + w]
        return out
