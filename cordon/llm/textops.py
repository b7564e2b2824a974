"""Words and n-grams of whole Arrow batches as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D; in UTF-8 this equals runs of such
characters. Hashes are 64-bit polynomials over bytes or over words, taken from prefix sums
modulo 2**64 and then mixed, so a batch costs a few passes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE, _WORD = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _tables[base] = tuple(out)
        if size > 1 << 22:  # one very long text should not keep its tables
            del _tables[base]
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `most` bytes of text each (a longer text alone): the rows, all bytes, the rows' offsets."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(text):
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


class Words:
    """The words of a slice: byte ranges (start, end), document of each (doc), index of each document's first (first)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool = False):
        self.data, self.ends = (LOWER[data] if lower else data), ends
        n = len(data)
        inside = ~SPACES[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        cut = ends[:-1][ends[:-1] < n]
        before[cut] = False
        last = ends[1:] - 1
        after[last[(last >= 0) & (ends[1:] > ends[:-1])]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, ends)
        self.doc = np.repeat(np.arange(len(ends) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        up, down = powers(_BYTE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each position; positions that leave the array are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1], seed)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    gap = width - have
    return np.minimum(x[: len(x) - gap], x[gap:]) if gap else x


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + len] of the codes, one after the other."""
    n = lens[codes]
    return flat[np.repeat(starts[codes] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of an array of lists of strings: the distinct strings, the code of each string, where each list begins and ends."""
    flat = lists.flatten()
    d = flat.dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends


def runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids given as little-endian 32-bit integers: all of them, where each part begins, and their numbers."""
    lens = np.array([len(p) >> 2 for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(lens) - lens, lens


class Memo:
    """What was computed for strings, in two generations of `half` entries each: what is used again stays."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def values(self, keys: list[str], learn) -> list[bytes]:
        """The values of distinct keys; learn gives those of keys not known, in order."""
        if len(self.young) + len(keys) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        new = []
        for i, v in enumerate(out):
            if v is None:
                v = old.get(keys[i])
                if v is None:
                    new.append(i)
                else:
                    young[keys[i]] = out[i] = v
        if new:
            for i, v in zip(new, learn([keys[i] for i in new])):
                young[keys[i]] = out[i] = v
        return out
