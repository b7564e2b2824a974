"""Byte-level BPE by a segment tree over adjacent pair ranks.

A word's leaves hold the ranks of its adjacent pairs, its inner nodes the least of their two
children; the root gives the leftmost pair of lowest rank. A merge updates three leaves and their
paths to the root, until no pair at the root can be merged. Many words are merged at once, one tree
each, all of the same height; a few long words are merged one by one in the same way.

Distinct pieces (a blank and a run of other characters) of a batch are encoded once and remembered
within a bound. Strings of special tokens in a text become these tokens, as the library has it.

A null text counts as empty; empty and very long texts, repeated rows and empty tables are treated
alike; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import pieces

#: White space as the tokenizer has it, and its pattern of pre-tokens.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
PIECE = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
GAP = re.compile(rf"[{BLANK}] (?:[{BLANK}]|$)")
NONE = np.int64(1) << np.int64(62)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE tokenizer from its definition (the JSON of the tokenizers library)."""

    def __init__(self, definition: str, most: int = 500_000):
        d = json.loads(definition)
        vocab, chars = d["model"]["vocab"], byte_chars()
        back = {c: b for b, c in chars.items()}
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        keys = (left << np.int64(32)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.ranks = dict(zip(zip(left.tolist(), right.tolist()), range(len(merges))))
        self.pretoken = regex.compile(PRETOKEN)
        self.fixed = {"\0" + t: np.uint32(i).tobytes() for t, i in self.special.items()}  # names that no piece has
        self.most, self.words, self.known, self.spaced = most, {}, dict(self.fixed), {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << np.int64(32)) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.rank_of[at], NONE)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids, n = self.byte_id[list(word)].tolist(), len(word)
        if n < 2:
            return ids
        size, none = 1 << (n - 2).bit_length(), (1 << 62, 0)
        tree, ranks, made = [none] * (2 * size), self.ranks, self.made
        for i in range(n - 1):
            if (r := ranks.get((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = (r, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def put(i: int, x: tuple[int, int]) -> None:
            i += size
            tree[i] = x
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def pair(i: int) -> tuple[int, int]:
            r = ranks.get((ids[i], ids[after[i]])) if after[i] >= 0 else None
            return none if r is None else (r, i)

        while tree[1] is not none and tree[1][0] < 1 << 62:
            rank, i = tree[1]
            j = after[i]
            ids[i], ids[j], after[i] = int(made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if j < n - 1:
                put(j, none)
            if i < n - 1:
                put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words, merged side by side."""
        out: list[list[int]] = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(max(1, len(w) - 1).bit_length() if len(w) != 2 else 0, []).append(i)
        for height, at in by.items():
            if len(at) < 16 or height > 9:
                for i in at:
                    out[i] = self.merge(words[i])
                continue
            step = max(16, (1 << 16) >> height)
            for k in range(0, len(at), step):
                for i, ids in zip(at[k : k + step], self._lanes([words[i] for i in at[k : k + step]], height)):
                    out[i] = ids
        return out

    def _lanes(self, words: list[bytes], height: int) -> list[list[int]]:
        size = 1 << height
        n, width = len(words), size + 2
        flat = np.frombuffer(b"".join(words), np.uint8)
        lens = np.array([len(w) for w in words])
        ids = np.full((n, width), -1, np.int64)
        ids[np.repeat(np.arange(n), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = self.byte_id[flat]
        place = np.arange(size, dtype=np.int64)
        low = np.int64((1 << height) - 1)
        tree = np.full((n, 2 * size), NONE, np.int64)
        rank = self._rank(ids[:, :size].ravel(), ids[:, 1 : size + 1].ravel()).reshape(n, size)
        tree[:, size:] = np.where(rank < NONE, (rank << np.int64(height)) | place, NONE)
        for level in range(height - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        after = np.tile(np.arange(1, width + 1, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int64), (n, 1))
        lane = np.flatnonzero(tree[:, 1] < NONE)

        def put(lanes: np.ndarray, i: np.ndarray, x: np.ndarray) -> None:
            i = i + size
            tree[lanes, i] = x
            for _ in range(height):
                i >>= 1
                tree[lanes, i] = np.minimum(tree[lanes, 2 * i], tree[lanes, 2 * i + 1])

        while len(lane):
            root = tree[lane, 1]
            i = root & low
            j = after[lane, i]
            ids[lane, i], ids[lane, j] = self.made[root >> np.int64(height)], -1
            k = after[lane, j]
            after[lane, i] = k
            inside = k < width
            before[lane[inside], k[inside]] = i[inside]
            gone = j < size
            put(lane[gone], j[gone], np.full(int(gone.sum()), NONE))
            r = self._rank(ids[lane, i], np.where(inside, ids[lane, np.minimum(k, width - 1)], -1))
            put(lane, i, np.where(r < NONE, (r << np.int64(height)) | i, NONE))
            p = before[lane, i]
            has = np.flatnonzero(p >= 0)
            if len(has):
                q = p[has]
                r = self._rank(ids[lane[has], q], ids[lane[has], i[has]])
                put(lane[has], q, np.where(r < NONE, (r << np.int64(height)) | q, NONE))
            lane = lane[tree[lane, 1] < NONE]
        return [row[row >= 0].tolist() for row in ids]

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of pieces not known yet."""
        if len(self.words) > self.most // 2:
            self.words.clear()
        split = [self.pretoken.findall(p) for p in new]
        words = list(set().union(*split).difference(self.words))
        self.words.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(words, self.merge_many([w.encode() for w in words])))
        return [b"".join([self.words[w] for w in s]) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        parts: list[tuple[list[str], list[str]]] = []  # pieces as they stand, then pieces that a blank precedes
        for t in texts:
            if self.split and self.split.search(t):
                parts.append(([x for k, p in enumerate(self.split.split(t)) for x in (["\0" + p] if k % 2 else PIECE.findall(p))], []))
            elif GAP.search(t):  # a run of blanks would be torn
                parts.append((PIECE.findall(t), []))
            else:
                first, *rest = t.split(" ")
                parts.append(([first], rest))
        for known, k, before, fixed in ((self.known, 0, "", self.fixed), (self.spaced, 1, " ", {})):
            all_ = set().union(*(p[k] for p in parts))
            new = list(all_.difference(known))
            if len(known) + len(new) > self.most:
                known.clear()
                known.update(fixed)
                new = list(all_.difference(known))
            known.update(zip(new, self._learn([before + p for p in new])))
        a, b = self.known.__getitem__, self.spaced.__getitem__
        return [b"".join([*map(a, x), *map(b, y)]) for x, y in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, definition: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with ids (array<int>); or, with digests, n_tokens, ids_sha256 and decoded_sha256 in place of the text."""
    cols = [c for c in docs.columns if not (digests and c == text)]
    flat = docs.select(*(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(cols)), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(definition)
        for batch in batches:
            for part, _, _ in pieces(batch, "_text"):
                raw = bpe.encode([t or "" for t in part.column("_text").to_pylist()])
                if digests:
                    back = [hashlib.sha256(bpe.decode(np.frombuffer(r, "<u4").tolist()).encode()).hexdigest() for r in raw]
                    more = [pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array(back, pa.string())]
                else:
                    more = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) // 4 for r in raw)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], [*inner, *names])

    names, inner = (["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]), flat.columns[:-1]
    form = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]]
    out = flat.mapInArrow(run, ", ".join([*form, *(["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>"])]))
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(cols)), *names)
