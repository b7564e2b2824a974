"""Substring dedup: words covered by a window of words that occurs elsewhere are removed.

Windows are dealt to shards by content: each window of `window` words has an anchor, its 12-gram with
the least hash (the first of equal ones), and neighbouring windows with one anchor form a segment. Equal windows
have equal anchors, so an anchor that occurs once rules its segment out; a Bloom filter of the
anchors that occur twice leaves the segments to look at. Equal segments are counted and kept once; all
segments of an anchor go to one shard, where a compressed FM-index holds them and backward search
streams them past it, giving for each window how often it occurs. An anchor with more than
`split_above` different segments (a line common to many documents) is dealt out window by window
instead. What is found goes back to the segments' places, and the documents lose these words.

Windows are judged on the input. Words are runs of anything but space and 0x09-0x0D, unchanged.
A null text has no words; texts shorter than a window lose nothing. Rows with equal doc_id and equal words
are repeated rows: each is elsewhere for the other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, holds
from .fm_index import FmIndex
from .store import written
from .textops import Words, grams, mix, pieces, powers, sliding_min

GRAM = 12
_OTHER = 0xA0761D6478BD642F | 1
_SHORT = np.uint64((1 << 24) - 1)


def _sums(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return total, down


def _range_hash(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    total, down = sums
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64), seed)


class Segments:
    """The segments of a slice of documents: first word, end word, anchor's hash, document; and keys of word ranges."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, window: int):
        self.words = words = Words(data, ends)
        self.hashes = h = words.hashes()
        self.window, n = window, len(h)
        gram = min(GRAM, window)
        g = grams(h, gram)
        wide = window - gram + 1
        place = np.arange(len(g), dtype=np.uint64)
        least = sliding_min((g & ~_SHORT) | (place & _SHORT), wide)
        i = np.arange(len(least), dtype=np.int64)
        ok = words.doc[: len(least)] == words.doc[window - 1 : window - 1 + len(least)] if n >= window else np.zeros(0, bool)
        at = i + ((least & _SHORT).astype(np.int64) - i) % (1 << 24)
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
        self.first = np.flatnonzero(new)
        self.end = np.flatnonzero(last) + window
        self.anchor = g[at[self.first]]
        self.doc = words.doc[self.first] if n else self.first
        self._keys = None

    def keys(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of the words from a to b."""
        if self._keys is None:
            self._keys = _sums(self.hashes, 0xE7037ED1A0B428DB | 1), _sums(mix(self.hashes, 5), _OTHER)
        return _range_hash(self._keys[0], a, b, 3).view(np.int64), _range_hash(self._keys[1], a, b, 4).view(np.int64)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ends in pieces(batch, "_text"):
                h, n = np.unique(Segments(data, ends, window).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return run


def _segments(window: int, bits):
    """Distinct segments of each slice with an anchor that may recur: k1, k2, h, n, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ends in pieces(batch, "_text"):
                s = Segments(data, ends, window)
                go = np.flatnonzero(holds(bits.value, s.anchor))
                k1, k2 = s.keys(s.first[go], s.end[go])
                k1, at, n = np.unique(k1, return_index=True, return_counts=True)
                go = go[at]
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(s.words.start[s.first[go]].tolist(), s.words.end[s.end[go] - 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2[at]), pa.array(s.anchor[go].view(np.int64)), pa.array(n, pa.int64()), pa.array(texts, pa.binary())], ["k1", "k2", "h", "n", "text"])

    return run


def _doc_keys(s: Segments) -> np.ndarray:
    first = s.words.first
    return s.keys(first[:-1], first[1:])[0]


def _places(window: int, bits):
    """Where these segments stand: k1, k2, document, its key, first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in pieces(batch, "_text"):
                s = Segments(data, ends, window)
                go = np.flatnonzero(holds(bits.value, s.anchor))
                k1, k2 = s.keys(s.first[go], s.end[go])
                doc = s.doc[go]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), part.column("_key").take(pa.array(doc)), pa.array(_doc_keys(s)[doc]), pa.array((s.first[go] - s.words.first[doc]).astype(np.int32))], ["k1", "k2", "_key", "x", "first"])

    return run


def _docs(window: int, bits, digests: bool):
    """Documents: those without such segments are final, the others keep their text for the removal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in pieces(batch, "_text"):
                s = Segments(data, ends, window)
                touched = np.zeros(part.num_rows, bool)
                touched[s.doc[holds(bits.value, s.anchor)]] = True
                raw, kept, texts = data.tobytes(), [], []
                for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), touched.tolist()):
                    kept.append(None if t else _out(b" ".join(raw[a:b].split()), digests))
                    texts.append(raw[a:b] if t else None)
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(_doc_keys(s)), pa.array(np.diff(s.words.first), pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary())], ["_key", "x", "n_words", "kept", "text"])

    return run


def _out(text: bytes, digests: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digests else text.decode("utf-8", "replace")


def _windows(window: int):
    """The windows of segments as rows of their own: k1, k2, at, w1, w2, n, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, n, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "n", "text"))):
                words = text.split()
                for i in range(len(words) - window + 1):
                    t = b" ".join(words[i : i + window])
                    d = hashlib.blake2b(t, digest_size=16).digest()
                    rows.append((k1, k2, i, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), n, t))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "at", "w1", "w2", "n", "text"])

    return run


def _search(window: int, shard_words: int):
    """Shards of whole anchors, sorted: each is indexed, then its segments are streamed past the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "route", "n", "text"))):
                if row[2] != last and size >= shard_words:
                    yield shard(rows)
                    rows, size = [], 0
                last = row[2]
                words = row[4].split()
                rows.append((*row[:2], row[3], words))
                size += len(words)
        if rows:
            yield shard(rows)

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        texts = [np.array([ids.setdefault(w, len(ids) + 1) for w in r[3]], np.int64) for r in rows]
        found = FmIndex(texts, np.array([r[2] for r in rows], np.int64), window).matches(texts)
        out = []
        for r, f in zip(rows, found):
            hit = np.flatnonzero(f >= 2)
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > window)  # intervals of words, joined where they meet
                out.append((r[0], r[1], hit[np.concatenate([[0], cut + 1])].tolist(), (hit[np.concatenate([cut, [len(hit) - 1]])] + window).tolist()))
        cols = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["k1", "k2", "starts", "ends"])

    return run


def _removed(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for k, text, n, spans in zip(*(batch.column(c).to_pylist() for c in ("kept", "text", "n_words", "spans"))):
                if text is None:
                    gone.append(0)
                    kept.append(k)
                    continue
                mask = np.zeros(n + 1, np.int64)
                for x in spans or ():
                    mask[x["a"]] += 1
                    mask[x["b"]] -= 1
                keep = np.cumsum(mask[:-1]) == 0
                words = text.split()
                gone.append(n - int(keep.sum()))
                kept.append(_out(b" ".join([w for w, k in zip(words, keep.tolist()) if k]), digests))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("n_words"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_key", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", digests: bool = False, shard_words: int = 400_000, split_above: int = 4096) -> DataFrame:
    """One row per document: _key, n_words, n_removed, kept (the words left, joined by one space; with digests, their SHA-256)."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    anchors = rows.select("_text").mapInArrow(_anchors(window), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    bits = bloom(anchors.where("n > 1"), "h")
    found = rows.select("_text").mapInArrow(_segments(window, bits), "k1 long, k2 long, h long, n long, text binary")
    distinct = written(found.groupBy("k1", "k2").agg(F.first("h").alias("h"), F.sum("n").alias("n"), F.first("text").alias("text")), "segments")
    form = "k1 long, k2 long, starts array<int>, ends array<int>"

    def searched(rows: DataFrame, route: str) -> DataFrame:
        dealt = rows.select("k1", "k2", F.col(route).alias("route"), "n", "text").repartition("route").sortWithinPartitions("route")
        return dealt.mapInArrow(_search(window, shard_words), form)

    many = distinct.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > split_above).select("h")
    if many.isEmpty():
        verdicts = searched(distinct, "h")
    else:
        many = written(many, "common-anchors")
        split = written(distinct.join(many, "h", "left_semi").select("k1", "k2", "n", "text").mapInArrow(_windows(window), "k1 long, k2 long, at int, w1 long, w2 long, n long, text binary"), "windows")
        one = split.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.first("text").alias("text")).select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), "n", "text")
        hit = searched(one, "k1").select(F.col("k1").alias("w1"), F.col("k2").alias("w2"))
        spans = split.select("k1", "k2", "at", "w1", "w2").join(hit, ["w1", "w2"]).groupBy("k1", "k2").agg(F.collect_list("at").alias("starts"))
        verdicts = searched(distinct.join(many, "h", "left_anti"), "h").unionByName(spans.withColumn("ends", F.transform("starts", lambda x: x + window)))
    verdicts = written(verdicts, "verdicts")
    places = rows.mapInArrow(_places(window, bits), f"k1 long, k2 long, _key {kind}, x long, first int")
    # Both sides are plain shuffles, so Spark splits a segment that very many documents have.
    met = places.join(verdicts, ["k1", "k2"])
    spans = met.select("_key", "x", F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct((s["starts"] + F.col("first")).alias("a"), (s["ends"] + F.col("first")).alias("b"))).alias("s"))
    spans = spans.groupBy(F.col("_key").alias("_k"), F.col("x").alias("_x")).agg(F.flatten(F.collect_set("s")).alias("spans"))
    whole = rows.mapInArrow(_docs(window, bits, digests), f"_key {kind}, x long, n_words long, kept string, text binary")
    joined = whole.join(spans, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("x") == F.col("_x")), "left").select("_key", "n_words", "kept", "text", "spans")
    return joined.mapInArrow(_removed(digests), f"_key {kind}, n_words long, n_removed long, kept string")
