"""Token ids in a content-addressed store.

A rolling hash over the ids of a document cuts them into chunks wherever the last 16 ids call for it
(so equal passages give equal chunks wherever they stand), between 64 and 2,048 ids each. A chunk is
stored once, under the BLAKE2b-128 digest of its ids as little-endian 32-bit integers. The store is
three Parquet tables in one folder:

- chunks: digest, n, width (bytes an id), payload; rows without a digest are recipes that had no place yet
- recipes: shard, doc_id, start, n_tokens, digests, root - in ascending doc_id order (nulls first), a shard for
  each run of documents; root is the hash over the document's digests
- manifest: level, node, first_start, n_docs, n_tokens, root - the Merkle tree over the recipes: a shard's root is
  the hash over its documents' ids, starts, sizes and roots, a node's the hash over all that up to 1,024 children
  say; the last level has one node, the store's root

read_back() and read_ids() read chunks, check each against its digest, each recipe against its root, and the
recipes against the manifest up to the store's root, which `expected_root` can fix; anything that differs raises.
read_back() combines the chunks' checksums, read_ids() puts the ids themselves together. Encoding remembers words, most of which recur.

Nulls: a null text counts as empty, and an empty text is its end id alone; null doc_ids are kept.
Repeated rows are separate documents. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import BLANK, byte_chars
from .store import new_path, scratch, shuffles_removed, written
from .textops import Memo, coded, gathered, grams, mix, pieces, runs

#: The tokenizer's normaliser and pattern of words, which PieceEncoder relies on.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LETTER, DIGIT, MARK, SPACE, OTHER = range(5)  # OTHER: normalisation may do more than lower-case it, or the library has a rule for it
WINDOW, LEAST, MOST, MASK = 16, 64, 2048, np.uint64(255)
FAN = 1024  # children of a node of the manifest


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane its kind, and its lower case."""
    kind, lower = np.full(1 << 16, OTHER, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    blank = re.compile(f"[{BLANK}]")
    for i in range(1 << 16):
        c, cat = chr(i), unicodedata.category(chr(i))
        # Marks and Hangul vowels and finals can join what stands before them; unassigned characters differ between Unicode versions.
        if cat[0] == "M" or cat in ("Cn", "Cs") or 0x1100 <= i < 0x1200 or c in "<'\u03a3" or len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c:
            continue
        kind[i] = SPACE if blank.match(c) else LETTER if cat[0] == "L" else DIGIT if cat[0] == "N" else MARK
        lower[i] = ord(c.lower())
    return kind, lower


class PieceEncoder:
    """Ids of texts by the tokenizers library, whose model sees each distinct word once.

    Holds for tokenizers with this normaliser and pattern, which never merge across white space; other
    definitions raise. Pieces between blanks are cut into words in bulk; those with a character that needs
    more than that go to the library as they are. `most` bounds what is remembered.
    """

    def __init__(self, definition: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        d = json.loads(definition)
        split, level = d["pre_tokenizer"]["pretokenizers"] if (d.get("pre_tokenizer") or {}).get("type") == "Sequence" else ({}, {})
        model = d["model"]
        same = (d.get("normalizer") or {}).get("normalizers") == NORMALISER and split.get("pattern") == {"Regex": PATTERN} and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        same &= level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
        if not same or model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or not all(t["content"].startswith("<") for t in d["added_tokens"]):
            raise ValueError("this tokenizer is of another kind than the encoder is made for")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chars = byte_chars()
        self.words, self.others = Memo(most), Memo(most // 5)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words, from the library's model itself; white space has none."""
        model, chars, kind = self.tokenizer.model.tokenize, self.chars, characters()[0]
        out = []
        for w in words:
            if not (w.isascii() and w.isprintable()):
                w = "" if kind[ord(w[0])] == SPACE else "".join([chars[b] for b in w.encode()])
            out.append(array("I", [t.id for t in model(w)]).tobytes() if w else b"")
        return out

    def _cut(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All words of the pieces, lower-cased; where each piece's words end; and which pieces have other characters (theirs don't count)."""
        raw = pieces.cast(pa.large_string())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = memoryview(raw.buffers()[2] or b"")[ends[0] : ends[-1]] if len(raw) else b""
        ends = ends - ends[0]
        first = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # bytes that begin a character
        at = np.searchsorted(first, ends)
        point = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        kind, lower = characters()
        basic = np.minimum(point, 0xFFFF)  # which is no character
        k, point = kind[basic], np.where(point < 1 << 16, lower[basic], point)
        odd = np.concatenate([[0], np.cumsum(k == OTHER)])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (k[1:] == DIGIT)
        new[at[:-1][at[:-1] < len(k)]] = True
        begin = np.flatnonzero(new)
        wide = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        byte = np.concatenate([[0], np.cumsum(wide)])
        text = point.astype("<u4").tobytes().decode("utf-32-le").encode()
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(byte[begin], len(text)).astype(np.int64)), pa.py_buffer(text))
        return words, np.searchsorted(begin, at), odd[at[1:]] > odd[at[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin and end. Distinct pieces are cut once each, distinct words looked up once each."""
        pieces, codes, ends = coded(pc.ascii_split_whitespace(texts))
        words, at, other = self._cut(pieces)
        if other.any():
            words, at, _ = self._cut(pieces.filter(pa.array(~other)))
        found = words.dictionary_encode()
        flat, starts, lens = runs(self.words.values(found.dictionary.to_pylist(), self._words))
        of_word = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, upto = gathered(flat, starts, lens, of_word), np.concatenate([[0], np.cumsum(lens[of_word])])[at]
        starts, lens = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[~other], lens[~other] = upto[:-1], np.diff(upto)
        if other.any():
            more, begin, n = runs(self.others.values(pieces.filter(pa.array(other)).to_pylist(), self._whole))
            starts[other], lens[other] = begin + len(flat), n
            flat = np.concatenate([flat, more])
        return gathered(flat, starts, lens, codes), np.concatenate([[0], np.cumsum(lens[codes])])[ends]


@lru_cache(maxsize=1)
def encoder(definition: str) -> PieceEncoder:
    """The worker's encoder: it outlives a task, and so does what it remembers."""
    return PieceEncoder(definition)


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, counted over all ids (ends: where the documents begin and end)."""
    calls = np.flatnonzero((grams(mix(ids.astype(np.uint64)), WINDOW) & MASK) == 0) + WINDOW
    at = np.searchsorted(calls, ends)
    out, calls = [], calls.tolist()
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        one, last = [], a
        for c in [*(c for c in calls[at[k] : at[k + 1]] if c >= a + WINDOW), b]:
            while c - last > MOST:
                last += MOST
                one.append(last)
            if c > last and (c - last >= LEAST or c == b):
                one.append(c)
                last = c
        out.append(one)
    return out


def digest_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


_STAGE = "deal int, lead long, digest binary, n int, width int, payload binary, doc_id {key}, tag long, n_tokens long, digests array<binary>, root string"


def _encoder(definition: str, end_id: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(definition)
        tag = TaskContext.get().partitionId() << 40
        sent: set[bytes] = set()
        for batch in batches:
            for part, _, _ in pieces(batch, "_text", 6 << 20):
                ids, ends = coder.encode(pc.fill_null(part.column("_text"), ""))
                ids = np.insert(ids, ends[1:], end_id)  # the end id after each document
                ends = ends + np.arange(len(ends))
                raw, big, chunks, docs, last = ids.astype("<u4").tobytes(), ids >= 1 << 16, [], [], 0
                for cut, a, b in zip(cuts(ids, ends), ends[:-1].tolist(), ends[1:].tolist()):
                    digests = []
                    for c in cut:
                        d = digest_of(raw[4 * last : 4 * c])
                        digests.append(d)
                        if d not in sent:
                            if len(sent) >= 200_000:
                                sent.clear()
                            sent.add(d)
                            width = 4 if big[last:c].any() else 2
                            chunks.append((d, c - last, width, ids[last:c].astype(f"<u{width}").tobytes()))
                        last = c
                    docs.append((tag, b - a, digests, digest_of(b"".join(digests)).hex()))
                    tag += 1
                m, k = len(chunks), len(docs)
                cd, cn, cw, cp = zip(*chunks) if chunks else ((), (), (), ())
                dt, dn, dd, dr = zip(*docs) if docs else ((), (), (), ())
                lead = np.concatenate([np.frombuffer(b"".join(cd), "<i8")[::2], np.array(dt, np.int64)])
                deal = (mix(lead.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                key = part.column("_key")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(deal), pa.array(lead), pa.array([*cd, *[None] * k], pa.binary()), pa.array([*cn, *[None] * k], pa.int32()),
                        pa.array([*cw, *[None] * k], pa.int32()), pa.array([*cp, *[None] * k], pa.binary()), pa.concat_arrays([pa.nulls(m, key.type), key]), pa.array([*[None] * m, *dt], pa.int64()),
                        pa.array([*[None] * m, *dn], pa.int64()), pa.array([*[None] * m, *dd], pa.list_(pa.binary())), pa.array([*[None] * m, *dr], pa.string()),
                    ],
                    names=["deal", "lead", "digest", "n", "width", "payload", "doc_id", "tag", "n_tokens", "digests", "root"],
                )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, each chunk's first; rows without a digest stay."""
    last = pa.array([None], pa.binary())
    for batch in batches:
        digest = batch.column("digest")
        if len(digest):
            before = pa.concat_arrays([last, digest[:-1]])
            last = digest[-1:]
            yield batch.filter(pc.fill_null(pc.not_equal(digest, before), True))


def write_store(docs: DataFrame, definition: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text", shard_docs: int = 50_000) -> str:
    """Encodes docs with the tokenizer of that definition (its JSON) and writes the store; returns its path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    form = _STAGE.format(key=rows.schema["_key"].dataType.simpleString())
    staged = rows.mapInArrow(_encoder(definition, end_id, 1 << 20), form).repartition(parts, "deal").sortWithinPartitions("lead", "digest")
    with shuffles_removed(spark):
        staged.mapInArrow(_once, form).drop("deal", "lead").write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(f"{path}/chunks")
    stage = spark.read.schema(form.replace("deal int, lead long, ", "")).parquet(f"{path}/chunks")
    recipes = stage.where("digest is null").select("doc_id", "tag", "n_tokens", "digests", "root")
    shards = max(1, -(-recipes.count() // shard_docs))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tag")]
    with scratch(spark), shuffles_removed(spark):
        dealt = written(recipes.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()), "recipes")
        sums = dealt.groupBy("shard").agg(F.sum("n_tokens").alias("s"))
        base = sums.select("shard", (F.sum("s").over(Window.orderBy("shard")) - F.col("s")).alias("_base"))  # a row for each shard
        inside = Window.partitionBy("shard").orderBy(*order)
        start = F.col("_base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
        final = dealt.join(base, "shard").withColumn("start", start).select("shard", "doc_id", "start", "n_tokens", "digests", "root")
        final.sortWithinPartitions("shard", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
        level = written(_shards(spark.read.schema(final.schema).parquet(f"{path}/recipes")), "manifest")
        levels, n = [level], level.count()
        while n > 1:
            level = written(_parents(level), "manifest")
            levels.append(level)
            n = -(-n // FAN)
        reduce(DataFrame.unionByName, levels).write.parquet(f"{path}/manifest")
    return path


def _over(leaves: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(leaves)), lambda x: x["h"]), ""), 256)


def _text(*parts: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts))


def _shards(recipes: DataFrame) -> DataFrame:
    """The tree's leaves."""
    leaf = F.struct("start", F.sha2(_text("doc_id", "start", "n_tokens", "root"), 256).alias("h"))
    out = recipes.groupBy(F.col("shard").cast("long").alias("node")).agg(F.min("start").alias("first_start"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _over(leaf).alias("root"))
    return out.select(F.lit(0).alias("level"), "*")


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes of one level."""
    child = F.struct("node", _text("node", "first_start", "n_docs", "n_tokens", "root").alias("h"))
    out = nodes.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("node") / FAN).alias("node"))
    return out.agg(F.min("first_start").alias("first_start"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _over(child).alias("root"))


def store_root(spark: SparkSession, path: str) -> str | None:
    """The root of the store's tree; None if the store is empty."""
    top = _read(spark, path)[2].orderBy(F.desc("level")).first()
    return top and top["root"]


def _verify(spark: SparkSession, path: str, expected_root: str | None) -> None:
    """Raises unless recipes and manifest agree, level by level up to one node."""
    _, recipes, manifest = _read(spark, path)
    made = _shards(recipes).unionByName(_parents(manifest).select(*manifest.columns))
    at, values = ["level", "node"], ["first_start", "n_docs", "n_tokens", "root"]
    both = made.select(*at, F.struct(*values).alias("is")).join(manifest.select(*at, F.struct(*values).alias("said")), at, "full")
    top = manifest.agg(F.max("level")).first()[0]
    if top is None:
        bad = recipes.count()
    else:  # the one node of the last level makes a parent that is not stored
        bad = both.where((F.col("level") <= top) & ~F.col("is").eqNullSafe(F.col("said"))).count() + (manifest.where(F.col("level") == top).count() != 1)
    if bad:
        raise ValueError(f"{bad} nodes of the manifest differ from what they stand for")
    if expected_root is not None and store_root(spark, path) != expected_root:
        raise ValueError("the store has another root")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = spark.read.schema("digest binary, n int, width int, payload binary").parquet(f"{path}/chunks").where("digest is not null")
    return chunks, spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, bits reflected."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint64)
    b = np.broadcast_to(b, out.shape).astype(np.uint64)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(i)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


class _Shift:
    """x**(8 * size) for many sizes, remembered."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def __call__(self, sizes: np.ndarray) -> np.ndarray:
        new = np.array(sorted(set(sizes.tolist()).difference(self.known)), np.uint64)
        if len(new):
            x, p, k = np.full(len(new), 1 << 31, np.uint64), np.uint64(1 << 23), new.copy()
            while k.any():
                x = np.where(k & np.uint64(1), _times(x, p), x)
                p = _times(p, p)[()]
                k >>= np.uint64(1)
            self.known.update(zip(new.tolist(), x.tolist()))
        return np.array([self.known[s] for s in sizes.tolist()], np.uint64)


def _whole(digest: bytes, width: int, payload: bytes) -> bytes:
    """A chunk's ids, if they are what its digest says."""
    ids = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
    if digest_of(ids) != digest:
        raise ValueError(f"chunk {digest.hex()} is damaged")
    return ids


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [_whole(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("digest", "width", "payload")))]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(x) >> 2 for x in ids], pa.int32()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["digest", "n", "crc"])


def _agrees(digests: bytes, n: int, root: str, n_tokens: int) -> None:
    if digest_of(digests).hex() != root or n != n_tokens:
        raise ValueError("a recipe differs from its root")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift = _Shift()
    for batch in batches:
        lists = batch.column("parts")
        flat = lists.flatten()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        digests, n, crc = b"".join(flat.field("digest").to_pylist()), flat.field("n").to_numpy(zero_copy_only=False), flat.field("crc").to_numpy(zero_copy_only=False).astype(np.uint64)
        totals = np.concatenate([[0], np.cumsum(n)])
        for a, b, x, y, root, want in zip((ends - sizes).tolist(), ends.tolist(), totals[ends - sizes].tolist(), totals[ends].tolist(), batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist()):
            _agrees(digests[16 * a : 16 * b], y - x, root, want)
        out, moved = np.zeros(len(sizes), np.uint64), shift(4 * n.astype(np.int64))
        for i in range(int(sizes.max(initial=0))):  # the i-th chunk of all documents that have one
            at = np.flatnonzero(sizes > i)
            k = (ends - sizes)[at] + i
            out[at] = _times(out[at], moved[k]) ^ crc[k]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for parts, root, want in zip(*(batch.column(c).to_pylist() for c in ("parts", "root", "n_tokens"))):
            raw = b"".join([_whole(x["digest"], x["width"] or 2, x["payload"] or b"") for x in parts])
            _agrees(b"".join([x["digest"] for x in parts]), len(raw) >> 2, root, want)
            ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])


def _parts(recipes: DataFrame, chunks: DataFrame, *fields: Column) -> DataFrame:
    """The recipes with their chunks in order; a large key is split by Spark, since the join is not followed by an operation on the same key."""
    used = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("_i", "digest"))
    first = [F.first(c).alias(c) for c in ("doc_id", "n_tokens", "root")]
    return used.join(chunks, "digest", "left").groupBy("start").agg(*first, F.array_sort(F.collect_list(F.struct("_i", "digest", *fields))).alias("parts")).select("doc_id", "start", "n_tokens", "root", "parts")


def read_back(spark: SparkSession, path: str, expected_root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, all from the files and verified."""
    _verify(spark, path, expected_root)
    chunks, recipes, _ = _read(spark, path)
    crcs = chunks.mapInArrow(_checked, "digest binary, n int, crc long")
    parts = _parts(recipes, crcs, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0).cast("long")).alias("crc"))
    return parts.mapInArrow(_joined, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, expected_root: str | None = None) -> DataFrame:
    """doc_id, start, ids: the documents' ids again, from chunks and recipes, verified."""
    _verify(spark, path, expected_root)
    chunks, recipes, _ = _read(spark, path)
    parts = _parts(recipes, chunks, F.col("width"), F.col("payload"))
    return parts.mapInArrow(_assembled, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, ids array<long>")
