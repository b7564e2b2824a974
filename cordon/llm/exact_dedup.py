"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes each normalised text (SHA-256) and sets two bits of one 4 KB block for it; a bit set
by two rows or more is noted in the filter. Pass two tests each row: if one of its bits was set
once only, its text is the only one of its kind and the row passes straight through. The others are
possibly repeated, and only they shuffle. The filter has 16 bits a row, at most `filter_bits`
(default 2**27, 16 MB: the bound of what is broadcast); with more rows than that allows it lets more
rows through to the shuffle, which then decides exactly as before.

Groups with more than a 10,000th of the rows (at most 10,000 groups, so a bounded table) are joined
by broadcast, all others by their hash, so that one huge group of copies is not joined in one task.

Nulls: a null text counts as empty; null doc_ids come last. Of rows with equal text and equal
doc_id, the first read stays. Empty tables give empty results; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import spread_join, written

BLOCK = 32_768  # bits: what bitmap_construct_agg makes


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _bits(sha: str, blocks: int) -> tuple[Column, Column]:
    """The block of a hash and its places there."""
    h = F.xxhash64(sha)
    place = lambda shift: F.pmod(F.shiftrightunsigned(h, shift), F.lit(BLOCK)).cast("int")
    return F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(blocks)).cast("int"), F.array_distinct(F.array(place(0), place(32)))


def repeated_filter(hashes: DataFrame, sha: str, rows: int, filter_bits: int) -> tuple[DataFrame, int]:
    """Bits that two rows or more set: (_block, _bitmap)."""
    want = min(filter_bits, max(BLOCK, 16 * rows))
    blocks = max(1, want // BLOCK)
    block, places = _bits(sha, blocks)
    twice = hashes.select(block.alias("_block"), F.explode(places).alias("_place")).groupBy("_block", "_place").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_place").cast("long")).alias("_bitmap")), blocks


def with_flag(rows: DataFrame, sha: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """Adds _maybe: the row's hash may occur again."""
    bits, blocks = filter_
    block, places = _bits(sha, blocks)
    byte = lambda p: F.conv(F.hex(F.substring("_bitmap", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.forall(places, lambda p: byte(p).bitwiseAND(F.pow(F.lit(2), p % 8).cast("int")) != 0)
    tested = rows.withColumn("_b", block).join(F.broadcast(bits), F.col("_b") == F.col("_block"), "left")
    return tested.withColumn("_maybe", F.coalesce(F.col("_bitmap").isNotNull() & hit, F.lit(False))).drop("_b", "_block", "_bitmap")


def _groups(maybe: DataFrame, sha: str, order: Column) -> DataFrame:
    return maybe.groupBy(sha).agg(F.min(order).alias("_first"), F.count("*").alias("size"), F.count("*").alias("_size"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = 1 << 27) -> DataFrame:
    """One row per document: _rid, key, keep_id, group_size, kept, text_sha256."""
    hashed = written(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), text_sha256(F.col(text)).alias("text_sha256")), "dedup-hashes")
    n = hashed.count()
    flagged = with_flag(hashed, "text_sha256", repeated_filter(hashed, "text_sha256", n, filter_bits))
    alone = flagged.where("not _maybe").select("_rid", "_key", F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.where("_maybe").drop("_maybe")
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_rid").alias("rid"))
    both = spread_join(maybe, _groups(maybe, "text_sha256", order), "text_sha256", n)
    return alone.unionByName(both.select("_rid", "_key", F.col("_first.key").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_first.rid") == F.col("_rid")).alias("kept"), "text_sha256"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = 1 << 27) -> DataFrame:
    """docs without later copies. Only rows that may be repeated shuffle with their text; the others pass through."""
    cols = docs.columns
    named = docs.select(*(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(cols)))
    k, t = f"c_{cols.index(key)}", f"c_{cols.index(text)}"
    hashed = named.withColumn("_sha", text_sha256(F.col(t)))
    bare = written(hashed.select("_sha", F.col(k).alias("_key")), "dedup-hashes")
    n = bare.count()
    bits = repeated_filter(bare, "_sha", n, filter_bits)
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"))
    groups = written(_groups(with_flag(bare, "_sha", bits).where("_maybe"), "_sha", order).where("_size > 1"), "dedup-groups")
    flagged = with_flag(hashed, "_sha", bits)
    alone = flagged.where("not _maybe").select(*named.columns)
    maybe = flagged.where("_maybe").drop("_maybe")
    least = max(1000, n // 10_000)
    large = F.broadcast(groups.where(F.col("_size") > least).select(F.col("_sha").alias("_l"), F.col("_first").alias("_lf")))
    rows = maybe.join(large, F.col("_sha") == F.col("_l"), "left")
    first = lambda f: F.col(f"{f}.key").eqNullSafe(F.col(k))
    hot = rows.where(F.col("_l").isNotNull() & first("_lf")).drop("_l", "_lf")
    rest = rows.where("_l is null").drop("_l", "_lf").join(groups.where(F.col("_size") <= least).select("_sha", "_first"), "_sha", "left")
    rest = rest.where(F.col("_first").isNull() | first("_first")).select(*hot.columns)
    chosen = hot.unionByName(rest).dropDuplicates(["_sha", k])  # repeated rows of the same doc_id
    return alone.unionByName(chosen.select(*named.columns)).select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(cols)))
