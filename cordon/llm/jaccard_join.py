"""N-gram Jaccard join by vertical partitioning of the n-gram order.

N-grams are ordered by hash, and this order is cut into fragments. Two sets with a similarity of p
percent or more differ in at most a (100 - p) / p of the smaller set's size; cut into a known number of
fragments more than that, they agree in that number of whole fragments at least. A hash of each fragment finds
them, and sets that meet no others in so many fragments are left out. Fragments that are empty in
both show nothing, so they lower that number, and a set with as many empty ones has a key for each pair of these. Sizes are cut into classes, so that a set knows by which number of fragments it meets
smaller and larger ones.

Each set of a bucket is first held against the bucket's least member only. Sets of buckets that still
hold several components are then ordered by how rare their n-grams are among them: two that link
share one of the rarest few, and what follows the first that they share bounds their overlap. A
near copy with many n-grams of its own thus meets nobody, and the others are held against the one
nearest to what they have in common, then across the components that are left. A pair's overlap is counted
fragment by fragment (here a fixed number of them, so that rows stay small), the partial counts are
summed, and the exact comparison of integers decides. Equal sets are one node from the start, so copies
are never paired.

A Bloom filter of keys that occur twice keeps single keys out of the shuffle. Texts are cut into n-grams twice: for
that filter, and for documents and keys; after that only those whose sets must be compared, one text a set.

Nulls: a null text, or one without words, has an empty set and is linked with nothing; a null doc_id
comes last when the smallest of a component is taken. Texts with fewer words than n have one n-gram,
the whole. Repeated rows have one component. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, holds
from .components import components
from .store import scratch, spread_join, written
from .textops import Words, grams, mix, pieces

PARTS = 8  # fragments in which overlaps are counted


@cache
def size_classes(percent: int) -> tuple[int, ...]:
    """Least sizes of the classes: a set links with sets of its own class and of the next ones only."""
    out = [-(-percent // (100 - percent))]  # smaller sets link with equal sets only
    while out[-1] < 1 << 40:
        out.append(100 * out[-1] // percent + 1)
    return tuple(out)


def fragments(percent: int, k: int) -> tuple[int, int]:
    """For pairs whose smaller set is of class k: the number of fragments, and how many at least are equal in both."""
    differ = (100 - percent) * (size_classes(percent)[k + 1] - 1) // percent
    same = 2 + differ // 8
    return differ + same, same


def sets_of(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashed n-grams of each document."""
    words = Words(data, ends, lower=True)
    h = words.hashes()
    g = grams(h, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        out.append(np.unique(g[a : b - n + 1]) if b - a >= n else grams(h[a:b], b - a) if b > a else g[:0])
    return out


def node_of(s: np.ndarray) -> int:
    """One number for a set."""
    return int((mix(s, 1).sum(dtype=np.uint64) ^ (mix(s, 2).sum(dtype=np.uint64) >> np.uint64(1))).view(np.int64))


def keys_of(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """The keys by which a set meets others, as (side, least number shared with any set that it links with on that side, keys)."""
    classes = size_classes(percent)
    if len(s) < classes[0]:
        return []
    k = int(np.searchsorted(classes, len(s), "right")) - 1
    out = []
    for scheme in (k, k - 1)[: 1 + (k > 0)]:
        f, same = fragments(percent, scheme)
        part = ((s >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        there = part[begin]
        keys = mix(np.add.reduceat(mix(s, 3), begin) + mix(there + np.uint64(scheme << 40), 4))
        empty = f - len(there)
        if empty >= same:
            at = np.setdiff1d(np.arange(f, dtype=np.uint64), there)
            i, j = np.triu_indices(len(at), 1)
            keys = np.concatenate([keys, mix(mix(at[i], 5) + mix(at[j] + np.uint64(scheme << 40), 6))])
        out.append((scheme & 1, max(1, same - empty), keys))
    return out


def _distinct_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[dict[int, np.ndarray]]:
    for batch in batches:
        for _, data, ends in pieces(batch, "_text"):
            yield {node_of(s): s for s in sets_of(data, ends, n) if len(s)}


def _all_keys(n: int, percent: int):
    """The keys of the sets of a slice, with their numbers there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _distinct_sets(batches, n):
            flat = [k[2] for s in sets.values() for k in keys_of(s, percent)]
            h, c = np.unique(np.concatenate(flat) if flat else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int32())], ["h", "c"])

    return run


def _documents_and_keys(n: int, percent: int, bits):
    """A row for each document, with its set's size and node; and rows with the keys of these sets that may recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in pieces(batch, "_text"):
                sets = sets_of(data, ends, n)
                nodes = [node_of(s) if len(s) else None for s in sets]
                found = [(x, len(s), *k) for x, s in dict(zip(nodes, sets)).items() if len(s) for k in keys_of(s, percent)]
                flat = np.concatenate([k[4] for k in found]) if found else np.zeros(0, np.uint64)
                go = holds(bits.value, flat)
                counts, m, docs = [len(k[4]) for k in found], int(go.sum()), part.num_rows
                each = lambda i, kind: np.repeat(np.array([k[i] for k in found], kind), counts)[go]
                both = lambda x, y, kind: pa.concat_arrays([pa.array(x, kind), pa.array(y, kind)])
                none = [None] * docs
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.concat_arrays([part.column(c), pa.nulls(m, part.column(c).type)]) for c in ("_key", "_hash")),
                        both([len(s) for s in sets], each(1, np.int64), pa.int64()), both(nodes, each(0, np.int64), pa.int64()), both(none, flat[go].view(np.int64), pa.int64()),
                        both(none, each(2, np.int32), pa.int32()), both(none, each(3, np.int32), pa.int32()),
                    ],
                    ["_key", "_hash", "n", "node", "h", "side", "need"],
                )

    return run


def _fragments(n: int, bits):
    """The sets of the texts that the filter has, fragment by fragment; of equal texts in a batch, one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = np.unique(batch.column("_hash").to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(first[holds(bits.value, mix(h.view(np.uint64)))])))
            for sets in _distinct_sets(iter([batch]), n):
                rows = []
                for x, s in sets.items():
                    cut = np.searchsorted(s >> np.uint64(61), np.arange(PARTS + 1, dtype=np.uint64)).tolist()
                    rows += [(x, f, s[a:b].tobytes()) for f, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                cols = list(zip(*rows)) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["node", "f", "s"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["h"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
            counts.append(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(counts, pa.int64())], ["a", "b", "part"])


def _meeting(keyed: DataFrame, group: str) -> DataFrame:
    """Rows of keys that several groups have, of sets with as many such keys as a link needs."""
    several = keyed.groupBy("h").agg(F.min(group).alias("lo"), F.max(group).alias("hi")).where("lo <> hi").select("h")
    met = keyed.join(several, "h", "left_semi")
    enough = met.groupBy("node", "side").agg(F.count("*").alias("k"), F.first("need").alias("w")).where("k >= w").select("node", "side")
    return met.join(enough, ["node", "side"], "left_semi")


def _sets(rows: DataFrame, sized: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, f, s): the sets of these nodes, cut into fragments, each read from one of its texts; and by chance a few others."""
    texts = sized.groupBy("node").agg(F.min("_hash").alias("_hash")).join(nodes.select("node"), "node", "left_semi")
    bits = bloom(texts.select("_hash").mapInArrow(_mixed, "h long"), "h")
    found = rows.select("_text", "_hash").mapInArrow(_fragments(n, bits), "node long, f int, s binary")
    return written(found.groupBy("node", "f").agg(F.first("s").alias("s")), "fragments")


def _verified(pairs: DataFrame, parts: DataFrame, percent: int, outer: bool = False) -> DataFrame:
    """Of pairs (a, na, b, nb), those that link: overlaps are counted fragment by fragment and summed."""
    left = parts.select(F.col("node").alias("a"), "f", "s")
    right = parts.select(F.col("node").alias("b"), "f", F.col("s").alias("t"))
    both = pairs.select("a", "b").join(left, "a").join(right, ["b", "f"])
    sums = both.select("a", "b", "s", "t").mapInArrow(_overlaps, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("common"))
    linked = pairs.join(sums, ["a", "b"]).where(F.col("common") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common")))
    return written(linked.select("a", "b"), "links", outer)


#: Frequencies from which an n-gram is in the next class; in the first class are those that occur once.
CLASSES = (2, 4, 8, 16, 64, 256, 1024, 4096)


def _in_class(g: np.ndarray, k: int) -> np.ndarray:
    """A hash of n-grams together with a class."""
    return mix(g + np.uint64(0x9FB21C651E98DF25 * k % (1 << 64)), 7)


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, c = np.unique(np.frombuffer(b"".join(batch.column("s").to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c, pa.int64())], ["g", "c"])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, c = (batch.column(x).to_numpy() for x in ("g", "c"))
        k = np.searchsorted(CLASSES, c, "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_in_class(g[k >= i].view(np.uint64), i) for i in range(1, len(CLASSES) + 1)]).view(np.int64))], ["h"])


def _rarest(percent: int, bits):
    """Of each set, in the order of classes and hashes, as many n-grams as a link needs one of, with their places; those that occur once are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for node, parts in zip(batch.column("node").to_pylist(), batch.column("x").to_pylist()):
                g = np.frombuffer(b"".join(parts), np.uint64)
                k = np.zeros(len(g), np.int64)
                for i in range(1, len(CLASSES) + 1):
                    k += holds(bits.value, _in_class(g, i))
                order = np.lexsort((g, k))[: len(g) - -(-len(g) * percent // 100) + 1]
                at = np.flatnonzero(k[order] > 0)
                out.append((g[order[at]].view(np.int64), np.full(len(at), node), np.full(len(at), len(g)), at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["g", "node", "n", "at"])

    return run


def _prefixes(parts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(g, node, n, at): the rarest n-grams of each set, as many as a link needs one of, with their places.

    Rare means rare among these sets. Any order that all sets have in common will do, so it is one of classes of
    frequency, which a Bloom filter of bounded size holds, and n-grams themselves never meet their counts in a join.
    """
    own = parts.join(nodes.select("node"), "node", "left_semi")
    counts = own.select("s").mapInArrow(_grams_of, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= CLASSES[0])
    bits = bloom(counts.mapInArrow(_classed, "h long"), "h")
    sets = own.groupBy("node").agg(F.collect_list("s").alias("x"))  # a row for each fragment, of which there are a fixed number
    return written(sets.mapInArrow(_rarest(percent, bits), "g long, node long, n long, at long"), "prefixes")


def _can(percent: int, a: str, b: str):
    """Whether sets that have their first common n-gram at these places can link: what is left of both suffices."""
    na, nb, ia, ib = (F.col(f"{c}{x}") for c in ("n", "at") for x in (a, b))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - ia, nb - ib) * (100 + percent) >= (na + nb) * percent)


def _without(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that are not among the known ones, either way round."""
    turned = known.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(known.select("a", "b").union(turned), ["a", "b"], "left_anti")


def near_components(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: _key, n_shingles, component_id, the smallest key reachable by links."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    kind = rows.schema["_key"].dataType.simpleString()
    spark = docs.sparkSession
    with scratch(spark):
        bits = bloom(rows.select("_text").mapInArrow(_all_keys(n, percent), "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1"), "h")
        form = f"_key {kind}, _hash long, n long, node long, h long, side int, need int"
        both = written(rows.mapInArrow(_documents_and_keys(n, percent, bits), form), "shingle-sets", outer=True)
        sized, keyed = both.where("h is null").select("_key", "_hash", "n", "node"), both.where("h is not null").select("h", "node", "n", "side", "need")
        with scratch(spark):
            keyed = written(keyed.groupBy("h", "node").agg(*(F.first(c).alias(c) for c in ("n", "side", "need"))), "keys")
            keyed = written(_meeting(keyed, "node"), "keys")
            keyed = written(_meeting(keyed, "node"), "keys", outer=True)  # each time fewer sets are left to meet
        least = keyed.groupBy("h").agg(F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("q")).where("p.node <> q").select("h", F.col("p.node").alias("p"), F.col("p.n").alias("np"))
        fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
        stars = keyed.join(least, "h").where((F.col("node") != F.col("p")) & fits("n", "np"))
        stars = stars.groupBy("node", "n", "p", "np").agg(F.count("*").alias("m"))
        best = stars.groupBy("node", "n").agg(F.max(F.struct("m", "p", "np")).alias("x"))
        first = written(best.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("x.p").alias("b"), F.col("x.np").alias("nb")), "pairs")
        with scratch(spark):
            links = _verified(first, _sets(rows, sized, first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), n), percent, outer=True)
        joined = components(links)
        # Buckets that still hold several components: their members may link across these.
        now = keyed.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
        nodes = written(_meeting(now, "c").select("node").distinct(), "open")
        if not nodes.isEmpty():
            parts = _sets(rows, sized, nodes, n)
            prefix = _prefixes(parts, nodes, percent)
            # Against the member with the fewest rarer n-grams: of a group of near copies, the one nearest to what they have in common.
            least = prefix.groupBy("g").agg(F.min(F.struct("at", "node", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
            meet = spread_join(prefix, least, "g", prefix.count()).where("node <> p.node").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), F.col("p.node").alias("b"), F.col("p.n").alias("nb"), F.col("p.at").alias("atb"))
            star = meet.where(_can(percent, "a", "b")).select("a", "na", "b", "nb").distinct()
            star = written(_without(star, first), "pairs")
            links = links.unionByName(_verified(star, parts, percent))
            joined = written(components(links), "components")
            side = lambda x: prefix.join(joined, "node", "left").select("g", F.col("node").alias(x), F.col("n").alias("n" + x), F.col("at").alias("at" + x), F.coalesce("component", "node").alias("c" + x))
            rest = side("a").join(side("b"), "g").where((F.col("ca") < F.col("cb")) & _can(percent, "a", "b")).select("a", "na", "b", "nb").distinct()
            rest = written(_without(_without(rest, first), star), "pairs")
            if not rest.isEmpty():
                links = links.unionByName(_verified(rest, parts, percent))
                joined = components(links)
        order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"))
        nodes = sized.where("node is not null").groupBy("node").agg(F.min(order).alias("least"), F.count("*").alias("size"))
        nodes = nodes.join(joined, "node", "left").select("node", "least", "size", F.coalesce("component", "node").alias("c"))
        nodes = written(nodes, "nodes", outer=True)
    total = sized.count()
    smallest = nodes.groupBy("c").agg(F.min("least").alias("smallest"), F.count("*").alias("size"))
    nodes = spread_join(nodes.select("node", "c", F.col("size").alias("copies")), smallest, "c", total).select("node", F.col("smallest.key").alias("component_id"), F.col("copies").alias("size"))
    alone = sized.where("node is null").select("_key", F.col("n").alias("n_shingles"), F.col("_key").alias("component_id"))
    return alone.unionByName(spread_join(sized.where("node is not null"), nodes, "node", total).select("_key", F.col("n").alias("n_shingles"), "component_id"))
