"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a hash, form one stream of words, cut into blocks of
`block_words`. A target asks for so many words of a source: whole passes over its stream and then,
in a pass with a permutation of its own, the first blocks of that permutation, the last of them cut
so that the words match exactly. The drawn blocks of a source are numbered; the tree parts all
quotas among output shards, each node giving half of its blocks to the left by a multivariate
hypergeometric draw, so shards are disjoint, of equal size and mixed as by a global shuffle.
A block's order within its shard is a hash.

Sources are settings of the mix (each has a weight), so their totals are held by the driver; every
table of documents, blocks or shards stays distributed. Reruns with one seed agree.

Nulls: a null text has no words; null source is a source of its own, the last; null doc_id is an id.
Repeated rows are separate rows. Documents without words are never taken. Empty tables give empty
results. Other columns are carried along untouched, whatever their names. Documents are ordered by a
hash of key and text, so only rows equal in both depend on the order of reading.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import numbered, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: `share` of all, by weight, at most `most` times a source; what is over goes to the others by weight."""
    total, cap = share * sum(sizes), [most * s for s in sizes]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(cap[i] for i in range(len(sizes)) if i not in free)
        unit = rest / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > cap[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        free -= over
        for i in over:
            out[i] = cap[i]
    return out


def _number(seed: int, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *what)).encode(), digest_size=8).digest(), "big")


def _permutation(seed: int, source: int, n: int) -> tuple[int, int]:
    """a, c of j -> (a * j + c) % n, one to one; a stays small enough for 64-bit products."""
    if n < 3:
        return 1, 0
    a = _number(seed, source, "a") % min(n, 1 << 22) | 1
    while math.gcd(a, n) > 1:
        a += 2
    return a % n if n < 1 << 22 else a, _number(seed, source, "c") % n


def _drawn(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n blocks drawn from good + bad are good."""
    if not good or not bad or not n:
        return 0 if not good else n
    return int(rng.hypergeometric(good, bad, n)) if good < 10**9 > bad else _inverted(good, bad, n, rng)


def _inverted(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """The same law for any size, by inversion over 12 standard deviations on both sides of the mode.

    Logarithms of probabilities, relative to the first, are sums of those of neighbours' exact ratios.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = 12 * (math.isqrt(n * good * bad * (total - n) // (total * total * (total - 1))) + 8)
    low, high = max(0, n - bad, mode - wide), min(good, n, mode + wide)
    x = np.arange(low, high, dtype=np.float64)  # exact below 2**53
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)  # from x to x + 1
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def _halves(quota: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw of `left` blocks from quota."""
    rest, out = int(quota.sum()), np.zeros_like(quota)
    for i, q in enumerate(quota.tolist()):
        rest -= q
        out[i] = x = _drawn(q, rest, left, rng)
        left -= x
    return out


def split_tree(seed: int, to: int, depth: int):
    """mapInPandas function: expands nodes down to level `to` of `depth`; a leaf of the tree is a shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                stack = [(row.level, row.node, np.array(row.quota, np.int64), np.array(row.start, np.int64))]
                done: list[tuple] = []
                while stack:
                    level, node, quota, start = stack.pop()
                    if level == to or level == depth:
                        done.append((level, node, quota.tolist(), start.tolist()))
                        if len(done) >= 1024:
                            yield pd.DataFrame(done, columns=["level", "node", "quota", "start"])
                            done = []
                        continue
                    left = _halves(quota, int(quota.sum()) // 2, np.random.default_rng([seed, level, node]))
                    stack += [(level + 1, 2 * node + 1, quota - left, start + left), (level + 1, 2 * node, left, start)]
                if done:
                    yield pd.DataFrame(done, columns=["level", "node", "quota", "start"])

    return run


class Mix:
    """rows: documents' _rid (column `row`, or a number of their own), _key, _source, _size and order. plan: a row for each source. Runs: see place()."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: int = 7, block_words: int = 1024, shard_words: int = 1 << 18, bucket_rows: int = 10_000, text: str = "text", source: str = "source", key: str = "doc_id", row: str | None = None):
        spark = docs.sparkSession
        self.seed, self.block = seed, block_words
        rid = F.monotonically_increasing_id() if row is None else F.col(row)
        order = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
        self.rows = written(docs.select(rid.alias("_rid"), F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("_size"), order.alias("_h")), "mix-sizes")
        stats = self.rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()  # one row for each source of the mix
        stats.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
        sizes = [r["size"] for r in stats]
        wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share)
        plans, quota = [], []
        for i, (r, want) in enumerate(zip(stats, wanted)):
            size, words = r["size"], round(want)
            n = -(-size // block_words)
            a, c = _permutation(seed, i, max(n, 1))
            full, rest = divmod(words, size) if size else (0, 0)
            short = n * block_words - size  # what the last block lacks
            at = (a * (n - 1) + c) % n if n else 0  # the last block's place in the permuted pass
            drawn = 0
            if rest:
                drawn = -(-rest // block_words)
                if at < drawn:
                    drawn = max(at + 1, -(-(rest + short) // block_words))
            plans.append((i, r[0], size, float(want), n, a, c, full, rest, short, at, max(1, -(-r["n"] // bucket_rows))))
            quota.append(full * n + drawn)
        self.plan = spark.createDataFrame(plans, "_sid int, _source string, source_size long, target double, _n long, _a long, _c long, _full long, _rest long, _short long, _at long, _buckets long")
        self.quota = quota
        self.depth = max(0, math.ceil(math.log2(max(1, sum(quota) * block_words / shard_words))))

    def shards(self) -> DataFrame:
        """(shard, _sid, _from, _blocks): the tree's leaves."""
        spark = self.rows.sparkSession
        form = "level int, node long, quota array<long>, start array<long>"
        tree = spark.createDataFrame([(0, 0, self.quota, [0] * len(self.quota))] if self.quota else [], form).coalesce(1)
        top = min(self.depth, 6)
        tree = tree.mapInPandas(split_tree(self.seed, top, self.depth), form)
        if self.depth > top:
            tree = tree.repartition("node").mapInPandas(split_tree(self.seed, self.depth, self.depth), form)
        leaf = tree.select(F.col("node").alias("shard"), F.posexplode(F.arrays_zip("quota", "start")).alias("_sid", "x"))
        return leaf.select("shard", "_sid", F.col("x.start").alias("_from"), F.col("x.quota").alias("_blocks")).where("_blocks > 0")

    def drawn(self) -> DataFrame:
        """What is taken of each document: (_rid, _sid, epoch, block, _seq, first_word, n_words)."""
        small = F.broadcast(self.plan.drop("source_size", "target"))
        rows = self.rows.where("_size > 0").join(small, self.rows["_source"].eqNullSafe(small["_source"])).select("_rid", "_sid", "_size", *(c for c in self.plan.columns if c[0] == "_" and c not in ("_source", "_sid")), "_h")
        rows = rows.withColumn("_bucket", F.pmod("_h", "_buckets"))
        sums = rows.groupBy("_sid", "_bucket").agg(F.sum("_size").alias("_sum"))
        base = sums.select("_sid", "_bucket", (F.sum("_sum").over(Window.partitionBy("_sid").orderBy("_bucket")) - F.col("_sum")).alias("_base"))
        rows = rows.join(base, ["_sid", "_bucket"])
        inside = Window.partitionBy("_sid", "_bucket").orderBy("_h", "_rid").rowsBetween(Window.unboundedPreceding, 0)
        b = self.block
        rows = rows.withColumn("_start", F.col("_base") + F.sum("_size").over(inside) - F.col("_size"))
        rows = rows.withColumn("block", F.explode(F.expr(f"sequence(_start div {b}, (_start + _size - 1) div {b})")))
        rows = rows.withColumn("_rank", F.expr("(_a * block + _c) % _n"))
        rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, _full)"))).where("epoch < _full or _rest > 0")
        before = f"_rank * {b} - if(_at < _rank, _short, 0)"
        taken = f"if(epoch < _full, {b}, least({b}, greatest(0, _rest - ({before}))))"  # words of the block, from its start
        rows = rows.withColumn("_lo", F.expr(f"greatest(_start, block * {b})")).withColumn("_hi", F.expr(f"least(_start + _size, (block + 1) * {b}, block * {b} + {taken})"))
        return rows.where("_hi > _lo").select("_rid", "_sid", "epoch", "block", F.expr("epoch * _n + _rank").alias("_seq"), F.expr("_lo - _start").alias("first_word"), F.expr("_hi - _lo").alias("n_words"))

    def place(self) -> DataFrame:
        """Each taken run of a document's words with its shard and its order there."""
        seqs = self.shards().select("shard", "_sid", F.explode(F.expr("sequence(_from, _from + _blocks - 1)")).alias("_seq"))
        return self.drawn().join(seqs, ["_sid", "_seq"]).withColumn("order", F.xxhash64("_sid", "_seq", F.lit(self.seed)))

    def taken(self) -> DataFrame:
        """One row per document: _rid, _key, _size, source_size, target, taken."""
        sums = self.place().groupBy("_rid").agg(F.sum("n_words").alias("taken"))
        plan = F.broadcast(self.plan.select(F.col("_source").alias("_s"), "source_size", "target"))
        out = self.rows.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).join(sums, "_rid", "left")
        return out.select("_rid", "_key", "_size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with docs' columns: a row for each pass that takes words of a document.

    A document taken whole keeps its text as it is; one cut by a block's end has the taken words,
    joined by one space. Shards are dealt to partitions whole, and each is in its own order there.
    """
    rows, row = numbered(docs)
    mix = Mix(rows, row=row, **settings)
    text, key = settings.get("text", "text"), settings.get("key", "doc_id")
    runs = mix.place().groupBy("_rid", "epoch").agg(F.min(F.struct("shard", "order")).alias("at"), F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
    runs = mix.rows.select("_rid", "_size").join(runs, "_rid").select("_rid", F.struct("epoch", "at", "runs", (F.col("taken") == F.col("_size")).alias("whole")).alias("_run"))
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    named = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(row).alias("_row"))
    joined = named.join(runs, F.col("_row") == F.col("_rid"))
    words = F.regexp_extract_all(F.col(names[text]), F.lit(f"({WORD})"))
    taken = lambda w: F.array_join(F.flatten(F.transform("_run.runs", lambda r: F.slice(w, (r["first_word"] + 1).cast("int"), r["n_words"].cast("int")))), " ")
    cut = F.get(F.transform(F.array(words), taken), F.lit(0))  # bound once for all runs
    out = {c: F.col(n) for c, n in names.items()}
    out[text] = F.when(F.col("_run.whole"), out[text]).otherwise(cut)
    # The text is cut before it moves.
    return joined.select(*(v.alias(names[c]) for c, v in out.items()), "_run").repartition("_run.at.shard").sortWithinPartitions("_run.at", names[key], "_run.epoch").select(*(F.col(n).alias(c) for c, n in names.items()))
