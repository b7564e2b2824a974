"""Approximate nearest neighbours by inner product: adaptive dimension scan of probed lists.

Vectors get one more component that makes their lengths equal, so that the largest inner product is
the least distance; then a random rotation spreads every distance evenly over the dimensions. An index of
k-means lists, fitted on a bounded sample (`sample`: the square root of the number of vectors, at least
16,384 and at most 262,144, those with the least hash), holds every vector; there are at most a quarter as
many lists as sample vectors. The number of lists probed is chosen on the sample, so that `recall` of its own
nearest pairs is found there by queries of the form that all queries have. A list is stored in cells of
at most `cell` vectors, in column blocks, and its queries come in portions of about `portion`; a query
scans the blocks of a cell one after the other, and after each a hypothesis test on the partial
distance abandons candidates that are unlikely to come near enough: within the distance of the k-th of the
sample, or of those in the cell that look nearest. Survivors are scored exactly on the original vectors.

Equal vectors are searched for once: of a group, only the k + 1 smallest ids can be in a result, and
all of its queries have one answer. So a vector with very many copies costs no more than another.

Ids are whole numbers; rows without one take no part, as no result could name them. Neither do vectors that
are null, zero, of another than the most frequent length, or hold null or non-finite components. Ties go to
the smaller id; with fewer than k candidates all are returned. Rows that share an id are queries and
candidates of their own: a query leaves out its own row only. Empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

EPSILON = 2.1  # of the hypothesis test: larger abandons later


class Index:
    """rotation, lists' centres, the length that all vectors get, lists to probe."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, k: int, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dims, self.longest = sample.shape[1], longest
        self.rotation = np.linalg.qr(rng.standard_normal((self.dims + 1, self.dims + 1)))[0]
        self.sample = x = self.rotated(sample)
        self.centres = c = x[rng.permutation(len(x))[: min(lists, len(x))]].copy()
        for _ in range(10):
            own = self.near(x, c, 1)[:, 0]
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            c[own[order][starts]] = np.add.reduceat(x[order], starts) / np.diff([*starts, len(x)])[:, None]
        self.centres, self.home = c, self.near(x, c, 1)[:, 0]
        self.probes = self._probes(sample, k, recall, rng)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        """Vectors of one length, turned; a query has no part in the additional dimension."""
        more = np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(1)))
        return np.concatenate([x, more[:, None]], 1) @ self.rotation

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.zeros((len(x), 1))], 1) @ self.rotation

    def limit(self, q: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """For each query, a distance within which the sample has 2 k vectors in the lists that it probes, so that k are found though a test errs."""
        if len(self.sample) < 2 * k:
            return np.full(len(q), np.inf)
        out, turned, own = [], self.query(q), (self.sample**2).sum(1)
        for a in range(0, len(q), 256):
            d = own + (turned[a : a + 256] ** 2).sum(1)[:, None] - 2 * turned[a : a + 256] @ self.sample.T
            seen = np.zeros((len(d), len(self.centres)), bool)
            np.put_along_axis(seen, probed[a : a + 256], True, 1)
            out.append(np.partition(np.where(seen[:, self.home], d, np.inf), 2 * k - 1, 1)[:, 2 * k - 1])
        return np.concatenate(out) + 1e-9 * (self.longest**2 + 1e-300)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The lists that queries of these vectors look into."""
        return self.near(self.query(x), self.centres, min(self.probes, len(self.centres)))

    @staticmethod
    def near(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        """Each row's n nearest centres, nearest first."""
        out = []
        for a in range(0, len(x), 4096):
            d = (centres**2).sum(1) - 2 * x[a : a + 4096] @ centres.T
            best = np.argpartition(d, n - 1, 1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out.append(np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), 1, "stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)

    def _probes(self, sample: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
        """Lists to probe so that queries made of sample vectors, without the additional dimension as all queries are, find `recall` of their k nearest others."""
        x, pick = self.sample, rng.permutation(len(sample))[:512]
        some = self.query(sample[pick])
        place = np.argsort(self.near(some, self.centres, len(self.centres)), 1)  # of each list in each query's order
        d = (x**2).sum(1) - 2 * some @ x.T
        d[np.arange(len(pick)), pick] = np.inf
        m = min(k, len(x) - 1)
        if not m:
            return 1
        found = np.sort(np.take_along_axis(place, self.home[np.argpartition(d, m - 1, 1)[:, :m]], 1).ravel())
        return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1


def _clean(v: Column, dims: int) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & (F.size(v) == dims) & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def scan(x: np.ndarray, queries: np.ndarray, limit: np.ndarray, k: int, block: int = 16, few: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among a query's k nearest of the cell and within its limit.

    Column blocks are read one after the other, for all queries at once; of pairs with a partial
    distance over d of D dimensions, those are abandoned whose estimate exceeds the limit by more
    than chance allows. The limit falls to the distance of the k-th of those that look nearest at first.
    A block is one matrix product until `few` of the pairs are left, then only these are gathered.
    """
    n, dims = x.shape
    part, q, v = np.zeros((len(queries), n)), None, None
    rounding = 1e-12 * ((queries**2).sum(1) + (x**2).sum(1).max(initial=0))  # of products; must not lose a pair at the limit
    limit = limit + rounding
    for a in range(0, dims, block):
        b = min(dims, a + block)
        xb, qb = x[:, a:b], queries[:, a:b]
        if q is None:
            part += (xb**2).sum(1) + (qb**2).sum(1)[:, None] - 2 * qb @ xb.T
            if not a and n > k:
                first = np.argpartition(part, k - 1, 1)[:, :k]
                limit = np.minimum(limit, ((x[first] - queries[:, None, :]) ** 2).sum(2).max(1) + rounding)
        else:
            part = part + ((xb[v] - qb[q]) ** 2).sum(1)
        wide = limit if b == dims else limit * (b / dims) * (1 + EPSILON / np.sqrt(b)) ** 2
        if q is None:
            alive = part <= wide[:, None]
            if b == dims or np.count_nonzero(alive) <= few * alive.size:
                q, v = np.nonzero(alive)
                part = part[q, v]
        else:
            keep = part <= wide[q]
            q, v, part = q[keep], v[keep], part[keep]
    return q, v


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_: str = "vec_id", vector: str = "embedding", lists: int | None = None, recall: float = 0.985, sample: int | None = None, cell: int = 4096, portion: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by `every`, the k others of largest inner product found."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    dims = lengths["d"]
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = written(rows.where(_clean(F.col("v"), dims)).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(9), "v")), "vectors")
    total, asks, longest = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(norm)).first()
    if not total:
        return empty
    same = Window.partitionBy("h1", "h2").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)  # each task keeps k + 1 before the shuffle
    groups = kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "vector-groups")
    sample = sample or int(min(max(np.sqrt(total), 16_384), 262_144))
    drawn = np.array([r["v"] for r in groups.orderBy(F.xxhash64("h1"), "h1", "h2").limit(sample).select("v").collect()])
    index = Index(drawn, float(np.sqrt(longest)), lists or int(min(sample // 4, max(1, np.sqrt(total) / 4))), k, recall)
    shared = spark.sparkContext.broadcast(index)
    # As many portions of queries for a list as the sample's share of queries that probe it suggests.
    load = np.bincount(index.probed(drawn).ravel(), minlength=len(index.centres)) * (asks / len(drawn))
    portions = spark.createDataFrame([(i, int(x // portion) + 1) for i, x in enumerate(load.tolist())], "list int, portions int")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = shared.value.rotated(np.stack(f["v"].to_numpy()))
                yield pd.DataFrame({"g": f["g"], "list": shared.value.near(x, shared.value.centres, 1)[:, 0].astype(np.int32), "v": f["v"], "ids": f["ids"]})

    placed = written(groups.select("g", "v", "ids").mapInPandas(assign, "g long, list int, v array<double>, ids array<long>"), "vector-lists")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")).join(portions, "list")
    sizes = F.broadcast(sizes)  # a row for each list, of which there are at most a quarter of `sample`
    cells = placed.join(sizes, "list").withColumn("cell", F.pmod(F.xxhash64("g"), F.col("cells")).cast("int")).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q = np.stack(f["v"].to_numpy())
                own = shared.value.probed(q)
                m = own.shape[1]
                yield pd.DataFrame({"q": np.repeat(f["q"].to_numpy(), m), "v": np.repeat(f["v"].to_numpy(), m), "limit": np.repeat(shared.value.limit(q, own, k + 1), m), "list": own.ravel().astype(np.int32)})

    asked = rows.where(F.col("id") % every == 0).select("id", "h1", "h2")
    wanted = asked.select("h1", "h2").distinct().join(groups.select(F.col("g").alias("q"), "h1", "h2", "v"), ["h1", "h2"])
    probes = wanted.select("q", "v").mapInPandas(probe, "q long, v array<double>, limit double, list int").join(sizes, "list")
    probes = probes.withColumn("portion", F.pmod(F.xxhash64("q"), F.col("portions")).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))

    def search(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        if len(candidates) and len(queries):
            index, x, q = shared.value, np.stack(candidates["v"].to_numpy()), np.stack(queries["v"].to_numpy())
            names, limit, turned, asked = queries["q"].to_numpy(), queries["limit"].to_numpy(), index.rotated(x), index.query(q)
            group, lens = candidates["g"].to_numpy(), candidates["ids"].map(len).to_numpy()
            ids, begin = np.concatenate(candidates["ids"].to_numpy()), np.cumsum(lens) - lens
            step = max(1, min(512, (1 << 21) // len(x)))
            for a in range(0, len(q), step):
                at, v = scan(turned, asked[a : a + step], limit[a : a + step], k + 1)
                score = (x[v] * q[a + at]).sum(1)
                m = lens[v]
                got = ids[np.repeat(begin[v] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
                at, score, v = np.repeat(at, m), np.repeat(score, m), np.repeat(v, m)
                order = np.lexsort((got, -score, at))
                at, score, got, v = at[order], score[order], got[order], v[order]
                near = np.arange(len(at)) - np.searchsorted(at, at) <= k
                q_ = names[a + at[near]]
                out.append((q_, got[near], score[near], group[v[near]] == q_))
        return pd.DataFrame(dict(zip(("q", "vec_id", "score", "equal"), map(np.concatenate, zip(*out)))))

    at = ("list", "cell", "portion")
    found = cells.select(*at, "g", "v", "ids").groupBy(*at).cogroup(probes.select(*at, "q", "v", "limit").groupBy(*at)).applyInPandas(search, "q long, vec_id long, score double, equal boolean")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    answers = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "equal"))).alias("best"))
    named = groups.select(F.col("g").alias("q"), "h1", "h2").join(answers, "q")
    # One of the rows with the query's vector and id is the query itself.
    itself = F.array_position(F.transform("best", lambda b: b["equal"] & (b["vec_id"] == F.col("id"))), F.lit(True))
    others = F.slice(F.filter("best", lambda b, i: i + 1 != F.col("itself")), 1, k)
    out = asked.join(named, ["h1", "h2"]).withColumn("itself", itself).select(F.col("id").alias("query_id"), others.alias("best"))
    return out.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
