"""Exact vector search within a tenant, and the effect of filtering after a bounded candidate list.

Many queries are scored in blocks: a batch of rows against the query vectors of its tenants is one matrix product, and
of each only the nearest few leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import cosine_distance

#: Bytes of query vectors that are broadcast; more are dealt to the rows' tenants by a shuffle.
BROADCAST = 64 << 20


def top_k(rows: DataFrame, query: Sequence[float], k: int = 5, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """id, distance of the k nearest by cosine, ties by id; vectors without a distance (zero, null) come last."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = rows.select(F.col(id_), cosine_distance(F.col(vector), q).alias("distance"))
    return out.orderBy(F.col("distance").asc_nulls_last(), id_).limit(k)


class Vectors:
    """A column of vectors as one matrix per length; rows that have no distance to anything (null, with a null in it, zero) are in none."""

    def __init__(self, lists: pa.Array):
        lists = lists.cast(pa.list_(pa.float64()))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = lists.flatten(), np.cumsum(sizes)
        gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole = (sizes > 0) & (gaps[ends] == gaps[ends - sizes])
        values = flat.to_numpy(zero_copy_only=False)
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # length: rows, vectors, norms
        for n in np.unique(sizes[whole]).tolist():
            rows = np.flatnonzero(whole & (sizes == n))
            x = values.reshape(-1, n) if len(rows) == len(sizes) else values[(ends - sizes)[rows][:, None] + np.arange(n)]
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            some = norm != 0
            self.of[n] = (rows, x, norm) if some.all() else (rows[some], x[some], norm[some])


def nearest(rows: Vectors, n_rows: int, queries: Vectors, n_queries: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, distances) of the k nearest rows of each query and all that equal the k-th; NaN stands for no distance.

    Rows must be in the order in which ties count. Products only select; distances are summed pair by pair, so equal vectors tie.
    """
    none = np.full(n_rows, np.nan)
    left = np.ones(n_queries, bool)
    with np.errstate(all="ignore"):
        for n, (at, q, q_norm) in queries.of.items():
            mine, x, norm = rows.of.get(n, (np.zeros(0, np.int64), np.zeros((0, n)), np.zeros(0)))
            left[at] = False
            rest = np.setdiff1d(np.arange(n_rows), mine)[:k]
            for a in range(0, len(at), 256):
                rough = 1 - (q[a : a + 256] @ x.T) / (q_norm[a : a + 256, None] * norm)
                for i, d in enumerate(rough, a):
                    if len(d) > k:
                        edge = np.partition(d, k - 1)[k - 1]
                        pick = np.flatnonzero(~(d > edge + 1e-9))
                    else:
                        pick = np.arange(len(d))
                    exact = 1 - (x[pick] * q[i]).sum(1) / (norm[pick] * q_norm[i])
                    order = np.argsort(exact, kind="stable")[:k]
                    yield int(at[i]), np.concatenate([mine[pick[order]], rest]), np.concatenate([exact[order], none[: len(rest)]])
    for i in np.flatnonzero(left).tolist():
        yield i, np.arange(n_rows)[:k], none[:k]


def _answers(ids: pa.Array, rows: pa.Array, qids: pa.Array, queries: Vectors, k: int) -> pa.RecordBatch:
    order = pc.sort_indices(ids)
    names, found = ids.take(order), list(nearest(Vectors(rows.take(order)), len(ids), queries, len(qids), k))
    q = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
    r, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
    return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), names.take(pa.array(r.astype(np.int64))), pa.array(d, mask=np.isnan(d))], ["q", "id", "distance"])


def top_k_each(rows: DataFrame, queries: DataFrame, k: int = 5, id_: str = "id", vector: str = "embedding", tenant: str = "tenant_id", qid: str = "qid", broadcast: int = BROADCAST) -> DataFrame:
    """qid, id, distance, rank for many queries, each within its tenant; vectors without a distance come last, ties go by id.

    Queries of up to `broadcast` bytes are sent to all tasks. More are dealt to cells of a tenant's rows in portions, so
    that neither side of a cell grows with the tables.
    """
    q = queries.select(F.col(qid).alias("_q"), F.col(tenant).alias("_t"), F.col(vector).alias("_v"))
    own = rows.select(F.col(id_).alias("_i"), F.col(tenant).alias("_t"), F.col(vector).alias("_v")).where("_t is not null")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((q, "_q"), (own, "_i"))]
    form = f"q {kinds[0]}, id {kinds[1]}, distance double"
    size = q.agg(F.sum(F.coalesce(F.size("_v"), F.lit(0)) * 8 + 64)).first()[0] or 0
    if size <= broadcast:
        pairs = own.mapInArrow(_scan(rows.sparkSession.sparkContext.broadcast(q.toArrow()), k), form)
    else:
        pairs = _cells(own, q, k, form)
    order = Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), "id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(qid), F.col("id").alias(id_), "distance", "rank")


def _scan(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.combine_chunks()
        tenants = asked.column("_t").combine_chunks() if asked.num_rows else pa.array([], pa.string())
        ready: dict = {}
        for batch in batches:
            for t in pc.unique(batch.column("_t")):
                if t.as_py() not in ready:
                    mine = asked.filter(pc.equal(tenants, t)) if asked.num_rows else asked
                    ready[t.as_py()] = (mine.column("_q").combine_chunks(), Vectors(mine.column("_v").combine_chunks())) if mine.num_rows else None
                if own := ready[t.as_py()]:
                    part = batch.filter(pc.equal(batch.column("_t"), t))
                    yield _answers(part.column("_i"), part.column("_v"), *own, k)

    return run


def _cells(own: DataFrame, q: DataFrame, k: int, form: str, cell: int = 20_000, portion: int = 2_000) -> DataFrame:
    sizes = own.groupBy("_t").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    loads = q.groupBy("_t").agg(F.ceil(F.count("*") / portion).cast("int").alias("portions"))
    tenants = sizes.join(loads, "_t")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = own.join(tenants, "_t").withColumn("_c", dealt("_i", "cells")).withColumn("_p", spread("portions"))
    right = q.join(tenants, "_t").withColumn("_p", dealt("_q", "portions")).withColumn("_c", spread("cells"))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"q": asked.column("_q").slice(0, 0), "id": rows.column("_i").slice(0, 0), "distance": pa.array([], pa.float64())})
        column = lambda t, c: t.column(c).combine_chunks()
        return pa.Table.from_batches([_answers(column(rows, "_i"), column(rows, "_v"), column(asked, "_q"), Vectors(column(asked, "_v")), k)])

    at = ("_t", "_c", "_p")
    return left.select(*at, "_i", "_v").groupBy(*at).cogroup(right.select(*at, "_q", "_v").groupBy(*at)).applyInArrow(run, form)


def probe_after_filter(rows: DataFrame, query: Sequence[float], tenant: str, k: int, candidates: int, id_: str = "id", vector: str = "embedding", tenant_col: str = "tenant_id") -> DataFrame:
    """What an index without the tenant in it returns: the nearest `candidates` of all tenants, then the tenant's, then k."""
    near = top_k(rows.select(id_, vector, tenant_col).withColumn("_id", F.struct(id_, tenant_col)), query, candidates, "_id", vector)
    return near.select(F.col(f"_id.{id_}").alias(id_), F.col(f"_id.{tenant_col}").alias("_t"), "distance").where(F.col("_t") == tenant).drop("_t").orderBy(F.col("distance").asc_nulls_last(), id_).limit(k)
