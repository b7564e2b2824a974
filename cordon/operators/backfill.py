"""Second embeddings: resumable backfill, cutover, rollback and reads by the active model.

A batch takes the next rows by id after the cursor whose second vector is null, and commits vectors and
progress together. The first batch orders the tenant's parts by id, so that each batch rewrites a few batches' worth of rows,
whatever the tenant's size. An empty page completes the tenant; after that nothing is taken any more, so
rows that come later keep null vectors and fail the model check after a cutover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BackfillNotCompleteError
from ..schema import enforce
from ..snapshot import Store
from ..sources.embedding import Provider, embed, refuse_on_mismatch
from .ingest import handle, upsert

#: The active model's columns under common names.
ACTIVE = {"v1": ("embedding", "embed_model", "embed_dim"), "v2": ("embedding_v2", "embed_model_v2", "embed_dim_v2")}


def keyset_page(rows: DataFrame, cursor: str | int | None, limit: int, null: str = "embedding_v2", key: str = "id") -> DataFrame:
    """The next rows by key after the cursor (None: from the start) whose column `null` is null."""
    after = F.lit(True) if cursor is None else F.col(key) > F.lit(cursor)
    return rows.where(F.col(null).isNull() & after).orderBy(key).limit(limit)


def backfill_tenant(store: Store, tenant: str, provider: Provider, model: str, dim: int, batch: int = 1000) -> int:
    """One batch; returns the rows it embedded, from their bare content."""
    if store.read("progress", tenant=tenant).isEmpty() and store.parts("chunks", tenant):
        store.ranged("chunks", tenant, "id", 4 * batch)
    base = store.version()
    with handle(store, tenant, base) as own:
        now = own.table("progress").first()
        if now and now["status"] == "complete":
            return 0
        page = keyset_page(own.table("chunks"), now and now["last_chunk_id"], batch)
        done = embed(page.select("id", "content"), provider, model, dim, F.col("content"), "embedding_v2", ("embed_model_v2", "embed_dim_v2"))
        part = store.write_part("chunks", tenant, page.drop("embedding_v2", "embed_model_v2", "embed_dim_v2").join(done.drop("content"), "id"))
        new = store.read_parts("chunks", [part])  # embedded once
        n, last = new.agg(F.count("*"), F.max("id")).first()
        progress = store.read("progress", base, tenant=tenant)
        fresh = store.spark.createDataFrame([(tenant, last, n, "in_progress" if n else "complete")], "tenant_id string, last_chunk_id string, chunks_done int, status string").withColumn("updated_at", F.current_timestamp())
        parts = {}
        if n:
            enforce(new, "chunks", dim)
            merged = upsert(progress, fresh, "tenant_id", {"chunks_done": "o.chunks_done + n.chunks_done"})
            ids = new.select("id")
            rest = store.without("chunks", tenant, lambda rows: rows.join(ids, "id", "left_semi"), lambda rows: rows.join(ids, "id", "left_anti"), base)
            parts = {"chunks": {tenant: [*rest, part]}}
        else:
            merged = upsert(progress, fresh, "tenant_id", {"chunks_done": "o.chunks_done", "last_chunk_id": "o.last_chunk_id"})
        store.commit({"progress": {tenant: merged}}, base, parts=parts)
        return n


def run_backfill(store: Store, tenants: list[str], provider: Provider, model: str, dim: int, batch: int = 1000) -> dict[str, int]:
    """Each tenant to its end; rows embedded by tenant. Interrupted, it goes on from the last commit."""
    out = {}
    for tenant in tenants:
        out[tenant] = 0
        while n := backfill_tenant(store, tenant, provider, model, dim, batch):
            out[tenant] += n
    return out


def cutover_status(store: Store, tenant: str) -> str:
    """The tenant's active model; v1 where nothing was flipped."""
    with handle(store, tenant) as own:
        row = own.table("cutover").first()
        return row["active_model"] if row else "v1"


def _set_model(store: Store, tenant: str, model: str) -> int:
    new = store.spark.createDataFrame([(tenant, model)], "tenant_id string, active_model string").withColumns({"flipped_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    rows = upsert(store.read("cutover", tenant=tenant), new, "tenant_id", {})
    enforce(rows, "cutover")
    return store.commit({"cutover": {tenant: rows}})


def flip_to_v2(store: Store, tenant: str) -> int:
    with handle(store, tenant) as own:
        row = own.table("progress").first()
    if not row or row["status"] != "complete":
        raise BackfillNotCompleteError(f"{tenant}: {row['status'] if row else 'not begun'}")
    return _set_model(store, tenant, "v2")


def rollback_to_v1(store: Store, tenant: str) -> int:
    return _set_model(store, tenant, "v1")


def active_embeddings(chunks: DataFrame, cutover: DataFrame) -> DataFrame:
    """id, document_id and the active model's vector, model and dimension, tenant by tenant, in one plan over one version.

    The flags are a row a tenant; Spark broadcasts them if they are small enough and shuffles by tenant if not.
    """
    rows = chunks.join(cutover.select("tenant_id", "active_model"), "tenant_id", "left")
    second = F.col("active_model").eqNullSafe("v2")
    picked = (F.when(second, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(*ACTIVE.values()))
    return rows.select("tenant_id", "id", "document_id", *picked)


def fetch_active(store: Store, tenant: str, document_id: str, models: Callable[[str], tuple[str, int]]) -> DataFrame:
    """The document's active vectors, if all of them are of the model and dimension that `models` names for the active version."""
    with handle(store, tenant) as own:
        version = own.table("cutover").first()
        rows = active_embeddings(own.table("chunks").where(F.col("document_id") == document_id), own.table("cutover"))
        refuse_on_mismatch(rows, *models(version["active_model"] if version else "v1"))
        return rows
