"""Operator entry points: python -m cordon.cli {migrate|bootstrap|tenants|offboard TENANT|seed N|backfill} STORE."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .operators.ingest import offboard_tenant
from .operators.metrics import throughput
from .snapshot import Store
from .sources.synthetic import skewed_chunks
from .tenancy import TenantSession, UnscopedReader, demand_scoped


def bootstrap(store: Store) -> list[str]:
    """Makes sure that tenant handles are policy-bound: idempotent, and checked each time. Returns the policy-scoped tables."""
    own = TenantSession(store.spark, {t: store.reader(t) for t in store.schemas}).bind(None)
    demand_scoped(own)
    for t in store.schemas:
        if not own.table(t).isEmpty():
            raise RuntimeError(f"{t} shows rows without a claim")
    return sorted(store.schemas)


def tenants(store: Store) -> list[str]:
    reader = UnscopedReader(store.spark, {t: store.reader(t) for t in store.schemas})
    return [r[0] for r in reader.tenants().collect()]  # names, a row a tenant


def seed(store: Store, counts: dict[str, int], dim: int = 1536) -> float:
    """Bulk-loads synthetic chunks; returns rows a second."""
    began = time.time()
    store.load("chunks", skewed_chunks(store.spark, counts, dim))
    return throughput(sum(counts.values()), time.time() - began)


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("migrate", "bootstrap", "tenants", "offboard", "seed", "backfill") or (args[0] == "offboard") != (len(args) == 3) and args[0] != "seed":
        print(__doc__, file=sys.stderr)
        return 2
    if args[0] == "backfill":
        raise NotImplementedError("call cordon.operators.backfill.run_backfill with an embedding provider")
    store = Store(SparkSession.builder.getOrCreate(), args[-1])
    if args[0] == "migrate":
        print(*store.migrate({"0001_tables": lambda s: None}, tuple(store.schemas)))
    elif args[0] == "bootstrap":
        print(*bootstrap(store))
    elif args[0] == "tenants":
        print(*tenants(store), sep="\n")
    elif args[0] == "offboard":
        print(offboard_tenant(store, args[1]))
    else:
        print(f"{seed(store, {'small': 111, 'large': int(args[1])}):.0f} rows/s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
