"""Tables written to the folder that driver and executors share, and what joins and numbers their rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for deleting the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Nodes of plans that hand on a file's rows one by one, so that file and position name them.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one if Spark runs in one process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='cordon-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in the block are deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: a lost executor costs no recomputation.

    Within scratch() the table is removed at the block's end, with `outer` at the end of the block around it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    scopes = _scopes.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at the block's end the tables that written() made in it. What leaves the block must not need them."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column that names each row, and that column's name: a hash of its file's path, and the row's position there.

    Holds for files as they are read, whatever their splits; any other plan is written first.
    """
    column = fresh(df, "_row")

    def name(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")).alias(column))

    if _rowwise(df._jdf.queryExecution().analyzed()):
        try:
            return name(df), column
        except AnalysisException:  # a format without positions
            pass
    return name(written(df, "rows")), column


def _rowwise(plan) -> bool:
    below = plan.children()
    return plan.nodeName() in _ROWWISE and all(_rowwise(below.apply(i)) for i in range(below.size()))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote itself."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of df's."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with a table of one row per key and the key's number of rows in `size`.

    Keys with more than a 10,000th of `total` rows are at most 10,000: these are broadcast, so that a key with
    a large share of the rows does not meet in one task; all others are joined by their hash.
    """
    least = max(1000, total // 10_000)
    value = [c for c in table.columns if c not in (key, "size")]
    large = F.broadcast(table.where(F.col("size") > least).select(F.col(key).alias("_l"), *(F.col(c).alias(f"_l_{c}") for c in value)))
    both = rows.join(large, F.col(key) == F.col("_l"), "left")
    hot = both.where("_l is not null").select(*rows.columns, *(F.col(f"_l_{c}").alias(c) for c in value))
    rest = both.where("_l is null").select(*rows.columns).join(table.where(F.col("size") <= least).drop("size"), key)
    return hot.unionByName(rest.select(*hot.columns))
