"""Corpus trees of text files, JSON lines, and versioned snapshots of a tree."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import GOLDEN


def _texts(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """_file, text of each file; empty ones, which Spark lists but doesn't read, have an empty text."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = files.select(plain("path").alias("_file"), F.decode("content", "UTF-8").alias("text"))
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "f string").select(plain("f").alias("_file"))
    return read.unionByName(listed.join(files.select(plain("path").alias("_file")), "_file", "left_anti").withColumn("text", F.lit("")))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """relpath, tenant, category, stem, text of `<root>/<tenant>/<category>/<file>.txt`, each file whole."""
    parts = F.slice(F.split("_file", "/"), -3, 3)
    out = _texts(spark, f"{root.rstrip('/')}/*/*/*.txt")
    return out.select(F.array_join(parts, "/").alias("relpath"), parts[0].alias("tenant"), parts[1].alias("category"), F.regexp_replace(parts[2], r"\.txt$", "").alias("stem"), "text")


def document_text(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Adds text to rows by storage_key, a path below root unless it is absolute; files that aren't there leave it null."""
    full = F.when(F.col("storage_key").startswith("/"), F.col("storage_key")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("storage_key")))
    return keys.withColumn("_full", full).join(_texts(spark, root, recursiveFileLookup=True), F.col("_full") == F.col("_file"), "left").drop("_full", "_file")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str = GOLDEN) -> DataFrame:
    """One object per line that isn't blank, by a fixed schema."""
    return spark.read.schema(schema).json(path)


def save_snapshot(tree: DataFrame, path: str, version: str) -> str:
    """Keeps a corpus as it is now under a version, as a commit would; returns the snapshot's path."""
    target = f"{path.rstrip('/')}/version={version}"
    tree.write.mode("errorifexists").parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def inventory(tree: DataFrame) -> DataFrame:
    """Documents by tenant and category, with subtotals (null category) and the total (null tenant)."""
    return tree.rollup("tenant", "category").agg(F.count("*").alias("n"))
