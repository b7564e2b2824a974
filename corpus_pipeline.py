"""A corpus from raw documents to token ids in five stages, each on all that the one before kept.

language: documents whose language cannot be told (no text, no letter) go.
exact: of equal texts the smallest doc_id stays.
near: of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, one of each component stays.
mix: sources are taken to their target weights; a document taken twice is two rows, one cut by a block keeps the words taken.
tokens: byte-level BPE; doc_id, lang, source, n_tokens, ids.

Nulls, empty texts and repeated rows go as the operators define. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from cordon.llm.queries import definition
from cordon.llm.store import fresh, numbered, scratch, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are `und`; the others keep their columns."""
    model = language_id.LanguageModel.fit(docs)
    mark = fresh(docs, "_id_")
    return language_id.identified(docs, model, prefix=mark).where(F.col(f"{mark}lang_pred") != "und").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row with the smallest doc_id (null last; of equal ones, the first read); rows are told apart by their place, not by doc_id."""
    rows, row = numbered(docs)
    with scratch(spark):
        mark = fresh(rows, "_order")
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
        found = jaccard_join.near_components(rows.withColumn(mark, order), n=5, percent=80, key=mark)
        gone = written(found.where("_key <> component_id").select(F.col("_key.row").alias("_gone")), "near-copies", outer=True)
    return rows.join(gone, F.col(row) == F.col("_gone"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mixed(docs, weights=(3, 1, 2), share=1.5)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), definition("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: The stages learn, draw and encode, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
    return docs
