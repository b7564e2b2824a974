"""Generated data: skewed vector tables and a corpus of four template families.

Everything depends on row numbers and a seed alone, so lost partitions come back the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import chunk_id, random_vector

#: Documents of each tenant by category.
SHAPE = {
    "acme": {"contracts": 8, "rate_sheets": 12, "sops": 9, "shipments": 13},
    "globex": {"contracts": 7, "rate_sheets": 11, "sops": 8, "shipments": 12},
    "meridian": {"contracts": 6, "rate_sheets": 10, "sops": 7, "shipments": 8},
}


def skewed_chunks(spark: SparkSession, counts: Mapping[str, int], dim: int = 1536, seed: int = 1, model: str = "synthetic") -> DataFrame:
    """Chunk rows with uniform vectors, one document per chunk, so many of each tenant."""
    bounds, total, tenant = [], 0, F.lit(None).cast("string")
    for name, n in counts.items():
        total += n
        bounds.append((name, total))
    for name, end in reversed(bounds):
        tenant = F.when(F.col("n") < end, name).otherwise(tenant)
    rows = spark.range(total).withColumnRenamed("id", "n").withColumn("tenant_id", tenant)
    doc = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("n").cast("string")))
    return rows.select(
        chunk_id(doc, F.lit(0)).alias("id"), "tenant_id", doc.alias("document_id"), F.lit(0).alias("chunk_index"), F.format_string("synthetic chunk %d", "n").alias("content"),
        random_vector(dim, seed, F.col("n")).alias("embedding"), F.lit(model).alias("embed_model"), F.lit(dim).alias("embed_dim"), F.lit(12).alias("token_count"),
    )


def _body(category: str, n: Column, tenant: Column) -> Column:
    """A text of the family; values cycle with the document's number."""
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), F.pmod(n, F.lit(len(items))).cast("int") + 1)
    lines: Sequence[Column]
    if category == "contracts":
        lines = [F.format_string("SERVICE CONTRACT NO. %02d", n), F.lit(""), F.lit("Effective Date: 2024-01-01"), F.concat(F.lit("Parties: "), tenant, F.lit(" and the client")), F.lit(""), F.lit("TERM: 24 months"), F.lit("Either side may end it in writing. Notice takes thirty days.")]
    elif category == "rate_sheets":
        rows = [F.format_string(f"  Zone {z}: $%.2f a pound", (F.lit(base) + F.pmod(n, F.lit(7)) * 0.05).cast("double")) for z, base in (("A", 0.8), ("B", 0.95), ("C", 1.1))]
        lines = [F.format_string("RATE SHEET %03d", n), F.lit(""), F.concat(F.lit("Kind: "), pick(["ground", "fuel", "air", "heavy", "sea"])), F.lit(""), F.lit("RATES BY ZONE"), F.lit("Prices hold for a month:"), *rows, F.lit(""), F.lit("Surcharges are listed apart.")]
    elif category == "sops":
        lines = [F.concat(F.lit("PROCEDURE: "), pick(["claims", "waiting time", "dangerous goods", "cold chain", "customs"])), F.lit(""), F.format_string("SOP ID: SOP-%03d", n), F.lit(""), F.lit("STEPS"), F.lit("1. The driver reports on arrival."), F.lit("2. The clerk confirms the time."), F.lit("- Exceptions need a signature")]
    else:
        day = F.date_format(F.date_add(F.lit("2024-08-15").cast("date"), F.pmod(n, F.lit(30)).cast("int")), "yyyy-MM-dd")
        lines = [F.lit("DELIVERY NOTE"), F.lit(""), F.format_string("Shipment ID: SHP-%04d", n), F.concat(F.lit("Date: "), day), F.lit(""), F.lit("FREIGHT"), F.format_string("Weight: %d lbs", F.lit(300) + F.pmod(n * 50, F.lit(2000))), F.concat(F.lit("Driver: "), F.char(F.lit(65) + F.pmod(n, F.lit(26))), F.format_string(" %d", n + 100))]
    return F.concat_ws("\n", *lines)


def corpus(spark: SparkSession, shape: Mapping[str, Mapping[str, int]] = SHAPE) -> DataFrame:
    """relpath, tenant, category, stem, text of generated documents."""
    flat = [(t, c, k) for t, cs in shape.items() for c, k in cs.items()]
    rows = spark.createDataFrame(flat, "tenant string, category string, k int").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("k"))))
    stem = F.format_string("%s_%02d", F.regexp_replace("category", "s$", ""), "n")
    text = F.lit(None).cast("string")
    for c in ("contracts", "rate_sheets", "sops", "shipments"):
        text = F.when(F.col("category") == c, _body(c, F.col("n"), F.initcap("tenant"))).otherwise(text)
    return rows.select(F.concat(F.concat_ws("/", "tenant", "category", stem), F.lit(".txt")).alias("relpath"), "tenant", "category", stem.alias("stem"), text.alias("text"))
