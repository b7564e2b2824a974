"""A Bloom filter of hashes that occur at least twice, built by Spark and tested in numpy.

Its size is a parameter: 2**log2_bits bits (default 16 MB), whatever the input, which bounds what is
collected and broadcast. Overfilled, it passes more than it need, which costs time and no results.
"""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shuffles_removed

BLOCK = 15  # log2 of the bits of one bitmap of Spark's


def bloom(hashes: DataFrame, column: str, log2_bits: int = 27) -> Broadcast:
    """A filter of well-mixed 64-bit hashes: bits at their highest and their lowest bits."""
    spark = hashes.sparkSession
    size, h = 1 << log2_bits, F.col(column)
    places = F.array(F.shiftrightunsigned(h, 64 - log2_bits), h.bitwiseAND(F.lit(size - 1)))
    bits = hashes.select(F.explode(places).alias("p")).select(F.shiftrightunsigned("p", BLOCK).alias("b"), F.col("p").bitwiseAND(F.lit((1 << BLOCK) - 1)).alias("p"))
    out = np.zeros(size >> 3, np.uint8)
    with shuffles_removed(spark):
        rows = bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()  # 4 KB each, 2**log2_bits bits in all
    for r in rows:
        out[r["b"] << (BLOCK - 3) : (r["b"] + 1) << (BLOCK - 3)] = np.frombuffer(r["m"], np.uint8)
    return spark.sparkContext.broadcast(out)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    log2_bits = len(bits).bit_length() + 2
    out = np.ones(len(h), bool)
    for p in (h >> np.uint64(64 - log2_bits), h & np.uint64((1 << log2_bits) - 1)):
        out &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
