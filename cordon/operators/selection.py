"""Values at given ranks of groups of any size, exactly, by repeated range counts.

A pass cuts the range that holds a rank into 4,096 parts and counts each, so a shuffle carries counts only; the part with
the rank, from its least value to its largest, is the next range. It ends when a range is one value, after two or
three passes as a rule. No group is gathered or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 4096


def _part() -> Column:
    """The number of a value's part in its range; infinite values and NaN, the largest, are parts of their own."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    special = F.when(F.isnan(v), 3).when(v == float("inf"), 2).when(v == float("-inf"), 0).otherwise(1)
    even = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * PARTS)  # halves don't overflow
    return F.when(F.isnan(hi) | (hi == float("inf")) | (lo == float("-inf")), special).otherwise(even).cast("long")


def at_ranks(rows: DataFrame, group: str | None, value: str, ranks: Mapping[str, Callable[[Column], Column]], rounds: int = 300) -> DataFrame:
    """group, n, and a double for each entry of `ranks`: the value at the rank (from 0, of n) that it gives.

    Nulls among the values don't count; a null group is a group; without a group there is one row, or none if no value is there.
    """
    key = F.lit(None).cast("string") if group is None else F.col(group)
    values = rows.where(F.col(value).isNotNull()).select(F.struct(key.alias("k")).alias("g"), F.col(value).cast("double").alias("v"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank")) for name, f in ranks.items()))
    sizes = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = sizes.select("g", "n", "lo", "hi", F.explode(wanted).alias("x")).select("g", "n", "x.name", "x.rank", "lo", "hi").checkpoint()
    for _ in range(rounds):
        going = state.where("lo < hi")
        if going.isEmpty():
            break
        counts = values.join(going, "g").where("v >= lo and v <= hi").groupBy("g", "n", "name", "rank", _part().alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "name").orderBy("part"))
        found = counts.withColumn("upto", upto).where("upto > rank and upto - c <= rank")
        state = state.where("not lo < hi").unionByName(found.select("g", "n", "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi")).checkpoint()
    else:
        raise RuntimeError("ranges did not close")
    out = state.groupBy("g").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks))
    return out.select(*([F.col("g.k").alias(group)] if group else []), "n", *ranks)


def nearest_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.bround(F.lit(p) * (n - 1))


def middle(lower: bool) -> Callable[[Column], Column]:
    """The two ranks whose mean is the median."""
    return lambda n: F.floor((n - 1) / 2) if lower else F.floor(n / 2)
