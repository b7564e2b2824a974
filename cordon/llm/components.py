"""Connected components by alternating large-star and small-star steps.

Each step replaces links by links to smaller nodes; a step's shuffles carry one row per link, and
the minimum per node is aggregated before the shuffle, so a hub costs no more than its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b), both of one orderable type -> (node, component) for each node with a link, itself included.

    component is the smallest node reachable. Nulls, self links and repeated links are ignored;
    no links give an empty table. `rounds` only guards against an endless loop: the number of
    rounds needed grows with the logarithm of the nodes, and reaching it raises.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(links.where("a is not null and b is not null and a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
