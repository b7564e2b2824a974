"""What a query's physical plan reads and does."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def scans(df: DataFrame) -> list[dict[str, str]]:
    """Each file scan: location, pushed filters, partition filters, schema read."""
    out = []
    for block in re.split(r"\n\n+", plan_text(df)):
        if re.match(r"\(\d+\) (Scan|BatchScan|Location)", block):
            get = lambda k, b=block: (re.search(rf"^{k}: (.*)$", b, re.M) or ["", ""])[1]
            out.append({"node": block.splitlines()[0], "location": get("Location"), "pushed": get("PushedFilters"), "partitions": get("PartitionFilters"), "schema": get("ReadSchema")})
    return out


def count_nodes(df: DataFrame, name: str) -> int:
    """How often a node occurs, such as Exchange or BroadcastHashJoin."""
    tree = plan_text(df).split("\n\n")[0]
    return len(re.findall(rf"[\s*+-]{name} \(", tree))


def leaf(df: DataFrame) -> str:
    """The scan that the plan's first branch ends in."""
    lines = [x for x in plan_text(df).split("\n\n")[0].splitlines() if re.search(r"\(\d+\)\s*$", x)]
    path = []
    for x in lines:
        depth = len(x) - len(x.lstrip(" :+-*"))
        if path and depth <= path[-1][0]:
            break
        path.append((depth, x))
    return re.sub(r"^[\s:+*-]+|\s*\(\d+\)\s*$", "", path[-1][1]) if path else ""


class settings:
    """Session settings for a block of code, put back at its end."""

    def __init__(self, spark: SparkSession, **values: str):
        self.spark, self.values = spark, {k.replace("__", "."): v for k, v in values.items()}

    def __enter__(self) -> SparkSession:
        self.old = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)
        return self.spark

    def __exit__(self, *_: object) -> None:
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
