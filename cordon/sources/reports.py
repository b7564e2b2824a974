"""Reports: small results as one JSON file or as tables of one Markdown file, written through Spark's file systems."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MOST = 10_000  # rows of a report's table


class TooLarge(ValueError):
    """A report is read by people; write larger results as a table."""


def rows_of(df: DataFrame, most: int = MOST) -> list[dict]:
    """The rows, if they are few enough for a report; nothing is cut off silently."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, values: Mapping[str, DataFrame | object], most: int = MOST) -> None:
    """One object: DataFrames become lists of objects, anything else is taken as it is; dates and decimals are written as text."""
    found = {k: rows_of(v, most) if isinstance(v, DataFrame) else v for k, v in values.items()}
    write_text(spark, path, json.dumps(found, indent=2, ensure_ascii=False, default=str) + "\n")


def _cell(value: object) -> str:
    if value is None:
        return ""
    text = f"{value:.6g}" if isinstance(value, float) else str(value)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, most: int = MOST) -> str:
    lines = ["| " + " | ".join(map(_cell, df.columns)) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r[c]) for c in df.columns) + " |" for r in rows_of(df, most)])


def write_markdown(spark: SparkSession, path: str, title: str, parts: Mapping[str, DataFrame | str], most: int = MOST) -> None:
    """A heading, and for each part a heading with a paragraph or a table."""
    body = [f"# {title}"]
    for name, part in parts.items():
        body += [f"## {name}", markdown_table(part, most) if isinstance(part, DataFrame) else part]
    write_text(spark, path, "\n\n".join(body) + "\n")
