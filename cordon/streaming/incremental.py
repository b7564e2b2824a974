"""New document files as a stream: chunked as they come, or all that have come since the last run.

The reference model has no streams; this is the incremental form of its ingest, with Spark's
checkpoint in the place of the cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunked


def document_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of documents in a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, text: str = "text", once: bool = True) -> StreamingQuery:
    """Appends the documents' chunks to Parquet files; once: what is there now, then stop. Exactly once across restarts."""
    writer = chunked(docs, text).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_latency(events: DataFrame, ts: str = "ts", stage: str = "event_type", value: str = "value", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and maximum by window and stage; events later than `late` behind the latest are left out when streamed."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window), stage).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
