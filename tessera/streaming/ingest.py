"""A stream of arriving files: deduplicated by content within a watermark, chunked, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compile as C


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)


def fresh(rows: DataFrame, text: str = "text", at: str = "arrived_at", delay: str = "1 hour") -> DataFrame:
    """Rows whose content hasn't arrived within the delay; state is one hash per content and delay."""
    hashed = rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])


def chunk_into(rows: DataFrame, key: str, text: str, out: str, checkpoint: str):
    """Starts the query that appends the chunks of every row to a parquet folder, once each by the checkpoint."""
    return C.chunked(rows, key, text).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window start, kind, n, total of values, late rows within the delay included."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
