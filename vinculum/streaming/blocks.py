"""Structured Streaming over a folder of passage files (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vinculum.sources.blocks import lines_of, passages


def stream_passages(spark: SparkSession, folder: str, out: str, state: str, delimiter: str = "|") -> StreamingQuery:
    """Files that arrive in `folder` come out as rows under `out`/rows and problems under `out`/problems.

    Each file is read once, whole; a batch that is run again after a failure overwrites its own folder.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), "value")

    def load(batch: DataFrame, number: int) -> None:
        rows, told = passages(lines_of(batch, "path", "value"), delimiter)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        told.write.mode("overwrite").parquet(f"{out}/problems/batch={number}")

    return files.writeStream.foreachBatch(load).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a timestamped stream (ts, event_type) by tumbling window, rows later than `late` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
