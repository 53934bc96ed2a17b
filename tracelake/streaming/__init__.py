"""Continuous detection over arriving artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracelake.plans import rules


def unseen(artifacts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream's artifacts without those seen before, as far as the watermark reaches back."""
    timed = artifacts.withColumn("ts", F.to_timestamp("timestamp_utc")).withWatermark("ts", lateness)
    return timed.dropDuplicatesWithinWatermark(["dedup_key"]).drop("ts")


def detect_stream(artifacts: DataFrame, which: list[rules.Rule]) -> DataFrame:
    """Detections of a stream of artifacts; the batch rules' own predicates, no state."""
    return rules.detect(artifacts, which)


def counts_per_window(artifacts: DataFrame, keys: list[str], window: str, more_than: int, lateness: str = "1 hour") -> DataFrame:
    """Keys with more than so many artifacts in a tumbling window, once the watermark has passed it."""
    timed = artifacts.withColumn("ts", F.to_timestamp("timestamp_utc")).withWatermark("ts", lateness)
    by = timed.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return by.select(*keys, F.col("w.start").alias("window_start"), "n")


def write_detections(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends detections to a table, exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("case_id", "engine")
