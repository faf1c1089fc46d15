"""Outcome rates maintained incrementally over an append-only event stream.

The batch operators (period rate A12, segment rate A4) are aggregations, so the same
semantics run under Structured Streaming: event-time windows replace ``trunc`` and a
watermark bounds the state kept for late rows. Output rows are emitted once a window closes
(append mode), so a downstream table holds exactly the batch result for closed periods.
Checkpoints go under the session's shared ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir


def windowed_rates(events: DataFrame, time_col: str, y: str = "y", window: str = "1 day",
                   watermark: str = "1 day", seg: list[str] | None = None) -> DataFrame:
    """(window_start, seg.., n, positives, rate) per event-time window, NULL time/target dropped."""
    seg = seg or []
    # event time must be TIMESTAMP for watermarks (NTZ values keep their wall clock in UTC)
    base = events.where(F.col(time_col).isNotNull() & F.col(y).isNotNull()) \
        .withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, watermark)
    agg = base.groupBy(F.window(time_col, window).alias("w"), *seg).agg(
        F.count(y).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    return agg.select(F.col("w.start").alias("window_start"), *seg, "n", "positives",
                      (F.col("positives") / F.col("n")).alias("rate"))


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A driver table as a file stream (schema taken from the batch reader)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def start_to_memory(df: DataFrame, query_name: str, output_mode: str = "append") -> StreamingQuery:
    """Run ``df`` once over everything available (availableNow) into an in-memory table."""
    spark = df.sparkSession
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", query_name)
    return (df.writeStream.outputMode(output_mode).format("memory").queryName(query_name)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
