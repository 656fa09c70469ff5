"""Structured-streaming forms of the engine's append-only inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 64, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def windowed(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and totals per window and key; rows later than the watermark are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        events.withWatermark(time, late)
        .groupBy(w.alias("w"), by)
        .agg(F.count("*").alias("n_events"), F.round(F.sum(value), 2).alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n_events", "total")
    )


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per key: closed by a gap without events."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), by)
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n_events")
    )


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run over what is there now; each micro-batch goes to ``sink(df, batch_id)``, which must take a repeated batch id."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now to a Parquet folder, exactly once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
