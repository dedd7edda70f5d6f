"""Streams of particle rows: windowed sums with watermarks, values seen for the first time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def windowed(df: DataFrame, time: str, late: str, length: str, keys: list[Column], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows: rows later than the watermark allows are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = df.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in out.columns if c != "window"))


def sessions(df: DataFrame, time: str, late: str, gap: str, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """Windows that end after a gap without rows of the key."""
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in out.columns if c != "window"))


def unseen(df: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """First rows of each key; with a watermark the memory of keys is bounded by it."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else df.dropDuplicates(keys)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and writes Parquet; exactly once by its checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what is there now, a function for each micro-batch."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
