"""Queries over the events as a stream, drained into Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams
from .catalog import query
from .rows import scratch


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    found = spark.read.parquet(path).inputFiles()
    whole_folder = len(found) != 1 or not found[0].rstrip("/").endswith("events.parquet")
    return streams.read(spark, path if whole_folder else sf_dir, schema, "*.parquet" if whole_folder else "events.parquet")


@query("SELECT user_id AS value FROM events GROUP BY user_id")
def s1_stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values seen for the first time, as a stream."""
    folder = scratch(spark)
    streams.drain(streams.unseen(_source(spark, sf_dir).select(F.col("user_id").alias("value")), ["value"]), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("value long").parquet(f"{folder}/out")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(trunc(value * 100::DOUBLE) AS BIGINT)) AS BIGINT) AS w FROM events GROUP BY ALL")
def s2_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows per event type in update mode; the last state of each window."""
    folder = scratch(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")  # days are those of the table's clock, whatever the session's zone
    rows = _source(spark, sf_dir).select(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone).alias("ts"), "event_type", (F.col("value") * F.lit(100.0)).cast("bigint").alias("w"))
    daily = streams.windowed(rows, "ts", "40 days", "1 day", [F.col("event_type")], [F.count("*").alias("n"), F.sum("w").alias("w")])
    streams.drain_batches(daily, lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
    states = spark.read.parquet(f"{folder}/out")
    last = states.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("w", "batch").alias("w"))
    return last.select(F.date_format(F.to_utc_timestamp("start", zone), "yyyy-MM-dd").alias("day"), "event_type", "n", "w")
