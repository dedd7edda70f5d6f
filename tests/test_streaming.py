from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meshlark.streaming import streams

T0 = datetime(2024, 1, 1)


def feed(spark, folder, minutes, tail=True):
    """One file per batch; a last far row closes what came before it."""
    rows = [(k, T0 + timedelta(minutes=m), u, 1) for k, (m, u) in enumerate(minutes)]
    half = len(rows) // 2
    batches = [rows[:half], rows[half:]] + ([[(10**6, T0 + timedelta(days=30), "end", 0)]] if tail else [])
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "id long, ts timestamp, u string, v int").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return streams.read(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_trigger=1)


def test_windows_leave_out_nothing_within_the_watermark(spark, tmp_path):
    s = feed(spark, str(tmp_path), [(1, "a"), (4, "b"), (12, "a"), (3, "a"), (59, "b"), (61, "a")])
    streams.drain(streams.windowed(s, "ts", "2 days", "10 minutes", [F.col("u")], [F.count("*").alias("n")]), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {((r["start"] - T0).total_seconds() / 60, r["u"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a", 2), (0, "b", 1), (10, "a", 1), (50, "b", 1), (60, "a", 1)}


def test_sliding_windows(spark, tmp_path):
    s = feed(spark, str(tmp_path), [(1, "a"), (6, "a"), (7, "a"), (8, "a")])
    streams.drain(streams.windowed(s, "ts", "1 day", "10 minutes", [F.col("u")], [F.sum("v").alias("n")], "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {((r["start"] - T0).total_seconds() / 60, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").where("u = 'a'").collect()}
    assert got == {(-5, 1), (0, 4), (5, 3)}


def test_sessions(spark, tmp_path):
    s = feed(spark, str(tmp_path), [(0, "a"), (4, "a"), (30, "a"), (2, "b"), (33, "a"), (90, "b")])
    streams.drain(streams.sessions(s, "ts", "1 day", "10 minutes", [F.col("u")], [F.count("*").alias("n")]), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {((r["start"] - T0).total_seconds() / 60, (r["end"] - T0).total_seconds() / 60, r["u"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, 14, "a", 2), (30, 43, "a", 2), (2, 12, "b", 1), (90, 100, "b", 1)}


def test_first_seen_values(spark, tmp_path):
    s = feed(spark, str(tmp_path), [(0, "a"), (4, "a"), (30, "c"), (2, "b"), (33, "a"), (90, "b")], tail=False)
    streams.drain(streams.unseen(s.select("u", "ts"), ["u"], "ts", "2 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r["u"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_batches(spark, tmp_path):
    s, seen = feed(spark, str(tmp_path), [(0, "a"), (4, "a"), (30, "c")], tail=False), []
    streams.drain_batches(s.groupBy("u").count(), lambda df, k: seen.append({r["u"]: r["count"] for r in df.collect()}), f"{tmp_path}/state")
    assert {k: v for b in seen for k, v in b.items()}["a"] == 2
