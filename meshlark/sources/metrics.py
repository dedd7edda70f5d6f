"""Times, row and byte counts of a program's regions, their export and conversion."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..spec import Spec


class Regions:
    """Named regions of a program with times and, for observed tables, rows and bytes."""

    def __init__(self):
        self.events: list[dict] = []
        self.level = 0

    @contextmanager
    def region(self, group: str, name: str) -> Iterator[None]:
        """Times what runs inside; regions nest."""
        event = {"key1": group, "key2": name, "start": time.time(), "level": self.level, "row_bytes": 0, "row_flops": 0}
        self.events.append(event)
        self.level += 1
        try:
            yield
        finally:
            self.level -= 1
            event["end"] = time.time()

    def observe(self, df: DataFrame, group: str, name: str, spec: Spec, flops_per_row: int = 0) -> DataFrame:
        """df, which reports its rows to this region when an action runs on it."""
        seen = Observation(f"{group}-{name}-{len(self.events)}")
        self.events.append({"key1": group, "key2": name, "start": time.time(), "level": self.level, "seen": seen, "row_bytes": spec.row_bytes, "row_flops": flops_per_row})
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[dict]:
        """One dict a region: key1, key2, start, end, level, rows, bytes, flops. Waits for each observed table's action."""
        out = []
        for e in self.events:
            n = e["seen"].get["rows"] if "seen" in e else 0
            e.setdefault("end", time.time())
            out.append({**{k: e[k] for k in ("key1", "key2", "start", "end", "level")}, "rows": n, "bytes": n * e["row_bytes"], "flops": n * e["row_flops"]})
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The regions as rows."""
        return spark.createDataFrame(self.rows(), "key1 string, key2 string, start double, end double, level long, rows long, bytes long, flops long")

    def json(self, rank: int = 0) -> str:
        """A profile: rank, events by name, and an array (key1, key2, start, end, level, bytes, flops) for each region."""
        rows = self.rows()
        return json.dumps({"rank": rank, "events": rows, "regions": [[r[k] for k in ("key1", "key2", "start", "end", "level", "bytes", "flops")] for r in rows]})


def trace_events(spark: SparkSession, path: str, start: float = float("-inf"), end: float = float("inf")) -> DataFrame:
    """Trace events (name, cat, ph, ts, dur, pid, tid; microseconds) of the regions of profiles that lie within a window of seconds."""
    found = spark.read.schema("rank long, regions array<array<string>>").json(path).select("rank", F.explode("regions").alias("r"))
    number = lambda k: F.element_at("r", k).cast("double")
    kept = found.select("rank", F.concat(F.element_at("r", 1), F.lit(":"), F.element_at("r", 2)).alias("name"), number(3).alias("a"), number(4).alias("b")).where((F.col("a") >= start) & (F.col("b") <= end))
    return kept.select("name", F.lit("PERF").alias("cat"), F.lit("X").alias("ph"), (F.col("a") * 1e6).alias("ts"), F.greatest(F.lit(1.0), F.col("b") * 1e6 - F.col("a") * 1e6).alias("dur"), F.col("rank").alias("pid"), F.col("rank").alias("tid"))
