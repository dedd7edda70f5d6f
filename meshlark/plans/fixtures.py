"""Particle tables made from the driver's tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..group import Group
from ..mesh import CartesianMesh
from ..spec import INT, Prop, Spec

MESH = CartesianMesh((30, 24))
SPEC = Spec((Prop("P", 2, positions=True), Prop("V", 2), Prop("Q"), Prop("W", 1, INT), Prop("SPECIES", 1, INT), Prop("USER", 1, INT)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as particles: day and hour are the position."""
    e = table(spark, sf_dir, "events")
    seconds = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    i = F.col("event_id")
    return e.select(
        i.alias("id"),
        (day + seconds / F.lit(86400.0)).alias("P_0"),
        (seconds / F.lit(3600.0)).alias("P_1"),
        ((i % 7 - 3).cast("double") * F.lit(0.25)).alias("V_0"),
        ((i % 5 - 2).cast("double") * F.lit(0.5)).alias("V_1"),
        F.col("value").alias("Q_0"),
        (F.col("value") * F.lit(100.0)).cast("bigint").alias("W_0"),
        (F.ascii("event_type") % 4).cast("bigint").alias("SPECIES_0"),
        F.col("user_id").cast("bigint").alias("USER_0"),
    )


def events(spark: SparkSession, sf_dir: str) -> Group:
    rows = event_rows(spark, sf_dir).withColumn("cell", MESH.cell([F.col("P_0"), F.col("P_1")]))
    return Group.of(rows, SPEC, MESH, check_cells=False)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a 32 x 16 mesh."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 32).cast("double") + 0.5).alias("P_0"), ((F.col("o_custkey") % 16).cast("double") + 0.5).alias("P_1"), (F.col("o_totalprice") * F.lit(100.0)).cast("bigint").alias("W_0"), (F.col("o_orderkey") % 32 + F.col("o_custkey") % 16 * 32).alias("cell"))


def cell_sql(x: str, y: str, nx: int = 30, ny: int = 24, w: float = 1.0) -> str:
    one = lambda v, n: f"least(greatest(CAST(trunc(({v}) * {1.0 / w}::DOUBLE) AS BIGINT), 0), {n - 1})"
    return f"({one(x, nx)} + {nx} * {one(y, ny)})"


_SECONDS = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE)"
EV = f"""
WITH raw AS (
  SELECT event_id AS id,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) + {_SECONDS} / 86400::DOUBLE AS P_0,
    {_SECONDS} / 3600::DOUBLE AS P_1,
    CAST(event_id % 7 - 3 AS DOUBLE) * 0.25::DOUBLE AS V_0,
    CAST(event_id % 5 - 2 AS DOUBLE) * 0.5::DOUBLE AS V_1,
    value AS Q_0,
    CAST(trunc(value * 100::DOUBLE) AS BIGINT) AS W_0,
    CAST(ascii(event_type) % 4 AS BIGINT) AS SPECIES_0,
    CAST(user_id AS BIGINT) AS USER_0
  FROM events),
ev AS (SELECT *, {cell_sql('P_0', 'P_1')} AS cell FROM raw),
lay AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id) - 1 AS layer FROM ev)
"""
OR = """
WITH ord AS (SELECT o_orderkey AS id, CAST(o_orderkey % 32 AS DOUBLE) + 0.5 AS P_0, CAST(o_custkey % 16 AS DOUBLE) + 0.5 AS P_1,
  CAST(trunc(o_totalprice * 100::DOUBLE) AS BIGINT) AS W_0, o_orderkey % 32 + o_custkey % 16 * 32 AS cell FROM orders)
"""


def draw_sql(seed: int, step: int, row: str | list[str], comp: int = 0) -> str:
    """The same draw in SQL; rows are not negative."""
    rows = row if isinstance(row, list) else [row]
    keys = iter(rng.constants(seed, step, comp, 3 * len(rows) + 2 * rng.ROUNDS))
    m, low = rng.MODULUS, (1 << rng.PART_BITS) - 1
    x = " + ".join(f"{part} * {next(keys)} % {m}" for r in rows for part in (f"(CAST({r} AS BIGINT) & {low})", f"((CAST({r} AS BIGINT) >> {rng.PART_BITS}) & {low})", f"((CAST({r} AS BIGINT) >> {2 * rng.PART_BITS}) % {m})"))
    x = f"({x})"
    for _ in range(rng.ROUNDS):
        x = f"(({x} % {m} * {next(keys)} + {next(keys)}) % {m})"
        x = f"({x} * ({x} % 65536 + 1) % {m})"
    return x


def uniform_sql(seed: int, step: int, row: str | list[str], comp: int = 0) -> str:
    return f"(CAST({draw_sql(seed, step, row, comp)} AS DOUBLE) / 2147483647::DOUBLE)"
