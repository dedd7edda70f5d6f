"""Generated rows: uniform in boxes and cells, normal velocities, numbers of rows for a density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..mesh import CartesianMesh, unlinear


def uniform_within_extents(spark: SparkSession, n: int, extents: list[float], seed: int) -> DataFrame:
    """(id, P_0..): n rows, uniform in the box from zero."""
    return spark.range(n).select("id", *((rng.uniform(seed, 0, F.col("id"), k) * F.lit(e)).alias(f"P_{k}") for k, e in enumerate(extents)))


def normal_rows(spark: SparkSession, n: int, ndim: int, mean: float, sigma: float, seed: int) -> DataFrame:
    """(id, V_0..): n rows of normal draws."""
    return spark.range(n).select("id", *(rng.normal(seed, 1, F.col("id"), k, mean, sigma).alias(f"V_{k}") for k in range(ndim)))


def uniform_within_cells(spark: SparkSession, mesh: CartesianMesh, per_cell: int, seed: int) -> DataFrame:
    """(id, cell, P_0..): the same number of rows in every cell, uniform inside it."""
    rows = spark.range(mesh.ncells * per_cell).withColumn("cell", F.floor(F.col("id") / per_cell).cast("bigint"))
    at = unlinear(F.col("cell"), mesh.fine_dims)
    return rows.select("id", "cell", *(((at[k] + rng.uniform(seed, 2, F.col("id"), k)) * F.lit(mesh.fine_width)).alias(f"P_{k}") for k in range(mesh.ndim)))


def counts_for_density(cells: DataFrame, weight: float) -> DataFrame:
    """(cell, n): rows of one weight that represent a density: round(max(average * volume, 0) / weight), halves up."""
    return cells.select("cell", F.floor(F.greatest(F.col("average") * F.col("volume"), F.lit(0.0)) / F.lit(weight) + F.lit(0.5)).cast("bigint").alias("n"))


def expand(counts: DataFrame) -> DataFrame:
    """(cell, k): a row for each of n."""
    return counts.where("n > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
