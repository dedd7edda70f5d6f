"""Deposition onto meshes and evaluation at rows: constant per cell, barycentric, maps between meshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import triangle_weights


def project_constant(df: DataFrame, values: list[Column], volumes: DataFrame) -> DataFrame:
    """(cell, dof_k): sums over each cell's rows divided by its volume; zero in empty cells."""
    sums = df.groupBy("cell").agg(*(F.sum(v).alias(f"s_{k}") for k, v in enumerate(values)))
    return volumes.join(sums, "cell", "left").select("cell", *((F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) / F.col("volume")).alias(f"dof_{k}") for k in range(len(values))))


def evaluate_constant(df: DataFrame, dofs: DataFrame, name: str) -> DataFrame:
    """Adds name_k from the row's cell."""
    ks = [c[4:] for c in dofs.columns if c.startswith("dof_")]
    return df.join(dofs.select("cell", *(F.col(f"dof_{k}").alias(f"{name}_{k}") for k in ks)), "cell", "left")


def project_barycentric(df: DataFrame, corners: DataFrame, x: Column, y: Column, value: Column) -> DataFrame:
    """(cell, q_0, q_1, q_2): what each triangle corner receives, weighted by barycentric coordinates.

    corners: (cell, x_0, y_0 .. x_2, y_2, volume).
    """
    at = df.withColumns({"__x": x, "__y": y, "__v": value}).join(corners, "cell")
    w = triangle_weights([(F.col(f"x_{k}"), F.col(f"y_{k}")) for k in range(3)], F.col("__x"), F.col("__y"))
    return at.groupBy("cell").agg(*(F.sum(w[k] * F.col("__v")).alias(f"q_{k}") for k in range(3)))


def density_at(points: DataFrame, corner_values: DataFrame, corners: DataFrame, x: Column, y: Column, name: str = "density") -> DataFrame:
    """Density of a barycentric projection: vertices over volume, times the weighted corner values."""
    at = points.withColumns({"__x": x, "__y": y}).join(corners, "cell").join(corner_values, "cell")
    w = triangle_weights([(F.col(f"x_{k}"), F.col(f"y_{k}")) for k in range(3)], F.col("__x"), F.col("__y"))
    total = sum((w[k] * F.col(f"q_{k}") for k in range(3)), F.lit(0.0))
    return at.withColumn(name, F.lit(3.0) / F.col("volume") * total).select(*points.columns, name)


def evaluate_barycentric(df: DataFrame, corners: DataFrame, vertex_values: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    """Interpolates vertex values (cell, q_0, q_1, q_2) at rows."""
    at = df.withColumns({"__x": x, "__y": y}).join(corners, "cell").join(vertex_values, "cell")
    w = triangle_weights([(F.col(f"x_{k}"), F.col(f"y_{k}")) for k in range(3)], F.col("__x"), F.col("__y"))
    return at.withColumn(name, sum((w[k] * F.col(f"q_{k}") for k in range(3)), F.lit(0.0))).select(*df.columns, name)


def project_evaluate(space: str, order: int) -> tuple[Callable, Callable]:
    """(project, evaluate) of a function space: ("DG", 0) or ("Barycentric", 1)."""
    known = {("DG", 0): (project_constant, evaluate_constant), ("Barycentric", 1): (project_barycentric, evaluate_barycentric)}
    if (space, order) not in known:
        raise ValueError(f"no function space {space} of order {order}")
    return known[space, order]


def interpolate(points: DataFrame, functions: list[Callable[..., Column]], position: list[Column], name: str = "q") -> DataFrame:
    """Adds name_k = functions[k](position) at every point."""
    return points.withColumns({f"{name}_{k}": f(*position) for k, f in enumerate(functions)})


def couple(weights: DataFrame, values: DataFrame, source: str, target: str) -> DataFrame:
    """Sparse matrix times vector: (target, value) of weights (source, target, weight) and values (source, value)."""
    return weights.join(values, source).groupBy(target).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def to_external(dofs: DataFrame, index: DataFrame) -> DataFrame:
    """(external, value) by the map (cell, dof, external); the reverse joins on external."""
    return dofs.join(index, ["cell", "dof"]).select("external", "value")
