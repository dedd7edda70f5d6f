"""Quadrature points: values set and read by the order in which points were added."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import CartesianMesh


@dataclass(frozen=True)
class PointMapper:
    """Points (point_id, cell, x_0.., and the components that were set)."""

    df: DataFrame
    mesh: CartesianMesh

    @staticmethod
    def of(points: DataFrame, mesh: CartesianMesh) -> "PointMapper":
        """From (point_id, x_0..): each point gets its cell."""
        x = [F.col(f"x_{d}") for d in range(mesh.ndim)]
        return PointMapper(points.select("point_id", *x, mesh.cell(x).alias("cell")), mesh)

    def set(self, values: DataFrame, ncomp: int, name: str = "Q") -> "PointMapper":
        """Components value_0.. of (point_id, value_0..) become name_0..; a point without a value raises an error."""
        new = values.select("point_id", *(F.col(f"value_{k}").alias(f"{name}_{k}") for k in range(ncomp)), F.lit(True).alias("__set"))
        old = self.df.drop(*(f"{name}_{k}" for k in range(ncomp)))
        joined = old.join(new, "point_id", "left")
        ok = F.when(F.col("__set"), F.col(f"{name}_0")).otherwise(F.raise_error(F.lit("a point has no value")))
        return replace(self, df=joined.withColumn(f"{name}_0", ok).drop("__set"))

    def get(self, ncomp: int, name: str = "Q") -> DataFrame:
        """(point_id, value_0..) of what was set."""
        return self.df.select("point_id", *(F.col(f"{name}_{k}").alias(f"value_{k}") for k in range(ncomp)))

    def interpolate(self, functions: list, name: str = "Q") -> "PointMapper":
        """Sets component k to functions[k] of the position."""
        x: list[Column] = [F.col(f"x_{d}") for d in range(self.mesh.ndim)]
        return replace(self, df=self.df.withColumns({f"{name}_{k}": f(*x) for k, f in enumerate(functions)}))

    def from_cells(self, dofs: DataFrame, name: str = "Q") -> "PointMapper":
        """Every point takes its cell's dof_0.. ."""
        ks = [c[4:] for c in dofs.columns if c.startswith("dof_")]
        old = self.df.drop(*(f"{name}_{k}" for k in ks))
        return replace(self, df=old.join(dofs.select("cell", *(F.col(f"dof_{k}").alias(f"{name}_{k}") for k in ks)), "cell"))

    def to_cells(self, ncomp: int, vertex: Column, name: str = "Q") -> DataFrame:
        """(cell, dof_0..) from the points for which `vertex` holds, one per cell."""
        return self.df.where(vertex).groupBy("cell").agg(*(F.first(f"{name}_{k}").alias(f"dof_{k}") for k in range(ncomp)))
