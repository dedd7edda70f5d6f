"""Trajectories as Parquet, a partition a step, with flat component columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Spec

#: Names of positions in a trajectory, whatever they are called in the group.
AXES = ("x", "y", "z")


class Trajectory:
    """Appends steps below a folder that all executors can write to; reads them with an explicit spec."""

    def __init__(self, path: str, spec: Spec, names: list[str] | None = None):
        self.path, self.next = path, 0
        self.spec = Spec(tuple(p for p in spec.props if p.positions or names is None or p.name in names))

    def _names(self) -> dict[str, str]:
        p = self.spec.positions
        return dict(zip(p.columns, AXES))

    def write(self, df: DataFrame, step: int | None = None) -> int:
        """Writes one step (the next one unless given) and returns its number."""
        step = self.next if step is None else step
        self.next = step + 1
        names = self._names()
        rows = df.select(*(F.col(c).alias(names.get(c, c)) for c in self.spec.columns))
        rows.write.mode("overwrite").parquet(f"{self.path}/step={step}")
        return step

    def schema(self) -> T.StructType:
        names = self._names()
        return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in self.spec.struct()])

    def read(self, spark: SparkSession, step: int | None = None, xyz: bool = False) -> DataFrame:
        """All steps, or one by partition pruning; positions under their own names unless xyz."""
        df = spark.read.schema(self.schema().add("step", T.LongType())).option("basePath", self.path).parquet(self.path)
        if step is not None:
            df = df.where(F.col("step") == step)
        if xyz:
            return df
        back = {v: k for k, v in self._names().items()}
        return df.select(*(F.col(c).alias(back.get(c, c)) for c in df.columns))


def as_arrays(df: DataFrame, spec: Spec) -> DataFrame:
    """One array column a property instead of a column a component."""
    return df.select(*(c for c in df.columns if c not in spec.columns), *(F.array(*p.columns).alias(p.name) for p in spec.props))


def from_arrays(df: DataFrame, spec: Spec) -> DataFrame:
    """The reverse of as_arrays()."""
    names = [p.name for p in spec.props]
    return df.select(*(c for c in df.columns if c not in names), *(F.element_at(p.name, k + 1).alias(c) for p in spec.props for k, c in enumerate(p.columns)))
