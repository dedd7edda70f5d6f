"""Row creation: descendants of rows, product matrices, defaults; stateful distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..group import BASE, Group
from ..spec import Spec


def descendants(parents: DataFrame, n: int, values: dict[str, list[Column]], enabled: list[Column], spec: Spec, parent_id: str = "id") -> DataFrame:
    """Up to n products of each parent: components in `values` are set, all others are the parent's.

    Only enabled products come out. Columns: id (null until added), cell, parent, product and the
    spec's columns.
    """
    made = []
    for k in range(n):
        fields = [(values[c][k] if c in values else F.col(c)).cast(dict(zip(spec.columns, [p.kind for p in spec.props for _ in p.columns]))[c]).alias(c) for c in spec.columns]
        made.append(F.struct(F.lit(k).alias("product"), F.coalesce(enabled[k], F.lit(False)).alias("__on"), *fields))
    out = parents.select(F.col(parent_id).alias("parent"), "cell", F.explode(F.array(*made)).alias("p")).where("p.`__on`")
    return out.select("parent", "cell", "p.product", *(F.col(f"p.{c}").alias(c) for c in spec.columns))


def numbered(products: DataFrame, n: int, first_id: int) -> DataFrame:
    """Products with ids that depend on parent and product alone."""
    return products.withColumn("id", F.lit(first_id) + F.col("parent") * F.lit(n) + F.col("product"))


def add_matrix(group: Group, rows: DataFrame, have: Spec, defaults: dict[str, float] | None = None) -> Group:
    """Appends staged rows: missing properties take their default or zero; one that the group lacks raises."""
    lacking = [p.name for p in have.props if p not in group.spec]
    if lacking:
        raise ValueError(f"the group has no {lacking}")
    return group.add(group.spec.align(rows, defaults, keep=BASE))


class Rows:
    """Staged product rows 0 to n - 1 with the typed components of a spec; every change returns new rows."""

    def __init__(self, table: DataFrame, spec: Spec):
        self.table, self.spec = table, spec
        self.kinds = {c: p.kind for p in spec.props for c in p.columns}

    @staticmethod
    def zeros(spark: SparkSession, n: int, spec: Spec) -> "Rows":
        rows = spark.range(n).withColumnRenamed("id", "row")
        return Rows(rows.select("row", *(F.lit(0).cast(p.kind).alias(c) for p in spec.props for c in p.columns)), spec)

    def _named(self, df: DataFrame) -> list[str]:
        names = [c for c in df.columns if c != "row"]
        if set(names) - set(self.kinds):
            raise KeyError(f"not in the spec: {sorted(set(names) - set(self.kinds))}")
        return names

    def _joined(self, new: DataFrame, names: list[str], value: Callable[[str, Column], Column]) -> "Rows":
        # a row outside the table raises, as an index outside an array would
        new = new.select("row", *(F.col(c).alias(f"__{c}") for c in names))
        out = self.table.withColumn("__known", F.lit(True)).join(new, "row", "full")
        row = F.when(F.col("__known"), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("no product row "), F.col("row").cast("string"))))
        return Rows(out.select(row.alias("row"), *((value(c, F.col(f"__{c}")) if c in names else F.col(c)).cast(k).alias(c) for c, k in self.kinds.items())), self.spec)

    def add(self, contributions: DataFrame) -> "Rows":
        """Adds all contributions (row, components...), any number to a row."""
        names = self._named(contributions)
        return self._joined(contributions.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)), names, lambda c, v: F.col(c) + F.coalesce(v, F.lit(0)))

    def write(self, values: DataFrame) -> "Rows":
        """Sets components of rows; one value a row at most."""
        return self._joined(values, self._named(values), lambda c, v: F.coalesce(v, F.col(c)))

    def read(self, df: DataFrame) -> DataFrame:
        """df with the components of its product row (column row)."""
        return df.join(self.table, "row", "left")


class Unseen:
    """Distinct values that were never given out before; those known are kept as a table."""

    def __init__(self):
        self.seen: DataFrame | None = None

    def extract(self, df: DataFrame, column: str) -> DataFrame:
        """New values of the column, remembered in a checkpoint so that lineage stays short."""
        new = df.select(F.col(column).alias("value")).distinct()
        if self.seen is not None:
            new = new.join(self.seen, "value", "left_anti")
        new = new.checkpoint()
        self.seen = new if self.seen is None else self.seen.union(new)
        return new
