"""Arrays that rows read from, write to and add to: one- and N-dimensional, kept as tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import nd_index


@dataclass(frozen=True)
class NDArray:
    """(i, value) over the linear index, the last dimension fastest; every change returns a new array.

    There is one array for all tasks: what the local and the global kind hold differs only where
    a process has its own copy.
    """

    table: DataFrame
    shape: tuple[int, ...]

    @staticmethod
    def filled(spark: SparkSession, shape: tuple[int, ...], value: float = 0.0) -> "NDArray":
        size = 1
        for n in shape:
            size *= n
        return NDArray(spark.range(size).select(F.col("id").alias("i"), F.lit(value).alias("value")), shape)

    def _at(self, index: list[Column]) -> Column:
        inside = F.lit(True)
        for c, n in zip(index, self.shape):
            inside = inside & c.between(0, n - 1)
        return F.when(inside, nd_index(index, list(self.shape))).otherwise(F.raise_error(F.lit("index outside the array"))).cast("bigint")

    def fill(self, value: float) -> "NDArray":
        return replace(self, table=self.table.withColumn("value", F.lit(value)))

    def read(self, df: DataFrame, index: list[Column], name: str) -> DataFrame:
        """df with the element at each row's index."""
        return df.withColumn("__i", self._at(index)).join(self.table.select(F.col("i").alias("__i"), F.col("value").alias(name)), "__i").drop("__i")

    def add(self, df: DataFrame, index: list[Column], value: Column) -> "NDArray":
        """Sums over rows on top of what the array holds."""
        found = df.groupBy(self._at(index).alias("i")).agg(F.sum(value).alias("added"))
        joined = self.table.join(found, "i", "left")
        return replace(self, table=joined.select("i", (F.col("value") + F.coalesce("added", F.lit(0))).alias("value")))

    def write(self, df: DataFrame, index: list[Column], value: Column, order: Column) -> "NDArray":
        """Scatters values; of several for one element that of the greatest order stays."""
        found = df.groupBy(self._at(index).alias("i")).agg(F.max_by(value, order).alias("new"), F.count("*").alias("n"))
        joined = self.table.join(found, "i", "left")
        return replace(self, table=joined.select("i", F.when(F.col("n").isNotNull(), F.col("new")).otherwise(F.col("value")).alias("value")))
