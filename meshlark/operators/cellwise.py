"""Per-cell tables and reductions, global arrays, scans.

A per-cell matrix is a long table (cell, row, col, value); a table per cell and name is wide.
Reductions combine with what the target already holds and leave cells without rows alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import CartesianMesh
from .scan import grouped_scan

AGGREGATES: dict[str, Callable[[Column], Column]] = {"plus": F.sum, "min": F.min, "max": F.max}
COMBINE: dict[str, Callable[[Column, Column], Column]] = {"plus": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def fill(spark: SparkSession, mesh: CartesianMesh, nrow: int = 1, ncol: int = 1, value: float = 0.0) -> DataFrame:
    """(cell, row, col, value) of a constant per-cell matrix."""
    df = spark.range(mesh.ncells * nrow * ncol)
    at = F.col("id")
    return df.select(F.floor(at / (nrow * ncol)).cast("bigint").alias("cell"), F.floor(at / ncol).cast("bigint").__mod__(nrow).cast("int").alias("row"), (at % ncol).cast("int").alias("col"), F.lit(value).alias("value"))


def accumulate(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], prior: DataFrame | None = None) -> DataFrame:
    """(keys..., names...): accumulators name -> (plus, min or max; column) of each key, one row without keys.

    prior: a table of the same form; its values are combined in, and keys of either side come out.
    """
    got = df.groupBy(*keys).agg(*(AGGREGATES[op](c).alias(n) for n, (op, c) in values.items()))
    if prior is None:
        return got
    both = got.unionByName(prior.select(*keys, *values))
    return both.groupBy(*keys).agg(*(AGGREGATES[op](n).alias(n) for n, (op, _) in values.items()))


def set_values(table: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts (cell, row, col, value)."""
    keys = ["cell", "row", "col"]
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def reduce_cellwise(df: DataFrame, values: list[Column], op: str, prior: DataFrame | None = None, ncol: int = 1) -> DataFrame:
    """(cell, row, col, value): component k reduces into element (k div ncol, k mod ncol).

    prior: a table of the same form that is combined in; without it only cells with rows come out.
    """
    if prior is None:
        named = [AGGREGATES[op](v).alias(f"v_{k}") for k, v in enumerate(values)]
        wide = df.groupBy("cell").agg(*named)
        parts = F.array(*(F.struct(F.lit(k // ncol).alias("row"), F.lit(k % ncol).alias("col"), F.col(f"v_{k}").alias("value")) for k in range(len(values))))
        return wide.select("cell", F.inline(parts))
    new = reduce_cellwise(df, values, op, None, ncol).withColumnRenamed("value", "new")
    joined = prior.join(new, ["cell", "row", "col"], "left")
    return joined.select("cell", "row", "col", F.when(F.col("new").isNull(), F.col("value")).otherwise(COMBINE[op](F.col("value"), F.col("new"))).alias("value"))


def counts(df: DataFrame, mesh: CartesianMesh) -> DataFrame:
    """(cell, npart) of every cell, zero where it is empty."""
    found = df.groupBy("cell").agg(F.count("*").alias("n"))
    return df.sparkSession.range(mesh.ncells).select(F.col("id").alias("cell")).join(found, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("npart"))


def broadcast_values(df: DataFrame, table: DataFrame, mesh: CartesianMesh, column: str, name: str = "value") -> DataFrame:
    """Sets a column from the value of the row's cell; the table must have one row per cell.

    The planner broadcasts the table if its size allows and otherwise joins on the cell.
    """
    one = table.groupBy("cell").agg(F.first(name).alias("__value"))
    return df.join(one, "cell", "left").withColumn(column, F.when(F.col("__value").isNotNull(), F.col("__value")).otherwise(F.raise_error(F.lit("no value for a cell")))).drop("__value")


def element_wise(function: Callable[..., Column], *tables: DataFrame) -> DataFrame:
    """Element-wise function of per-cell matrices; a table with only row 0, col 0 (marked scalar) joins on the cell alone."""
    out = tables[0].withColumnRenamed("value", "a_0")
    for k, t in enumerate(tables[1:], 1):
        keys = ["cell"] if "row" not in t.columns else ["cell", "row", "col"]
        out = out.join(t.select(*keys, F.col("value").alias(f"a_{k}")), keys)
    return out.select("cell", "row", "col", function(*(F.col(f"a_{k}") for k in range(len(tables)))).alias("value"))


def transpose(table: DataFrame) -> DataFrame:
    """Rows and columns exchanged, for every shape."""
    return table.select("cell", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def occupancy(df: DataFrame, name: str = "npart_cell") -> DataFrame:
    """Adds the number of rows in the row's cell, within the rows at hand."""
    found = df.groupBy("cell").agg(F.count("*").alias(name))
    return df.join(found, "cell")


def global_reduce(df: DataFrame, values: dict[str, Column], op: str = "plus", prior: dict[str, float] | None = None) -> DataFrame:
    """One row of global reductions, combined with what the array held before."""
    got, before = df.agg(*(AGGREGATES[op](v).alias(k) for k, v in values.items())), prior or {}
    out = []
    for k in values:
        c = F.coalesce(F.col(k), F.lit(0)) if op == "plus" else F.col(k)
        out.append((COMBINE[op](c, F.lit(before[k])) if k in before else c).alias(k))
    return got.select(*out)


def histogram(df: DataFrame, index: list[Column], shape: list[int], value: Column) -> DataFrame:
    """(i_0.., value): sums on an N-dimensional array, zero where nothing was added; indices outside raise."""
    names = [f"i_{k}" for k in range(len(shape))]
    found = df.groupBy(*(c.cast("bigint").alias(n) for c, n in zip(index, names))).agg(F.sum(value).alias("added"))
    for n, size in zip(names, shape):
        found = found.withColumn(n, F.when(F.col(n).between(0, size - 1), F.col(n)).otherwise(F.raise_error(F.lit("index outside the array"))))
    total = 1
    for n in shape:
        total *= n
    dense, stride = df.sparkSession.range(total), total
    parts = []
    for name, n in zip(names, shape):  # the last index is fastest
        stride //= n
        parts.append((F.floor(F.col("id") / stride).cast("bigint") % n).alias(name))
    return dense.select(*parts).join(found, names, "left").select(*names, F.coalesce("added", F.lit(0)).alias("value"))


# --- scans

def segmented_scan(df: DataFrame, segment: str, order: str, value: str, inclusive: bool = False, name: str = "scan") -> DataFrame:
    """Prefix sums within segments."""
    return grouped_scan(df, [segment], order, value, name, inclusive).select(*df.columns, name)


def segment_totals(df: DataFrame, segments: DataFrame, segment: str, value: str) -> DataFrame:
    """(segment, total) of every segment in `segments`, zero where it is empty."""
    found = df.groupBy(segment).agg(F.sum(value).alias("t"))
    return segments.select(segment).distinct().join(found, segment, "left").select(segment, F.coalesce("t", F.lit(0)).alias("total"))


def exclusive_scan(df: DataFrame, order: str, value: str, name: str = "scan", block: int = 1 << 18) -> DataFrame:
    """Global exclusive prefix sums over an integer order, dense or not, without one task for all rows.

    The whole table is one group of a grouped scan: it is cut in blocks of about `block` rows, block
    totals (few rows) are scanned first, then each block by itself.
    """
    return grouped_scan(df.withColumn("__all", F.lit(0)), ["__all"], order, value, name, hot_rows=block).drop("__all")


def loop_indices(df: DataFrame) -> DataFrame:
    """Adds layer, and loop_index: rows of the cells before plus the layer."""
    per_cell = df.groupBy("cell").agg(F.count("*").alias("__n"))
    starts = exclusive_scan(per_cell, "cell", "__n", "__start").drop("__n")
    rows = grouped_scan(df, ["cell"], "id", None, "layer").select(*df.columns, "layer")
    return rows.join(starts, "cell").withColumn("loop_index", F.col("__start") + F.col("layer")).drop("__start")
