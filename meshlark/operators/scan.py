"""Prefix sums within groups of any size.

A window over a group sorts the whole group in one task. Groups of more than HOT_ROWS rows are
therefore cut into blocks of their order column: each block is scanned by itself and starts from
the totals of the blocks before it. Cut points are the values of the order that a hash selects, a
sample that skewed, sparse or hashed orders cut as evenly as dense ones. It is a function of the
values alone, so whatever computes it again, a lost task or another branch of the plan, cuts alike.

What is broadcast is bounded: a row for each hot group, SAMPLES cut points and block totals for each
HOT_ROWS rows of the table. Where no group is hot these tables are empty, and adaptive execution
leaves the one shuffle that the window needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group that one task may sort, and cut points expected in as many rows.
HOT_ROWS, SAMPLES = 1 << 22, 8
#: Cut points searched at a time.
_CHUNK = 64


def cut_points(df: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """(keys..., __chunks): the sorted cut points, in chunks, of each group of more than `limit` rows."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(*keys)
    chosen = F.pmod(F.xxhash64(order), F.lit(max(1, limit // SAMPLES))) == 0
    points = df.where(chosen).join(F.broadcast(hot), keys).groupBy(*keys).agg(F.sort_array(F.collect_set(order)).alias("__p"))
    last = F.floor((F.size("__p") - 1) / _CHUNK).cast("int")
    return points.select(*keys, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("__p", c * _CHUNK + 1, _CHUNK)).alias("__chunks"))


def block_of(chunks: Column, order: Column) -> Column:
    """The number of cut points up to a value."""
    chunk = F.size(F.filter(chunks, lambda c: F.element_at(c, 1) <= order))
    inside = F.size(F.filter(F.element_at(chunks, chunk), lambda p: p <= order))
    return F.when(chunks.isNull() | (chunk == 0), F.lit(0)).otherwise((chunk - 1) * _CHUNK + inside).cast("bigint")


def grouped_scan(df: DataFrame, keys: list[str], order: str, value: str | None, name: str, inclusive: bool = False, hot_rows: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums of `value` (of ones if None) within the keys, in order of an integer column and then of ties.

    Rows of a group that share one value of the order cannot be cut apart.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    v = F.lit(1) if value is None else F.col(value)
    cuts = cut_points(df, keys, order, limit)
    blocked = df.join(F.broadcast(cuts), keys, "left").withColumn("__block", block_of(F.col("__chunks"), F.col(order)))
    totals = blocked.where("__chunks IS NOT NULL").groupBy(*keys, "__block").agg(F.sum(v).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "__block", F.sum("__t").over(before).alias("__base"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order, *ties)
    if value is None:
        own = F.row_number().over(inside) - F.lit(0 if inclusive else 1)
    else:
        own = F.coalesce(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(0))
    out = blocked.drop("__chunks").join(F.broadcast(bases), [*keys, "__block"], "left").withColumn(name, F.coalesce("__base", F.lit(0)) + own)
    return out.drop("__block", "__base")
