"""Pairs of rows in one cell: all-to-all, pair lists with waves, pair loops, collision sampling."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..group import with_layers
from .scan import grouped_scan


#: Rows of a cell on one side of a block of pairs, draws of a cell in one row, and pairs of a cell that one task may walk through.
SIDE, DRAWS, WALK = 1 << 12, 1 << 16, 1 << 24


def all_to_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cell, layer_a, layer_b, a_*, b_*): every unordered pair of a cell once.

    The number of pairs is what the operator asks for; reduce them by cell where that is wanted
    and the join streams into the aggregate. Cells of more than SIDE rows are cut into blocks of
    layers, and each pair of blocks is a key of its own, so a hot cell spreads.
    """
    rows = with_layers(df).select("cell", "layer", *columns).withColumn("__block", F.floor(F.col("layer") / SIDE).cast("bigint"))
    large = df.groupBy("cell").agg(F.floor((F.count("*") - 1) / SIDE).cast("bigint").alias("__last")).where("__last > 0")
    rows_a = rows.join(large, "cell", "left").withColumn("__other", F.explode(F.sequence(F.col("__block"), F.coalesce("__last", F.col("__block")))))
    rows_b = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__block"))))
    a = rows_a.select("cell", F.col("__block").alias("__i"), F.col("__other").alias("__j"), F.col("layer").alias("layer_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = rows_b.select("cell", F.col("__other").alias("__i"), F.col("__block").alias("__j"), F.col("layer").alias("layer_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b, ["cell", "__i", "__j"]).where("layer_a < layer_b").drop("__i", "__j")


def all_to_all_differences(df: DataFrame, column: str) -> DataFrame:
    """(cell, n, w): the unordered pairs of each cell and the sum of |a - b| over them, for an integer column.

    What all_to_all and a sum by cell give, without listing the pairs. A value with k rows, and b rows
    below it of a cell's N, is the larger of a pair b times and the smaller N - b - k times for each
    of its rows, so w is the sum of value * k * (2 b + k - N): rows are counted by value, and counts
    are scanned in order of value, a hot cell in blocks. Pairs with a null count in n alone; w is null
    for a cell without any other pair. Products and sums are decimals: only a w beyond 64 bits is refused.
    """
    rows = df.where("cell IS NOT NULL").groupBy("cell", column).agg(F.count("*").alias("__m"), F.count(column).alias("__k"))
    big = lambda c: c.cast("decimal(20,0)")
    v, k, b = big(F.col(column)), F.col("__k"), F.col("__b")
    sums = grouped_scan(rows, ["cell"], column, "__k", "__b").groupBy("cell").agg(F.sum("__m").alias("__all"), F.sum("__k").alias("__n"), F.sum(v * big(k * (2 * b + k))).alias("__upper"), F.sum(v * big(k)).alias("__sum"))
    w = F.when(F.col("__n") > 1, F.col("__upper") - F.col("__sum") * big(F.col("__n")))
    return sums.where("__all > 1").select("cell", F.expr("__all * (__all - 1) div 2").alias("n"), w.cast("bigint").alias("w"))


def walkable(pairs: DataFrame) -> DataFrame:
    """The pairs, with an error if a cell has more than WALK of them: walking through them is one task's work by definition.

    What is broadcast has a row for each WALK pairs at most.
    """
    large = pairs.groupBy("cell").agg(F.count("*").alias("__n")).where(F.col("__n") > WALK)
    bad = F.raise_error(F.concat(F.lit("too many pairs for a sequential walk in cell "), F.col("cell").cast("string")))
    return pairs.join(F.broadcast(large), "cell", "left").withColumn("cell", F.when(F.col("__n").isNull(), F.col("cell")).otherwise(bad)).drop("__n")


def host_waves(pairs: DataFrame) -> DataFrame:
    """(cell, ord, wave, i, j): greedy waves in which no row occurs twice, pairs stored as (min, max).

    The wave of a pair depends on the pairs before it in its cell, so a cell is one group here;
    a cell's list holds no payload.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, free, waves = pdf.sort_values("ord"), {}, []
        for i, j in zip(pdf["i"], pdf["j"]):
            w = max(free.get(i, 0), free.get(j, 0))
            free[i] = free[j] = w + 1
            waves.append(w)
        lo, hi = pdf[["i", "j"]].min(axis=1), pdf[["i", "j"]].max(axis=1)
        return pdf.assign(wave=waves, i=lo, j=hi)[["cell", "ord", "wave", "i", "j"]]

    return walkable(pairs.select("cell", "ord", "i", "j")).groupBy("cell").applyInPandas(one, "cell long, ord long, wave long, i long, j long")


def invalid_rows(pairs: DataFrame, keys: tuple[str, ...] = ("cell", "wave")) -> DataFrame:
    """(keys..., row, n): rows that occur more than once in a wave; a valid list gives none."""
    return pairs.select(*keys, F.explode(F.array("i", "j")).alias("row")).groupBy(*keys, "row").agg(F.count("*").alias("n")).where("n > 1")


def wave_occupancy(pairs: DataFrame, keys: tuple[str, ...] = ("cell", "wave")) -> DataFrame:
    """(keys..., n): pairs in each wave."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"))


def resolve(pairs: DataFrame, a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The pair list with columns of row i of a and row j of b, for read-only or reducing pair loops."""
    ra = with_layers(a).select("cell", F.col("layer").alias("i"), *(F.col(c).alias(f"a_{c}") for c in columns))
    rb = with_layers(b).select("cell", F.col("layer").alias("j"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return pairs.join(ra, ["cell", "i"]).join(rb, ["cell", "j"])


def pair_indices(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Adds loop_index: the pair's place over all cells, in the given order within a cell."""
    from .cellwise import exclusive_scan

    starts = exclusive_scan(pairs.groupBy("cell").agg(F.count("*").alias("__n")), "cell", "__n", "__start").drop("__n")
    return grouped_scan(pairs, ["cell"], order[0], None, "__k", ties=tuple(order[1:])).select(*pairs.columns, "__k").join(starts, "cell").withColumn("loop_index", F.col("__start") + F.col("__k")).drop("__k", "__start")


def pair_loop(rows: DataFrame, pairs: DataFrame, columns: list[str], kernel: Callable[[dict, dict], None]) -> DataFrame:
    """In-place pair updates, wave by wave within each cell: kernel(a, b) changes two row dicts.

    For updates that neither reduce nor commute. rows: (cell, layer, columns...).
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("cell", "layer", *columns).schema)

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        table = {r["layer"]: r for r in left.to_dict("records")}
        for _, i, j in sorted(zip(right["wave"], right["i"], right["j"])):
            kernel(table[i], table[j])
        return pd.DataFrame(table.values(), columns=["cell", "layer", *columns])

    return rows.select("cell", "layer", *columns).groupBy("cell").cogroup(walkable(pairs.select("cell", "wave", "i", "j")).groupBy("cell")).applyInPandas(one, schema)


# --- collision cells

def collision_partition(df: DataFrame, species: list[int], ccell: str = "ccell", kind: str = "SPECIES_0") -> DataFrame:
    """(cell, ccell, species, rank, id): rows of known species, numbered in their bucket by id."""
    rows = df.where(F.col(kind).isin(species)).select("cell", F.col(ccell).alias("ccell"), F.col(kind).alias("species"), "id")
    return grouped_scan(rows, ["cell", "ccell", "species"], "id", None, "rank").select("cell", "ccell", "species", "rank", "id")


def max_pairs(partition: DataFrame, a: int, b: int, replacement: bool) -> DataFrame:
    """(cell, ccell, n_a, n_b, most): how many pairs can be drawn; unlimited is the largest 32-bit integer."""
    n = partition.groupBy("cell", "ccell").agg(F.count_if(F.col("species") == a).alias("n_a"), F.count_if(F.col("species") == b).alias("n_b"))
    if replacement:
        able = F.col("n_a") >= 2 if a == b else (F.col("n_a") >= 1) & (F.col("n_b") >= 1)
        return n.withColumn("most", F.when(able, F.lit(2147483647)).otherwise(F.lit(0)).cast("bigint"))
    return n.withColumn("most", F.floor(F.col("n_a") / 2).cast("bigint") if a == b else F.least("n_a", "n_b"))


def ntc_ranks(r1: Column, r2: Column, n_a: Column, n_b: Column, same: bool) -> tuple[Column, Column]:
    """Ranks of the pair that two uniform draws select, with replacement; never a row with itself."""
    i = F.least((n_a * r1).cast("bigint"), n_a - 1)
    if not same:
        return i, F.least((n_b * r2).cast("bigint"), n_b - 1)
    return i, (i + 1 + F.least(((n_a - 1) * r2).cast("bigint"), n_a - 2)) % n_a


def sample_ntc(partition: DataFrame, wanted: DataFrame, a: int, b: int, seed: int, step: int = 0) -> DataFrame:
    """(cell, ccell, k, id_a, id_b): `n` pairs (column of wanted) in each collision cell, with replacement.

    A request that a cell cannot serve raises an error.
    """
    sizes = wanted.join(max_pairs(partition, a, b, True), ["cell", "ccell"], "left").where("n > 0")
    ok = F.when(F.coalesce(F.col("most"), F.lit(0)) > 0, F.col("n")).otherwise(F.raise_error(F.lit("too few rows for the pairs asked for")))
    # blocks of draws first: a row that asks for very many neither makes one array nor keeps them in one task
    blocks = sizes.withColumn("n", ok.cast("bigint")).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / DRAWS).cast("bigint"))))
    blocks = blocks.repartition("cell", "ccell", "__b")
    drawn = blocks.withColumn("k", F.explode(F.sequence((F.col("__b") * DRAWS), F.least(F.col("n"), (F.col("__b") + 1) * DRAWS) - 1))).withColumn("k", F.col("k").cast("int")).drop("__b")
    row = [F.col("cell"), F.col("ccell"), F.col("k")]
    i, j = ntc_ranks(rng.uniform(seed, step, row, 0), rng.uniform(seed, step, row, 1), F.col("n_a"), F.col("n_b"), a == b)
    drawn = drawn.select("cell", "ccell", "k", i.alias("i"), j.alias("j"))
    ra = partition.where(F.col("species") == a).select("cell", "ccell", F.col("rank").alias("i"), F.col("id").alias("id_a"))
    rb = partition.where(F.col("species") == b).select("cell", "ccell", F.col("rank").alias("j"), F.col("id").alias("id_b"))
    return drawn.join(ra, ["cell", "ccell", "i"]).join(rb, ["cell", "ccell", "j"]).select("cell", "ccell", "k", "id_a", "id_b")


def sample_without_replacement(partition: DataFrame, wanted: DataFrame, a: int, b: int, seed: int, step: int = 0) -> DataFrame:
    """(cell, ccell, k, id_a, id_b): pairs in which no row occurs twice, one wave.

    Rows are shuffled by a hash draw within their bucket; pair k takes the k-th of each species,
    or the 2k-th and next of the shared pool.
    """
    sizes = wanted.join(max_pairs(partition, a, b, False), ["cell", "ccell"], "left")
    sizes = sizes.select("cell", "ccell", F.when(F.col("n") <= F.coalesce("most", F.lit(0)), F.col("n")).otherwise(F.raise_error(F.lit("too few rows for the pairs asked for"))).alias("n"))
    drawn = partition.where(F.col("species").isin(a, b)).withColumn("__draw", rng.draw(seed, step, F.col("id")))
    shuffled = grouped_scan(drawn, ["cell", "ccell", "species"], "__draw", None, "s", ties=("id",)).select("cell", "ccell", "species", "id", "s").join(sizes, ["cell", "ccell"])
    if a == b:
        k, first = F.floor(F.col("s") / 2).cast("bigint"), F.col("s") % 2 == 0
        pool = shuffled.withColumn("k", k).where("k < n")
    else:
        pool, first = shuffled.withColumn("k", F.col("s")).where("k < n"), F.col("species") == a
    return pool.groupBy("cell", "ccell", "k").agg(F.max(F.when(first, F.col("id"))).alias("id_a"), F.max(F.when(~first, F.col("id"))).alias("id_b"))


