"""Operators on skewed, hot and sparse input, with bounds made small, against plain recomputation."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark import CartesianMesh
from meshlark.functions import rng
from meshlark.operators import cellwise, mapping, pairs, scan
from meshlark.plans import catalog

catalog.load()

MESH = CartesianMesh((6, 4))


@pytest.mark.parametrize("kind", ["dense", "hashed", "exponential", "repeated"])
def test_scans_of_any_order(spark, kind):
    n = 3000
    order = {"dense": "id", "hashed": "xxhash64(id)", "exponential": "cast(pow(1.005, id) * 1000 as bigint) * 3000 + id", "repeated": "id div 50"}[kind]
    rows = spark.range(n).selectExpr("id", f"{order} AS o", "id % 7 AS v", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS cell")
    table = sorted((r["o"], r["id"], r["v"], r["cell"]) for r in rows.collect())
    for limit in (10, 400, 10_000):
        got = {r["id"]: r["s"] for r in scan.grouped_scan(rows, ["cell"], "o", "v", "s", hot_rows=limit, ties=("id",)).collect()}
        sums = {}
        for o, i, v, c in table:
            assert got[i] == sums.get(c, 0), (kind, limit)
            sums[c] = sums.get(c, 0) + v
        if kind != "repeated":
            total, got = 0, {r["id"]: r["scan"] for r in cellwise.exclusive_scan(rows, "o", "v", block=limit).collect()}
            for _, i, v, _ in table:
                assert got[i] == total
                total += v


@pytest.mark.parametrize("kind", ["hashed", "exponential"])
def test_blocks_of_a_hot_group_are_small(spark, kind):
    order = {"hashed": "xxhash64(id)", "exponential": "cast(pow(1.004, id) as bigint) * 5000 + id"}[kind]
    rows = spark.range(5000).selectExpr("id", f"{order} AS o", "0 AS cell")
    cuts = scan.cut_points(rows.union(spark.range(100).selectExpr("id", "id AS o", "1 AS cell")), ["cell"], "o", 400)
    assert [r["cell"] for r in cuts.collect()] == [0]  # the other group is not hot
    blocks = rows.join(cuts, "cell", "left").withColumn("b", scan.block_of(F.col("__chunks"), F.col("o")))
    sizes = [r["count"] for r in blocks.groupBy("b").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 500 and 50 < len(sizes) < 200


def test_pairs_of_a_hot_cell_in_blocks(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id", "CASE WHEN id < 90 THEN 0 ELSE id % 5 END AS cell", "id * 3 AS w")
    want = sorted(map(tuple, pairs.all_to_all(rows, ["w"]).collect()))
    assert len(want) == sum(n * (n - 1) // 2 for n in (r["count"] for r in rows.groupBy("cell").count().collect()))
    for side in (1, 7, 64):
        monkeypatch.setattr(pairs, "SIDE", side)
        assert sorted(map(tuple, pairs.all_to_all(rows, ["w"]).collect())) == want


@pytest.mark.parametrize("hot_rows", [10, 1 << 22])
def test_differences_of_pairs_equal_those_of_listed_pairs(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(scan, "HOT_ROWS", hot_rows)
    made = spark.range(400).selectExpr("id", "CASE WHEN id < 150 THEN 0 WHEN id = 399 THEN 9 ELSE id % 5 END AS cell", "CASE WHEN id % 11 > 0 THEN (id * id) % 83 - 40 END AS w")
    odd = spark.createDataFrame([(500, 6, None), (501, 6, None), (502, 7, None), (503, 7, 3), (504, None, 1), (505, None, 2), (506, 8, 2**62), (507, 8, 2**62 - 5), (508, 8, 2**62 - 5)], "id long, cell long, w long")
    rows = made.unionByName(odd)
    listed = pairs.all_to_all(rows, ["w"]).groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a_w") - F.col("b_w"))).alias("w"))
    got, want = (sorted(map(tuple, df.select("cell", "n", "w").collect()), key=str) for df in (pairs.all_to_all_differences(rows, "w"), listed))
    assert got == want and {6: (1, None), 7: (1, None), 8: (3, 10)}.items() <= {c: (n, w) for c, n, w in got}.items()
    assert {c for c, _, _ in got} == {0, 1, 2, 3, 4, 6, 7, 8}


def test_pairs_of_a_large_cell_are_not_listed(spark, tmp_path):
    """Five thousand million pairs: a query that lists them is stopped."""
    n = 100_000
    spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-05 07:30:00' AS ts", "id AS user_id", "'view' AS event_type", "id / 100D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = catalog.QUERIES["f7_all_to_all"](spark, str(tmp_path)).collect()
    finally:
        stop.cancel()
    cents = np.sort(np.trunc(np.arange(n) / 100.0 * 100.0).astype("int64"))
    assert [tuple(r) for r in got] == [(4 + 30 * 7, n * (n - 1) // 2, int((cents * (2 * np.arange(n) - n + 1)).sum()))]


def test_walks_through_too_many_pairs_are_refused(spark, monkeypatch):
    listed = spark.range(30).selectExpr("id % 2 AS cell", "id AS ord", "id AS i", "id + 1 AS j")
    assert pairs.host_waves(listed).count() == 30
    monkeypatch.setattr(pairs, "WALK", 14)
    with pytest.raises(Exception, match="too many pairs"):
        pairs.host_waves(listed).count()


def test_many_draws_of_one_cell_come_in_blocks(spark, monkeypatch):
    rows = spark.range(10).selectExpr("id", "0L AS cell", "0L AS ccell", "0 AS SPECIES_0")
    part = pairs.collision_partition(rows, [0])
    wanted = spark.createDataFrame([(0, 0, 1000)], "cell long, ccell long, n int")
    want = sorted(map(tuple, pairs.sample_ntc(part, wanted, 0, 0, 3).collect()))
    assert [k for _, _, k, _, _ in want] == list(range(1000)) and all(a != b for *_, a, b in want)
    monkeypatch.setattr(pairs, "DRAWS", 64)
    assert sorted(map(tuple, pairs.sample_ntc(part, wanted, 0, 0, 3).collect())) == want


def test_streams_of_random_numbers_are_independent(spark):
    n = 20_000
    cols = {"a": (1, 0, 0), "comp": (1, 0, 1), "step": (1, 1, 0), "seed": (2, 0, 0), "both": (0, 1, 0)}
    x = spark.range(n).select(*(rng.draw(s, t, F.col("id"), c).alias(k) for k, (s, t, c) in cols.items())).toPandas()
    u = x / rng.MODULUS
    assert (np.abs(np.corrcoef(u.T) - np.eye(len(cols))) < 0.03).all()
    values = {k: set(x[k]) for k in cols}
    for k in cols:  # a shifted stream would share nearly all values; chance shares about n * n / 2**31
        assert len(values[k]) > n - 5
        assert all(len(values[k] & values[o]) < 5 for o in cols if o != k)
        assert abs(u[k].mean() - 0.5) < 0.01 and abs(u[k].std() - 12**-0.5) < 0.01
        counts = np.bincount((u[k] * 100).astype(int), minlength=100)
        assert ((counts - n / 100) ** 2 / (n / 100)).sum() < 160
        for lag in (1, 2, 7):
            assert abs(np.corrcoef(u[k][lag:], u[k][:-lag])[0, 1]) < 0.03


def test_random_numbers_of_rows_beyond_31_bits(spark):
    draws = []
    for base in (0, 2**31 - 1, 2**31, 2**40, 2**62, -(2**63)):
        draws.append(spark.range(3000).select(rng.draw(1, 0, F.lit(base).cast("bigint") + F.col("id")).alias("d")).toPandas()["d"])
    for i, a in enumerate(draws):
        assert a.between(0, rng.MODULUS - 1).all()
        for j, b in enumerate(draws):
            if {i, j} != {1, 2} and i != j:
                assert len(set(a) & set(b)) < 5
    names = spark.range(2000).select(rng.draw(1, 0, [F.col("id") % 40, F.col("id") / 40]).alias("d")).distinct().count()
    assert names > 1995


def test_a_local_move_refuses_owners_that_are_no_neighbours(spark):
    owner = spark.range(MESH.ncells).selectExpr("id AS cell", "id % 6 div 2 + 3 * (id div 6) AS owner")
    near = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 5), (3, 0, 18)], "id long, cell long, next long")
    far = spark.createDataFrame([(4, 0, 12)], "id long, cell long, next long")
    got = {r["id"]: (r["from"], r["to"], r["how"]) for r in mapping.hybrid_move(near.union(far), MESH, owner, "cell", "next").collect()}
    assert got == {0: (0, 0, "stay"), 1: (0, 1, "local"), 2: (0, 2, "local"), 3: (0, 9, "local"), 4: (0, 6, "global")}
    assert mapping.local_move(near, MESH, owner, "cell", "next").count() == 4
    with pytest.raises(Exception, match="no neighbour"):
        mapping.local_move(far, MESH, owner, "cell", "next").collect()


def test_straight_steps_end_on_the_target_or_raise(spark):
    df = spark.createDataFrame([(1, 0.1, 7.3)], "id long, P_0 double, P_1 double")
    r = mapping.straight_steps(df, [F.lit(3.0), F.lit(1 / 3)], ["P_0", "P_1"], 1000).first()
    assert (r["P_0"], r["P_1"]) == (0.1, 7.3)
    with pytest.raises(Exception, match="missed"):
        mapping.straight_steps(df, [F.lit(3.0), F.lit(1 / 3)], ["P_0", "P_1"], 1000, tol=0.0).collect()
