"""Queries that run over every row of their table."""

from pyspark.sql import functions as F

from meshlark.operators import pairs
from meshlark.plans import catalog
from meshlark.plans.fixtures import events
from meshlark.plans.pairs import neighbours_list
from meshlark.sources import steps

catalog.load()
SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.QUERIES[name](spark, SF)


def test_cell_table_has_all_rows_of_each_cell(spark):
    got = run(spark, "c9_cell_rows_write")
    assert got.count() == events(spark, SF).df.count() and got.agg(F.max("row")).first()[0] >= 3


def test_direct_access_reaches_all_events(spark):
    larger = "/root/testdata/sf0.01"
    assert catalog.QUERIES["c13_direct_access"](spark, larger).count() == events(spark, larger).df.count() > 1000


def test_steps_hold_all_events(spark, monkeypatch):
    rows, write = [], steps.Trajectory.write
    monkeypatch.setattr(steps.Trajectory, "write", lambda self, df, step=None: rows.append(df.count()) or write(self, df, step))
    run(spark, "a8_read_step")
    assert sum(rows) == events(spark, SF).df.count()


def test_every_place_is_looked_up(spark):
    assert run(spark, "a10_get_particles").count() == events(spark, SF).df.count()


def test_product_of_every_event(spark):
    assert run(spark, "l6_product_matrix").first()["n"] == 2 * events(spark, SF).df.count()


def test_pair_list_of_the_table_is_validated(spark, monkeypatch):
    seen, invalid = [], pairs.invalid_rows
    monkeypatch.setattr(pairs, "invalid_rows", lambda df: seen.append(df.count()) or invalid(df))
    run(spark, "f5_validate_pair_list")
    assert seen == [neighbours_list(events(spark, SF).df).count() + 4]


def test_points_on_grid_lines_are_located(spark):
    from meshlark.plans.reductions import _in_quads, _in_triangles

    places = [(x / 2, y / 2) for x in range(61) for y in range(49)] + [(30.5, 3.0), (-0.5, 3.0)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "id long, P_0 double, P_1 double")
    inside = lambda x, y: 0 <= x <= 30 and 0 <= y <= 24
    triangles = {i: m for i, m in _in_triangles(spark, points).select("id", "mesh_cell").collect()}
    quads = {i: m for i, m in _in_quads(spark, points).select("id", "mesh_cell").collect()}
    for k, (x, y) in enumerate(places):
        in_box = lambda c, n, w, h: w * (c % n) <= x <= w * (c % n + 1) and h * (c // n) <= y <= h * (c // n + 1)
        side = lambda t: (y - 3 * (t // 20)) - (x - 3 * (t // 2 % 10))
        want = max((t for t in range(160) if in_box(t // 2, 10, 3, 3) and (side(t) >= 0 if t % 2 else side(t) <= 0)), default=None)
        assert triangles[k] == want and (want is not None) == inside(x, y), (x, y)
        assert quads[k] == max((c for c in range(120) if in_box(c, 15, 2, 3)), default=None), (x, y)
    for name in ("i9_point_in_polygon", "i9_unstructured_mesh"):
        assert run(spark, name).count() == events(spark, SF).df.count()


def test_points_are_located_in_3d(spark):
    from meshlark.plans.reductions import _in_prisms

    places = [(x / 4, y / 4, z / 4) for x in range(-1, 10) for y in range(-1, 10) for z in range(-1, 10)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id long, x_0 double, x_1 double, x_2 double")
    got = {i: m for i, m in _in_prisms(spark, points).select("id", "mesh_cell").collect()}
    for k, p in enumerate(places):
        lows = lambda t: [0.5 * (t // 2 // 4**d % 4) for d in range(3)]
        side = lambda t: (p[1] - lows(t)[1]) - (p[0] - lows(t)[0])
        want = [t for t in range(128) if all(lo <= v <= lo + 0.5 for lo, v in zip(lows(t), p)) and (side(t) >= 0 if t % 2 else side(t) <= 0)]
        assert got[k] == max(want, default=None), p
