"""Edge cases of groups, reductions, pairs and boundaries against plain recomputation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import geometry as G
from meshlark.functions import maths as M
from meshlark.functions import rng
from meshlark.group import Ephemeral, Group, SubGroup, cell_range, disjoint_union, with_layers
from meshlark.mesh import CartesianMesh
from meshlark.operators import boundary, cellwise, deposit, mapping, pairs, products, sampling
from meshlark.sources import export, steps
from meshlark.spec import INT, Prop, Spec

MESH = CartesianMesh((4, 8), 1.0, 1)
SPEC = Spec((Prop("P", 2, positions=True), Prop("V", 2), Prop("ID", 1, INT), Prop("MARK", 1, INT)))


def make(spark, n=300, seed=1, cells=None):
    r = random.Random(seed)
    rows = [(i, r.random() * 4, r.random() * 8, r.gauss(0, 1), r.gauss(0, 1), i * 3, r.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, P_0 double, P_1 double, V_0 double, V_1 double, ID_0 long, MARK_0 long")
    df = df.withColumn("cell", MESH.cell([F.col("P_0"), F.col("P_1")]) if cells is None else F.lit(cells).cast("long"))
    return Group.of(df, SPEC, MESH), rows


def cell_of(x, y):
    return min(max(math.trunc(x * 2), 0), 7) + 8 * min(max(math.trunc(y * 2), 0), 15)


def test_spec_rules(spark):
    assert SPEC.row_bytes == 48 and "V" in SPEC and Prop("V", 2) in SPEC and Prop("V", 3) not in SPEC
    assert SPEC.covers(Spec((Prop("P", 2),))) and not SPEC.covers(Spec((Prop("X"),)))
    assert SPEC.remove("V").push(Prop("X")).columns == ["P_0", "P_1", "ID_0", "MARK_0", "X_0"]
    with pytest.raises(ValueError):
        SPEC.push(Prop("V"))
    with pytest.raises(KeyError):
        SPEC.remove("NOPE")
    with pytest.raises(ValueError):
        SPEC.align(spark.createDataFrame([(1.0,)], "V_0 double"))
    g, _ = make(spark, 3)
    with pytest.raises(ValueError):
        g.remove_prop("P")


@pytest.mark.parametrize("n", [0, 1, 3, 255])
def test_cells_and_counts(spark, n):
    g, rows = make(spark, n)
    want = np.zeros(MESH.ncells, int)
    for r in rows:
        want[cell_of(r[1], r[2])] += 1
    got = {r["cell"]: r["npart"] for r in cellwise.counts(g.df, MESH).collect()}
    assert [got[c] for c in range(MESH.ncells)] == want.tolist()


def test_clamping_and_edges(spark):
    xs = [(-3.0, 0.0), (0.0, 0.0), (4.0, 8.0), (99.0, -1.0), (0.5, 7.9999), (-0.2, 3.0)]
    df = spark.createDataFrame(xs, "x double, y double").withColumn("c", MESH.cell([F.col("x"), F.col("y")]))
    assert [r["c"] for r in df.collect()] == [cell_of(*p) for p in xs]
    with pytest.raises(Exception, match="cell out of range"):
        Group.of(spark.createDataFrame([(1, 999)], "id long, cell long"), SPEC, MESH).df.collect()


def test_all_rows_in_one_cell_truncate_and_discard(spark):
    g, rows = make(spark, 20, cells=5)
    view = g.sub()
    for n in (0, 1, 19, 20, 100):
        assert view.truncate(n).rows().count() == min(n, 20)
        assert view.discard(n).rows().count() == max(0, 20 - n)
    assert sorted(r["id"] for r in view.truncate(3).rows().collect()) == [0, 1, 2]


def test_views_follow_and_static_views_do_not(spark):
    g, rows = make(spark)
    lazy, held = g.sub(F.col("MARK_0") == 1), g.sub(F.col("MARK_0") == 1).static()
    later = g.update({"MARK_0": F.lit(1)})
    assert lazy.rows(later).count() == 300 and held.rows(later).count() == sum(r[6] == 1 for r in rows)
    grown = g.add(g.df.limit(1).withColumn("id", F.lit(10**6).cast("long")))
    assert not held.valid(grown)
    with pytest.raises(RuntimeError):
        held.rows(grown)
    assert g.sub().whole and not lazy.whole and SubGroup(g.sub()).whole


def test_unions_partitions_and_removal(spark):
    g, rows = make(spark)
    parts = g.sub().partition("MARK", 3)
    assert disjoint_union(parts).rows().count() == sum(r[6] < 3 for r in rows)
    with pytest.raises(ValueError):
        disjoint_union([g.sub(), parts[0]])
    with pytest.raises(ValueError):
        disjoint_union([])
    with pytest.raises(Exception, match="overlap"):
        disjoint_union([parts[0], parts[0]], check=True).rows().collect()
    assert g.remove(parts[1]).df.count() == sum(r[6] != 1 for r in rows)
    assert g.remove(g.sub().truncate(1)).df.count() == 300 - len({cell_of(r[1], r[2]) for r in rows})
    assert g.remove_key("MARK", 2).df.count() == sum(r[6] != 2 for r in rows)
    assert g.clear().df.count() == 0
    with pytest.raises(ValueError):
        g.add_group(g)
    with pytest.raises(ValueError):
        g.add_group(g.sub())


def test_updates(spark):
    g, rows = make(spark)
    got = {r["id"]: r["ID_0"] for r in g.sub(F.col("MARK_0") == 2).update({"ID_0": F.lit(-1)}).df.collect()}
    assert got == {r[0]: -1 if r[6] == 2 else r[5] for r in rows}
    got = {r["id"]: r["ID_0"] for r in g.sub().truncate(1).update({"ID_0": F.lit(-1)}).df.collect()}
    first = {}
    for r in rows:
        first.setdefault(cell_of(r[1], r[2]), r[0])
    assert got == {r[0]: -1 if r[0] in first.values() else r[5] for r in rows}
    with pytest.raises(KeyError):
        g.update({"NOPE_0": F.lit(1)})
    with pytest.raises(ValueError):
        cell_range(None, 3)
    eph = Ephemeral(g.sub(F.col("MARK_0") == 0), {"E_0": F.col("ID_0") + 1}).to_group({"E_0": "ID_0"})
    assert {r["id"]: r["ID_0"] for r in eph.df.collect()} == {r[0]: r[5] + (r[6] == 0) for r in rows}


def test_lookup_by_place(spark):
    g, rows = make(spark, 40, cells=3)
    req = spark.createDataFrame([(0, 3, 7), (1, 3, 0), (2, 3, 7)], "ordinal long, cell long, layer int")
    assert [r["id"] for r in g.get(req).orderBy("ordinal").collect()] == [7, 0, 7]
    with pytest.raises(Exception, match="no row at cell"):
        g.get(spark.createDataFrame([(0, 3, 40)], "ordinal long, cell long, layer int")).collect()
    assert g.remove_at(req).df.count() == 38


@pytest.mark.parametrize("op, f", [("plus", sum), ("min", min), ("max", max)])
def test_reductions_combine_with_the_prior_value(spark, op, f):
    g, rows = make(spark, 50)
    prior = cellwise.fill(spark, MESH, 1, 1, 0.25)
    got = {r["cell"]: r["value"] for r in cellwise.reduce_cellwise(g.df, [F.col("V_0")], op, prior).collect()}
    for c in range(MESH.ncells):
        vs = [r[3] for r in rows if cell_of(r[1], r[2]) == c]
        want = 0.25 if not vs else f([0.25, f(vs)])
        assert got[c] == pytest.approx(want, abs=1e-14)


def test_scans(spark):
    for n in (0, 1, 7, 255):
        df = spark.range(n).withColumn("v", (F.col("id") * 7) % 5)
        got = [r["scan"] for r in cellwise.exclusive_scan(df, "id", "v", block=8).orderBy("id").collect()]
        vs = [(k * 7) % 5 for k in range(n)]
        assert got == [sum(vs[:k]) for k in range(n)]
    seg = spark.createDataFrame([(0,), (1,), (2,)], "s long")
    rows = spark.createDataFrame([(0, 1, 4), (0, 2, 5), (2, 1, 6)], "s long, k long, v long")
    assert {tuple(r) for r in cellwise.segment_totals(rows, seg, "s", "v").collect()} == {(0, 9), (1, 0), (2, 6)}


def test_global_arrays_and_histograms(spark):
    g, rows = make(spark, 30)
    got = cellwise.global_reduce(g.df, {"a": F.col("ID_0"), "b": F.lit(1)}, "plus", {"a": 5}).first()
    assert got["a"] == 5 + sum(r[5] for r in rows) and got["b"] == 30
    assert cellwise.global_reduce(g.df.limit(0), {"a": F.col("ID_0")}, "plus", {"a": 5}).first()["a"] == 5
    assert cellwise.global_reduce(g.df, {"a": F.col("ID_0")}, "max", {"a": 10**9}).first()["a"] == 10**9
    h = {(r["i_0"], r["i_1"]): r["value"] for r in cellwise.histogram(g.df, [F.col("MARK_0"), F.col("ID_0") % 2], [5, 2], F.lit(1)).collect()}
    assert len(h) == 10 and sum(h.values()) == 30
    with pytest.raises(Exception, match="outside the array"):
        cellwise.histogram(g.df, [F.col("MARK_0")], [2], F.lit(1)).collect()


def test_waves_and_in_place_pair_loops(spark):
    r = random.Random(2)
    listed = [(c, k, *r.sample(range(6), 2)) for c in range(3) for k in range(12)]
    waves = pairs.host_waves(spark.createDataFrame(listed, "cell long, ord long, i long, j long"))
    assert pairs.invalid_rows(waves).count() == 0
    got = {(x["cell"], x["ord"]): x["wave"] for x in waves.collect()}
    for c in range(3):
        free = {}
        for _, k, i, j in [x for x in listed if x[0] == c]:
            w = max(free.get(i, 0), free.get(j, 0))
            free[i] = free[j] = w + 1
            assert got[c, k] == w
    rows = spark.createDataFrame([(c, k, float(k)) for c in range(3) for k in range(6)], "cell long, layer long, v double")

    def swap_and_add(a, b):
        a["v"], b["v"] = b["v"] + 1, a["v"]

    out = {(x["cell"], x["layer"]): x["v"] for x in pairs.pair_loop(rows, waves, ["v"], swap_and_add).collect()}
    for c in range(3):
        v = {k: float(k) for k in range(6)}
        for w, i, j in sorted((x["wave"], x["i"], x["j"]) for x in waves.where(f"cell = {c}").collect()):
            v[i], v[j] = v[j] + 1, v[i]
        assert all(out[c, k] == v[k] for k in range(6))


def test_all_to_all_and_sampling(spark):
    g, rows = make(spark, 9, cells=2)
    seen = {tuple(sorted((x["layer_a"], x["layer_b"]))) for x in pairs.all_to_all(g.df, ["ID_0"]).collect()}
    assert len(seen) == 36
    part = pairs.collision_partition(g.df.withColumn("ccell", F.lit(0)), [0, 1, 2, 3, 4], kind="MARK_0")
    assert part.count() == 9
    one = part.where("species = 9").select("cell", "ccell").distinct()
    assert pairs.sample_ntc(part, one.withColumn("n", F.lit(0)), 0, 0, 1).count() == 0
    same = g.df.withColumn("ccell", F.lit(0)).withColumn("MARK_0", F.lit(0).cast("long"))
    part = pairs.collision_partition(same, [0], kind="MARK_0")
    want = part.select("cell", "ccell").distinct()
    got = pairs.sample_ntc(part, want.withColumn("n", F.lit(500)), 0, 0, 1).collect()
    assert len(got) == 500 and all(x["id_a"] != x["id_b"] for x in got) and len({x["id_a"] for x in got}) == 9
    pairs_ = pairs.sample_without_replacement(part, want.withColumn("n", F.lit(4)), 0, 0, 1).collect()
    ids = [i for x in pairs_ for i in (x["id_a"], x["id_b"])]
    assert len(ids) == len(set(ids)) == 8
    with pytest.raises(Exception, match="too few rows"):
        pairs.sample_without_replacement(part, want.withColumn("n", F.lit(5)), 0, 0, 1).collect()


@pytest.mark.parametrize("ndim", [2, 3])
def test_trajectory_hits(spark, ndim):
    mesh = CartesianMesh((4, 8, 6)[:ndim], 1.0, 0)
    r = random.Random(3)
    rows = [(i, *(r.random() * e for e in mesh.extents), *(r.random() * e * 3 - e for e in mesh.extents)) for i in range(400)]
    names = [f"PP_{d}" for d in range(ndim)] + [f"P_{d}" for d in range(ndim)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {x["id"]: x for x in boundary.trajectory_hits(df, mesh, [F.col(f"PP_{d}") for d in range(ndim)], [F.col(f"P_{d}") for d in range(ndim)], {f: f for f in range(2 * ndim)}).collect()}
    for i, *v in rows:
        a, b = v[:ndim], v[ndim:]
        out = [d for d in range(ndim) if b[d] <= 0 or b[d] >= mesh.extents[d]]
        assert (i in got) == bool(out)
        if not out:
            continue
        t = {d: ((0 if b[d] <= 0 else mesh.extents[d]) - a[d]) / (b[d] - a[d]) for d in out}
        d = min(t, key=t.get)
        low = b[d] <= 0
        assert got[i]["facet"] == boundary.FACETS[d][0 if low else 1]
        for k in range(ndim):
            assert got[i][f"point_{k}"] == pytest.approx(a[k] + t[d] * (b[k] - a[k]), abs=1e-9)
            assert got[i][f"normal_{k}"] == ((1.0 if low else -1.0) if k == d else 0.0)
    faces = {x["face"]: x for x in mesh.faces(spark).collect()}
    assert len(faces) == sum(mesh.face_counts())
    for x in got.values():
        at = [min(int(x[f"point_{k}"]), mesh.fine_dims[k] - 1) for k in range(ndim)]
        cell = sum(c * math.prod(mesh.fine_dims[:k]) for k, c in enumerate(at))
        assert faces[x["element"]]["facet"] == x["facet"] and faces[x["element"]]["cell"] == cell


def test_truncation_and_reflection(spark):
    rows = [(0, 1.0, 1.0, -1.0, 1.0, 1.0, 0.5, -2.0, 0.0), (1, 1e-9, 1.0, -1.0, 1.0, 1.0, 0.5, -2.0, 0.5), (2, 0.05, 1.0, -1.0, 1.0, 1.0, 0.5, -1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, PP_0 double, PP_1 double, P_0 double, P_1 double, TSP_0 double, TSP_1 double, V_0 double, V_1 double")
    hits = boundary.trajectory_hits(df, MESH, [F.col("PP_0"), F.col("PP_1")], [F.col("P_0"), F.col("P_1")], {3: 1})
    got = {x["id"]: x for x in boundary.reflect(hits, 2, 0.1).collect()}
    assert got[0]["P_0"] == pytest.approx(0.1) and got[0]["V_0"] == 2.0 and got[0]["TSP_1"] == pytest.approx(0.25) and got[0]["TSP_0"] == pytest.approx(0.75)
    assert got[1]["P_0"] == 1e-9 and got[1]["V_1"] == 0.5  # a tiny step goes back to where it began
    assert got[2]["P_0"] == pytest.approx(0.05)  # the reset would pass the previous position


def test_quads_triangles_and_torus(spark):
    r = random.Random(4)
    q = [(0.0, 0.1), (2.0, -0.2), (2.3, 1.9), (-0.1, 1.5)]
    cols = [(F.lit(a), F.lit(b)) for a, b in q]
    rows = [(i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    x, y = G.quad_point(cols, F.col("a"), F.col("b"))
    df = df.withColumns({"x": x, "y": y})
    e0, e1 = G.quad_collapsed(cols, F.col("x"), F.col("y"))
    w = G.quad_cartesian_weights(cols, F.col("x"), F.col("y"))
    for s in df.select("*", e0.alias("e0"), e1.alias("e1"), sum(w[1:], w[0]).alias("one")).collect():
        assert s["e0"] == pytest.approx(s["a"], abs=1e-9) and s["e1"] == pytest.approx(s["b"], abs=1e-9) and s["one"] == pytest.approx(1)
    square = [(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]  # a parallelogram leaves a linear equation
    e0, e1 = G.quad_collapsed(square, F.lit(0.5), F.lit(1.5))
    assert tuple(spark.range(1).select(e0, e1).first()) == pytest.approx((-0.5, 0.5))
    tri = [(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (0.0, 2.0))]
    w = G.triangle_weights(tri, F.lit(0.25), F.lit(0.5))
    back = G.from_weights(tri, w)
    assert tuple(spark.range(1).select(*w, *back).first()) == pytest.approx((0.5, 0.25, 0.25, 0.25, 0.5))


def test_matrices_and_gamma(spark):
    r = np.random.default_rng(5)
    for n in (3, 4):
        m = r.normal(size=(n, n))
        cols = [[F.lit(float(v)) for v in row] for row in m]
        got = np.array(spark.range(1).select(*(c for row in M.inverse(cols) for c in row)).first()).reshape(n, n)
        assert np.allclose(got @ m, np.eye(n), atol=1e-9)
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.5, 6.0, -0.5, -1.5, 0.1)], "x double").select("x", M.tgamma(F.col("x")).alias("g"), M.trunc(F.col("x")).alias("t"), M.round_away(F.col("x")).alias("r"))
    for s in df.collect():
        assert s["g"] == pytest.approx(math.gamma(s["x"]), rel=1e-10)
        assert s["t"] == math.trunc(s["x"]) and s["r"] == math.copysign(math.floor(abs(s["x"]) + 0.5), s["x"])
    assert spark.range(1).select(M.rsqrt(F.lit(0.0))).first()[0] == math.inf


def test_point_location_on_edges_and_outside(spark):
    edges = spark.createDataFrame([(m, *p) for m, x in ((0, 0.0), (1, 1.0)) for p in ((x, 0.0, x + 1, 0.0), (x + 1, 0.0, x + 1, 1.0), (x + 1, 1.0, x, 1.0), (x, 1.0, x, 0.0))], "mesh_cell long, ax double, ay double, bx double, by double")
    candidates = spark.createDataFrame([(c, m, m) for c in range(MESH.ncells) for m in (0, 1)], "cell long, mesh_cell long, ord long")
    pts = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.0, 0.5), (2, 1.5, 0.5), (3, 3.0, 3.0), (4, 0.0, 0.0)], "id long, x double, y double")
    got = {r["id"]: r["mesh_cell"] for r in mapping.locate(pts, edges, candidates, MESH, [F.col("x"), F.col("y")], ["id"]).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: None, 4: 0}


def test_projection_conserves_and_evaluates(spark):
    corners = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.5)], "cell long, x_0 double, y_0 double, x_1 double, y_1 double, x_2 double, y_2 double, volume double")
    df = spark.createDataFrame([(0, 0.2, 0.3, 2.0), (0, 0.1, 0.1, 3.0)], "cell long, px double, py double, w double")
    q = deposit.project_barycentric(df, corners, F.col("px"), F.col("py"), F.col("w"))
    assert sum(q.first()[1:]) == pytest.approx(5.0)
    d = deposit.density_at(df, q, corners, F.lit(1 / 3), F.lit(1 / 3))
    assert d.first()["density"] == pytest.approx(5.0 / 0.5)  # the value at the centroid is mass over volume
    with pytest.raises(ValueError):
        deposit.project_evaluate("DG", 1)


def test_products_and_unseen(spark):
    g, rows = make(spark, 10)
    spec = Spec((SPEC.get("ID"), SPEC.get("MARK")))
    made = products.numbered(products.descendants(g.df, 2, {"ID_0": [F.lit(7), F.col("ID_0") * 2]}, [F.lit(True), F.col("MARK_0") > 1], spec), 2, 1000)
    got = {x["id"]: (x["ID_0"], x["MARK_0"]) for x in made.collect()}
    assert got == {1000 + 2 * r[0] + k: (7 if k == 0 else r[5] * 2, r[6]) for r in rows for k in range(2) if k == 0 or r[6] > 1}
    with pytest.raises(ValueError):
        products.add_matrix(g, made, Spec((Prop("NEW"),)))
    u = products.Unseen()
    assert {x["value"] for x in u.extract(g.df.where("id < 5"), "ID_0").collect()} == {0, 3, 6, 9, 12}
    assert {x["value"] for x in u.extract(g.df, "ID_0").collect()} == {15, 18, 21, 24, 27}
    assert u.extract(g.df, "ID_0").count() == 0


def test_random_columns(spark):
    df = spark.range(20_000).select(rng.uniform(1, 0, F.col("id")).alias("u"), rng.normal(1, 0, F.col("id")).alias("n"), rng.uniform(1, 1, F.col("id")).alias("u2"))
    x = df.toPandas()
    assert abs(x["u"].mean() - 0.5) < 0.01 and abs(x["u"].std() - 12**-0.5) < 0.01
    assert abs(x["n"].mean()) < 0.03 and abs(x["n"].std() - 1) < 0.03
    assert abs(np.corrcoef(x["u"], x["u2"])[0, 1]) < 0.03 and abs(np.corrcoef(x["u"][1:], x["u"][:-1])[0, 1]) < 0.03
    again = spark.range(20_000).repartition(7).select("id", rng.uniform(1, 0, F.col("id")).alias("u")).orderBy("id").toPandas()
    assert (again["u"] == x["u"]).all()
    cells = sampling.uniform_within_cells(spark, MESH, 3, 1)
    assert cells.where(MESH.cell([F.col("P_0"), F.col("P_1")]) != F.col("cell")).count() == 0
    assert sampling.expand(sampling.counts_for_density(spark.createDataFrame([(0, 2.0, 1.0), (1, -1.0, 1.0)], "cell long, average double, volume double"), 0.5)).count() == 4


def test_trajectory_files(spark, tmp_path):
    g, rows = make(spark, 25)
    t = steps.Trajectory(str(tmp_path / "t"), SPEC, ["ID"])
    assert [t.write(g.df), t.write(g.df.limit(0)), t.write(g.df.where("id < 5"), 9), t.next] == [0, 1, 9, 10]
    back = t.read(spark, 0)
    assert sorted((r["P_0"], r["P_1"], r["ID_0"]) for r in back.collect()) == sorted((r[1], r[2], r[5]) for r in rows)
    assert t.read(spark, 1).count() == 0 and t.read(spark).count() == 30
    assert set(t.read(spark, 0, xyz=True).columns) == {"x", "y", "ID_0", "step"}
    export.write_unstructured(export.cell_outlines(spark, MESH), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == MESH.ncells


def test_gmsh_files(spark, tmp_path):
    p = tmp_path / "m.msh"
    p.write_text("$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 3 1 3\n2 1 0 3\n1\n2\n3\n0 0 0\n1 0 0\n0 1 0\n$EndNodes\n$Elements\n1 1 1 1\n2 1 2 1\n1 1 2 3\n$EndElements\n")
    nodes, elements = export.read_gmsh(spark, str(p))
    assert nodes.count() == 3 and elements.first()["nodes"] == [1, 2, 3]


def test_layers_are_dense(spark):
    g, rows = make(spark)
    seen = {}
    for r in with_layers(g.remove(g.sub(F.col("id") % 3 == 0)).df).collect():
        seen.setdefault(r["cell"], []).append(r["layer"])
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


@pytest.mark.parametrize("hot", [1, 5, 40, 1000])
def test_scans_of_large_groups_in_blocks(spark, hot):
    from meshlark.operators.scan import grouped_scan

    r = random.Random(hot)
    rows = [(0 if k % 3 else k % 7, i, i % 11) for k, i in enumerate(r.sample(range(-5000, 5000), 200))]
    df = spark.createDataFrame(rows, "cell long, id long, v long")
    got = grouped_scan(grouped_scan(df, ["cell"], "id", "v", "run", True, hot), ["cell"], "id", None, "layer", False, hot)
    seen = {r["id"]: (r["run"], r["layer"]) for r in got.collect()}
    for c, i, _ in rows:
        before = [v for d, j, v in rows if d == c and j <= i]
        assert seen[i] == (sum(before), len(before) - 1)


def test_arrays_and_points(spark):
    from meshlark.operators.arrays import NDArray
    from meshlark.operators.points import PointMapper

    g, rows = make(spark, 40)
    a = NDArray.filled(spark, (5, 2), 1.0).add(g.df, [F.col("MARK_0"), F.col("ID_0") % 2], F.lit(1.0))
    got = {r["i"]: r["value"] for r in a.table.collect()}
    assert got == {m * 2 + b: 1.0 + sum(r[6] == m and r[5] % 2 == b for r in rows) for m in range(5) for b in range(2)}
    read = {r["id"]: r["x"] for r in a.read(g.df, [F.col("MARK_0"), F.col("ID_0") % 2], "x").collect()}
    assert read == {r[0]: got[r[6] * 2 + r[5] % 2] for r in rows}
    with pytest.raises(Exception, match="outside the array"):
        a.add(g.df, [F.col("MARK_0") + 5, F.lit(0)], F.lit(1.0)).table.collect()
    pts = PointMapper.of(spark.createDataFrame([(0, 0.1, 0.1), (1, 3.9, 7.9)], "point_id long, x_0 double, x_1 double"), MESH)
    assert [r["value_0"] for r in pts.interpolate([lambda x, y: x + y]).get(1).orderBy("point_id").collect()] == pytest.approx([0.2, 11.8])
    with pytest.raises(Exception, match="no value"):
        pts.set(spark.createDataFrame([(0, 1.0)], "point_id long, value_0 double"), 1).get(1).collect()


def test_regions_count_rows(spark):
    from meshlark.sources.metrics import Regions

    g, _ = make(spark, 25)
    regions = Regions()
    regions.observe(g.df, "loop", "advect", SPEC, 4).write.format("noop").mode("overwrite").save()
    assert [(e["rows"], e["bytes"], e["flops"]) for e in regions.rows()] == [(25, 25 * 48, 100)]
    assert '"key2": "advect"' in regions.json()


def test_cell_ranges_prune_folders(spark, tmp_path):
    from meshlark.sources import tables

    g, rows = make(spark)
    path = str(tmp_path / "g")
    tables.write(g.df, path, per_bucket=16)
    got = tables.read(spark, path, SPEC, (20, 50), per_bucket=16)
    assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in rows if 20 <= cell_of(r[1], r[2]) < 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell_bucket" in plan
    assert tables.read(spark, path, SPEC).count() == 300


def polygons(spark):
    """Two triangles and a quad: the square [0, 2] x [0, 2] beside [2, 4] x [0, 1]."""
    from meshlark.polygons import PolygonMesh

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 2.0, 2.0), (4, 0.0, 2.0), (5, 4.0, 0.0), (6, 4.0, 1.0), (7, 2.0, 1.0)], "node long, x double, y double")
    elements = spark.createDataFrame([(10, 2, 0, [1, 2, 3]), (11, 2, 0, [1, 4, 3]), (12, 3, 0, [2, 5, 6, 7]), (13, 1, 9, [5, 6])], "element long, kind int, tag int, nodes array<long>")
    return PolygonMesh.of(nodes, elements, MESH)


def test_polygon_cells_edges_and_normals(spark):
    m = polygons(spark)
    assert {tuple(r) for r in m.volumes().collect()} == {(10, 2.0), (11, 2.0), (12, 2.0)}
    b = m.boundary().collect()
    assert len(b) == 8  # all sides but the diagonal that two triangles share
    middle = {10: (4 / 3, 2 / 3), 11: (2 / 3, 4 / 3), 12: (3.0, 0.5)}
    for r in b:
        inward = [middle[r["mesh_cell"]][d] - r["ax" if d == 0 else "ay"] for d in range(2)]
        assert inward[0] * r["normal_0"] + inward[1] * r["normal_1"] > 0
        assert r["normal_0"] ** 2 + r["normal_1"] ** 2 == pytest.approx(1)
    assert [r["boundary_group"] for r in b if r["ax"] == r["bx"] == 4.0] == [9]


def test_polygon_location_and_sampling(spark):
    m = polygons(spark)
    pts = m.uniform(200, 1)
    assert pts.groupBy("mesh_cell").count().collect() and pts.count() == 600
    found = m.locate(pts.withColumnRenamed("mesh_cell", "was"), [F.col("P_0"), F.col("P_1")], ["was", "k"])
    assert found.where("mesh_cell IS NULL OR mesh_cell <> was").count() == 0
    quad = pts.where("mesh_cell = 12").toPandas()
    assert abs(quad["P_0"].mean() - 3) < 0.1 and abs(quad["P_1"].mean() - 0.5) < 0.06
    values = spark.createDataFrame([(k, 3.0) for k in range(1, 8)], "node long, value double")
    assert {r["n"] for r in m.counts_for(values, 0.5).collect()} == {12}
    assert m.uniform(m.counts_for(values, 0.5), 2).count() == 36


def test_polygon_grid(spark):
    from meshlark.polygons import PolygonMesh

    m = PolygonMesh.grid(spark, 4, 8, 1.0, MESH)
    b = m.boundary().groupBy("boundary_group").count().collect()
    assert {r["boundary_group"]: r["count"] for r in b} == {1: 4, 2: 8, 3: 4, 4: 8}
    g, rows = make(spark, 60)
    got = {r["id"]: r["mesh_cell"] for r in m.locate(g.df, g.positions, ["id"]).collect()}
    assert got == {r[0]: int(r[1]) + 4 * int(r[2]) for r in rows}
