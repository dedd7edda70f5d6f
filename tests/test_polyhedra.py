"""Meshes of mixed polyhedra, product rows and profiles."""

import json
import time

import pytest
from pyspark.sql import functions as F

from meshlark import INT, CartesianMesh, Prop, Spec
from meshlark.operators import products
from meshlark.polyhedra import HEXAHEDRON, PRISM, PYRAMID, TETRAHEDRON, PolyhedralMesh
from meshlark.sources import export, metrics

#: A unit cube, a prism beside it, a pyramid on top and a tetrahedron on the pyramid's east side.
NODES = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1), (2, 0, 0), (2, 0, 1), (0.5, 0.5, 2), (2, 0.5, 2)]
CELLS = [(0, HEXAHEDRON, [0, 1, 2, 3, 4, 5, 6, 7]), (1, PRISM, [1, 8, 2, 5, 9, 6]), (2, PYRAMID, [4, 5, 6, 7, 10]), (3, TETRAHEDRON, [5, 6, 10, 11])]


@pytest.fixture(scope="module")
def mesh(spark):
    nodes = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(NODES)], "node long, x double, y double, z double")
    elements = spark.createDataFrame([(e, k, 0, n) for e, k, n in CELLS] + [(90, 3, 7, [0, 1, 2, 3])], "element long, kind int, tag int, nodes array<long>")
    return PolyhedralMesh.of(nodes, elements, CartesianMesh((3, 3, 3)))


def test_volumes_centres_and_faces(mesh):
    got = {r["mesh_cell"]: r["volume"] for r in mesh.volumes().collect()}
    det = abs(-0.5 * (1 * 1 - 1 * 0.5) * 0 + 1 * ((-0.5) * 1 - 1 * 1))  # of the edges (0,1,0), (-.5,.5,1), (1,.5,1) of the tetrahedron
    assert got == pytest.approx({0: 1.0, 1: 0.5, 2: 1 / 3, 3: det / 6})
    centre = {r["mesh_cell"]: (r["x_0"], r["x_1"], r["x_2"]) for r in mesh.centres().collect()}
    assert centre[0] == (0.5, 0.5, 0.5) and centre[2] == pytest.approx((0.5, 0.5, 1.2))
    faces = mesh.faces().groupBy("mesh_cell").count().collect()
    assert {r["mesh_cell"]: r["count"] for r in faces} == {0: 6, 1: 5, 2: 5, 3: 4}
    assert mesh.vertices().count() == 8 + 6 + 5 + 4


def test_boundary(mesh):
    b = mesh.boundary().collect()
    assert len(b) == 6 + 5 + 5 + 4 - 2 * 3  # three faces join two cells
    marked = [r for r in b if r["boundary_group"] == 7]
    assert len(marked) == 1 and [marked[0][f"normal_{d}"] for d in range(3)] == [0.0, 0.0, 1.0]
    assert all(abs(sum(r[f"normal_{d}"] ** 2 for d in range(3)) - 1) < 1e-12 for r in b)


def test_location(spark, mesh):
    points = [(0.5, 0.5, 0.5, 0), (1.25, 0.25, 0.5, 1), (0.5, 0.5, 1.5, 2), (1.1, 0.5, 1.6, 3), (1.0, 0.25, 0.5, 1), (0.25, 0.5, 1.0, 2), (1.9, 0.9, 0.5, None), (0.5, 0.5, 2.0, 3), (0.0, 0.0, 0.0, 0), (2.9, 2.9, 2.9, None), (-1.0, 0.5, 0.5, None)]
    df = spark.createDataFrame([(k, *p[:3]) for k, p in enumerate(points)], "id long, x double, y double, z double")
    got = {r["id"]: r["mesh_cell"] for r in mesh.locate(df, [F.col(c) for c in "xyz"], ["id"]).collect()}
    assert got == {k: p[3] for k, p in enumerate(points)}


def test_points_are_drawn_in_tetrahedra_only(spark, mesh):
    wanted = lambda cell: spark.createDataFrame([(cell, 200)], "mesh_cell long, n long")
    drawn = mesh.uniform(wanted(3), 1)
    found = mesh.locate(drawn.withColumnRenamed("mesh_cell", "own"), [F.col(f"P_{d}") for d in range(3)], ["own", "k"], 1e-12)
    assert found.where("mesh_cell = 3").count() == 200
    mean = drawn.agg(*(F.avg(f"P_{d}") for d in range(3))).first()
    assert list(mean) == pytest.approx([1.125, 0.5, 1.5], abs=0.06)
    with pytest.raises(Exception, match="tetrahedra only"):
        mesh.uniform(wanted(0), 1).collect()


def test_product_rows(spark):
    spec = Spec((Prop("A"), Prop("N", 2, INT)))
    made = products.Rows.zeros(spark, 3, spec)
    made = made.add(spark.createDataFrame([(0, 1.5, 2), (0, 2.5, 3), (2, 1.0, 4)], "row long, A_0 double, N_1 long"))
    made = made.write(spark.createDataFrame([(2, 9)], "row long, N_0 long")).add(spark.createDataFrame([(2, 1)], "row long, N_0 long"))
    assert sorted(map(tuple, made.table.collect())) == [(0, 4.0, 0, 5), (1, 0.0, 0, 0), (2, 1.0, 10, 4)]
    assert made.table.schema["N_0"].dataType.simpleString() == "bigint" and made.table.schema["A_0"].dataType.simpleString() == "double"
    assert [tuple(r) for r in made.read(spark.createDataFrame([(2,), (7,)], "row long")).orderBy("row").collect()] == [(2, 1.0, 10, 4), (7, None, None, None)]
    with pytest.raises(Exception, match="no product row"):
        made.add(spark.createDataFrame([(5, 1.0)], "row long, A_0 double")).table.collect()
    with pytest.raises(KeyError):
        made.add(spark.createDataFrame([(0, 1.0)], "row long, B_0 double"))


def test_profiles(spark, tmp_path):
    seen = metrics.Regions()
    with seen.region("a", "outer"):
        with seen.region("a", "inner"):
            time.sleep(0.02)
        seen.observe(spark.range(10), "b", "rows", Spec((Prop("A"),)), 3).write.format("noop").mode("overwrite").save()
    rows = {r["key2"]: r for r in seen.rows()}
    assert rows["inner"]["level"] == 1 and rows["inner"]["end"] - rows["inner"]["start"] >= 0.02
    assert (rows["rows"]["rows"], rows["rows"]["bytes"], rows["rows"]["flops"]) == (10, 80, 30)
    profile = json.loads(seen.json(4))
    assert profile["rank"] == 4 and [r[:2] for r in profile["regions"]] == [["a", "outer"], ["a", "inner"], ["b", "rows"]]
    (tmp_path / "p.json").write_text(seen.json(4))
    got = metrics.trace_events(spark, str(tmp_path / "p.json")).collect()
    assert {(r["name"], r["pid"], r["ph"]) for r in got} == {("a:outer", 4, "X"), ("a:inner", 4, "X"), ("b:rows", 4, "X")} and all(r["dur"] >= 1 for r in got)
    assert metrics.trace_events(spark, str(tmp_path / "p.json"), 0.0, 1.0).count() == 0


def test_a_mesh_file_in_3d(spark, tmp_path, monkeypatch):
    p = tmp_path / "m.msh"
    p.write_text("$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 4 1 4\n3 1 0 4\n1\n2\n3\n4\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n$EndNodes\n$Elements\n2 2 1 2\n2 5 2 1\n1 3 1 2\n3 1 4 1\n2 1 2 3 4\n$EndElements\n")
    nodes, elements = export.read_gmsh(spark, str(p))
    mesh = PolyhedralMesh.of(nodes, elements, CartesianMesh((1, 1, 1)))
    assert mesh.volumes().first()["volume"] == pytest.approx(1 / 6)
    assert [(r["boundary_group"], r["normal_2"]) for r in mesh.boundary().where("boundary_group IS NOT NULL").collect()] == [(5, 1.0)]
    monkeypatch.setattr(export, "MESH_BYTES", 100)
    with pytest.raises(ValueError, match="tables of nodes"):
        export.read_gmsh(spark, str(p))
