"""VTKHDF files: their bytes against the format, round trips, and bounded files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark import CartesianMesh
from meshlark.sources import export, vtkhdf


def test_bytes_follow_the_format():
    data = vtkhdf.grid_file(np.array([9]), np.array([4]), np.arange(12.0).reshape(4, 3), {"w": np.array([2.5])}, {})
    assert data[:8] == b"\x89HDF\r\n\x1a\n" and struct.unpack_from("<Q", data, 40)[0] == len(data)
    assert struct.unpack_from("<HH", data, 16) == (32, 16)  # half the symbols of a leaf and children of a node
    root, cached, tree, heap = *struct.unpack_from("<QI", data, 64), *struct.unpack_from("<QQ", data, 80)
    assert cached == 1 and data[tree : tree + 4] == b"TREE" and data[heap : heap + 4] == b"HEAP" and data[root] == 1
    leaf = struct.unpack_from("<Q", data, tree + 32)[0]
    assert data[leaf : leaf + 4] == b"SNOD" and all(a % 8 == 0 for a in (root, tree, heap, leaf))
    # names in a leaf are sorted, and the tree's last key is the last name
    r = vtkhdf.Reader(data)
    top = r.members(r.root)["VTKHDF"]
    names = list(r.members(top))
    assert names == sorted(names) == ["CellData", "Connectivity", "NumberOfCells", "NumberOfConnectivityIds", "NumberOfPoints", "Offsets", "PointData", "Points", "Types"]
    a = r.attributes(top)
    assert a["Version"].tolist() == [1, 0] and a["Type"].tobytes() == b"UnstructuredGrid" and a["Type"].shape == ()
    float_type = dict(r.messages(r.members(top)["Points"]))[3]
    assert float_type[:20].hex() == "11203f00080000000000400034" + "0b0034ff030000"
    with pytest.raises(ValueError):
        vtkhdf.Reader(b"x" * 200)


def test_grids_of_mixed_and_no_cells():
    types, sizes = np.array([5, 9, 10]), np.array([3, 4, 4])
    points = np.random.default_rng(1).normal(size=(11, 3))
    g = vtkhdf.Reader(vtkhdf.grid_file(types, sizes, points, {"a": np.array([1.5, 2, 3]), "n": np.array([1, 2, -3], np.int64)}, {"p": np.arange(11.0)})).grid()
    assert g["types"].tolist() == [5, 9, 10] and g["offsets"].tolist() == [0, 3, 7, 11] and (g["points"] == points).all()
    assert g["CellData"]["a"].tolist() == [1.5, 2, 3] and g["CellData"]["n"].tolist() == [1, 2, -3] and (g["PointData"]["p"] == np.arange(11.0)).all()
    empty = vtkhdf.Reader(vtkhdf.grid_file(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 3)), {}, {})).grid()
    assert empty["types"].size == 0 and empty["points"].shape == (0, 3) and empty["CellData"] == {}


def test_files_of_a_mesh_are_bounded(spark, tmp_path):
    mesh = CartesianMesh((3, 2, 2), 0.5, 1)
    cells = vtkhdf.cells_of(export.cell_outlines(spark, mesh), 3).withColumn("w", F.col("cell") * 0.5).withColumn("h", F.transform("points", lambda p: F.element_at(p, 3)))
    n = vtkhdf.write(cells, str(tmp_path / "grid"), cells_per_file=10)
    assert n == len(list((tmp_path / "grid").iterdir())) >= mesh.ncells / 10 and not (tmp_path / "grid-attempts").exists()
    got = vtkhdf.read(spark, str(tmp_path / "grid")).collect()
    assert sorted(r["cell_data"]["cell"] for r in got) == list(range(mesh.ncells))
    for r in got:
        assert r["kind"] == 12 and r["cell_data"]["w"] == r["cell_data"]["cell"] / 2
        p = np.array(r["points"])
        # a viewer's hexahedron: the bottom counter-clockwise, then the top above it
        assert (p[4:] - p[:4] == [0, 0, 0.25]).all() and (p[1] - p[0]).tolist() == [0.25, 0, 0] and (p[3] - p[0]).tolist() == [0, 0.25, 0]
        assert r["point_data"]["h"] == p[:, 2].tolist()
