"""Unstructured meshes of tetrahedra, hexahedra, prisms and pyramids, as tables of cells and faces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import rng
from .mesh import CartesianMesh
from .operators import mapping

#: Element kinds of gmsh files (fixed values) and the places of the nodes of each face.
TETRAHEDRON, HEXAHEDRON, PRISM, PYRAMID = 4, 5, 6, 7
FACES = {
    TETRAHEDRON: [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)],
    HEXAHEDRON: [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
    PRISM: [(0, 1, 2), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    PYRAMID: [(0, 1, 2, 3), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
}
#: Kinds of marked faces: triangle, quad.
MARKED = (2, 3)


def _at(array: Column, k: int) -> Column:
    return F.element_at(array, k + 1)


def _minus(a: Column, b: Column) -> list[Column]:
    return [_at(a, d) - _at(b, d) for d in range(3)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _mean(points: Column, d: int) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + _at(p, d)) / F.size(points)


@dataclass(frozen=True)
class PolyhedralMesh:
    """cells: (mesh_cell, kind, nodes, points), nodes in their kind's order; marks: (face, tag), face the sorted nodes.

    Cells are convex with plane faces. overlay: the Cartesian mesh that finds candidate cells; it
    must cover the cells.
    """

    cells: DataFrame
    marks: DataFrame
    overlay: CartesianMesh

    @staticmethod
    def of(nodes: DataFrame, elements: DataFrame, overlay: CartesianMesh) -> "PolyhedralMesh":
        """From (node, x, y, z) and (element, kind, tag, nodes), as export.read_gmsh gives them."""
        flat = elements.where(F.col("kind").isin(*FACES)).select(F.col("element").alias("mesh_cell"), "kind", F.posexplode("nodes").alias("k", "node"))
        corner = F.array_sort(F.collect_list(F.struct("k", "node", F.array("x", "y", "z").alias("p"))))  # eight a cell at most
        cells = flat.join(nodes.select("node", "x", "y", "z"), "node").groupBy("mesh_cell", "kind").agg(corner.alias("c"))
        marks = elements.where(F.col("kind").isin(*MARKED)).select(F.array_sort("nodes").alias("face"), "tag")
        return PolyhedralMesh(cells.select("mesh_cell", "kind", F.col("c.node").alias("nodes"), F.col("c.p").alias("points")), marks, overlay)

    def vertices(self) -> DataFrame:
        """(mesh_cell, k, node, x_0, x_1, x_2) of every cell's corners."""
        rows = self.cells.select("mesh_cell", F.posexplode(F.arrays_zip("nodes", "points")).alias("k", "c"))
        return rows.select("mesh_cell", "k", "c.nodes", *(_at(F.col("c.points"), d).alias(f"x_{d}") for d in range(3))).withColumnRenamed("nodes", "node")

    def centres(self) -> DataFrame:
        """(mesh_cell, x_0, x_1, x_2): the mean of each cell's corners."""
        return self.vertices().groupBy("mesh_cell").agg(*(F.avg(f"x_{d}").alias(f"x_{d}") for d in range(3)))

    def faces(self) -> DataFrame:
        """(mesh_cell, k, face, corners, n_0, n_1, n_2, d): sorted nodes, corners in order, inward normal and n . corner; not of unit length."""
        places = F.lit(None).cast("array<array<int>>")
        for kind, faces in FACES.items():
            places = F.when(F.col("kind") == kind, F.array(*(F.array(*map(F.lit, f)) for f in faces))).otherwise(places)
        middle = F.array(*(_mean(F.col("points"), d) for d in range(3)))
        rows = self.cells.select("mesh_cell", "nodes", "points", middle.alias("middle"), F.posexplode(places).alias("k", "at"))
        pick = lambda name: F.transform("at", lambda i: F.element_at(F.col(name), i + 1))
        rows = rows.select("mesh_cell", "k", "middle", F.array_sort(pick("nodes")).alias("face"), pick("points").alias("corners"))
        p = [F.element_at("corners", k) for k in (1, 2, 3)]
        rows = rows.withColumn("n", F.array(*_cross(_minus(p[1], p[0]), _minus(p[2], p[0]))))
        n = [_at(F.col("n"), d) for d in range(3)]
        sign = F.when(_dot(n, _minus(F.col("middle"), p[0])) < 0, -1.0).otherwise(1.0)
        rows = rows.withColumn("n", F.transform("n", lambda x: x * sign))
        return rows.select("mesh_cell", "k", "face", "corners", *(n[d].alias(f"n_{d}") for d in range(3)), _dot(n, [_at(p[0], d) for d in range(3)]).alias("d"))

    def volumes(self) -> DataFrame:
        """(mesh_cell, volume): cones from the cell's first corner to its faces, cut into triangles."""
        heads = self.cells.select("mesh_cell", F.element_at("points", 1).alias("head"))
        f = self.faces().join(heads, "mesh_cell")
        head, first = F.col("head"), F.element_at("corners", 1)

        def cone(k: Column) -> Column:
            a, b = (_minus(F.element_at("corners", k + i), first) for i in (0, 1))
            return F.abs(_dot(_cross(a, b), _minus(head, first))) / 6.0

        parts = F.aggregate(F.sequence(F.lit(2), F.size("corners") - 1), F.lit(0.0), lambda s, k: s + cone(k))
        return f.groupBy("mesh_cell").agg(F.sum(parts).alias("volume"))

    def boundary(self) -> DataFrame:
        """(face, mesh_cell, boundary_group, corners, normal_0, normal_1, normal_2) of faces that one cell has; unit normals point inwards."""
        f = self.faces()
        once = f.groupBy("face").agg(F.count("*").alias("times")).where("times = 1").select("face")
        length = F.sqrt(_dot([F.col(f"n_{d}") for d in range(3)], [F.col(f"n_{d}") for d in range(3)]))
        marked = f.join(once, "face").join(self.marks.select("face", F.col("tag").alias("boundary_group")), "face", "left")
        return marked.select("face", "mesh_cell", "boundary_group", "corners", *((F.col(f"n_{d}") / length).alias(f"normal_{d}") for d in range(3)))

    def candidates(self) -> DataFrame:
        """(cell, mesh_cell, ord): overlay cells and the cells whose boxes meet them."""
        boxes = mapping.bounding_boxes(self.vertices(), "mesh_cell", 3)
        return mapping.claim_boxes(boxes, self.overlay, ("mesh_cell",)).select("cell", "mesh_cell", F.col("mesh_cell").alias("ord"))

    def locate(self, df: DataFrame, position: list[Column], keep: list[str], tol: float = 0.0) -> DataFrame:
        """(keep..., mesh_cell) of each point; null outside."""
        return mapping.locate_convex(df, self.faces().select("mesh_cell", "n_0", "n_1", "n_2", "d"), self.candidates(), self.overlay, position, keep, tol)

    def uniform(self, wanted: DataFrame, seed: int) -> DataFrame:
        """(mesh_cell, k, P_0, P_1, P_2): n points (column of wanted, with mesh_cell) uniform in each tetrahedron; other kinds raise."""
        rows = self.cells.join(wanted, "mesh_cell").where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)))
        row = [F.col("mesh_cell"), F.col("k")]
        # three sorted uniform numbers cut the unit length into four uniform weights
        cuts = F.array_sort(F.array(*(rng.uniform(seed, 4, row, c) for c in range(3))))
        known = F.when(F.col("kind") == TETRAHEDRON, cuts).otherwise(F.raise_error(F.lit("points are drawn in tetrahedra only")))
        rows = rows.withColumn("cuts", known)
        c = [F.lit(0.0), *(F.element_at("cuts", k) for k in (1, 2, 3)), F.lit(1.0)]
        point = [sum(((c[k + 1] - c[k]) * _at(F.element_at("points", k + 1), d) for k in range(4)), F.lit(0.0)) for d in range(3)]
        return rows.select("mesh_cell", "k", *(p.alias(f"P_{d}") for d, p in enumerate(point)))
