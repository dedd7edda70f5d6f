"""Unstructured meshes of triangles and convex quads, as tables of cells and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rng
from .mesh import CartesianMesh
from .operators import mapping

#: Element kinds of gmsh files that are read (fixed values): line, triangle, quad.
LINE, TRIANGLE, QUAD = 1, 2, 3


def at(name: str, k: Column | int) -> Column:
    """Element k (from 0) of an array column."""
    return F.element_at(F.col(name), F.lit(k + 1) if isinstance(k, int) else (k + 1).cast("int"))


@dataclass(frozen=True)
class PolygonMesh:
    """cells: (mesh_cell, nodes, xs, ys), corners in order; lines: (a, b, tag) of marked edges, a < b.

    overlay: the Cartesian mesh that finds candidate cells; it must cover the polygons.
    """

    cells: DataFrame
    lines: DataFrame
    overlay: CartesianMesh

    @staticmethod
    def of(nodes: DataFrame, elements: DataFrame, overlay: CartesianMesh) -> "PolygonMesh":
        """From (node, x, y) and (element, kind, tag, nodes)."""
        flat = elements.where(F.col("kind").isin(TRIANGLE, QUAD)).select(F.col("element").alias("mesh_cell"), F.posexplode("nodes").alias("k", "node"))
        corner = F.array_sort(F.collect_list(F.struct("k", "node", "x", "y")))  # three or four a cell
        cells = flat.join(nodes.select("node", "x", "y"), "node").groupBy("mesh_cell").agg(corner.alias("c"))
        cells = cells.select("mesh_cell", *(F.col("c").getField(f).alias(n) for f, n in (("node", "nodes"), ("x", "xs"), ("y", "ys"))))
        lines = elements.where(F.col("kind") == LINE).select(F.array_min("nodes").alias("a"), F.array_max("nodes").alias("b"), "tag")
        return PolygonMesh(cells, lines, overlay)

    @staticmethod
    def grid(spark: SparkSession, nx: int, ny: int, width: float, overlay: CartesianMesh) -> "PolygonMesh":
        """nx x ny squares; the sides are marked 1 (south), 2 (east), 3 (north), 4 (west)."""
        n = F.col("id")
        nodes = spark.range((nx + 1) * (ny + 1)).select(n.alias("node"), (n % (nx + 1) * F.lit(width)).alias("x"), (F.floor(n / (nx + 1)) * F.lit(width)).alias("y"))
        low = F.floor(n / nx).cast("bigint") * (nx + 1) + n % nx
        quads = spark.range(nx * ny).select(n.alias("element"), F.lit(QUAD).alias("kind"), F.lit(0).alias("tag"), F.array(low, low + 1, low + nx + 2, low + nx + 1).alias("nodes"))

        def side(count: int, first: int, step: int, tag: int) -> DataFrame:
            a = F.lit(first) + n * step
            return spark.range(count).select((n + 10**9 * tag).alias("element"), F.lit(LINE).alias("kind"), F.lit(tag).alias("tag"), F.array(a, a + step).alias("nodes"))

        sides = [side(nx, 0, 1, 1), side(ny, nx, nx + 1, 2), side(nx, ny * (nx + 1), 1, 3), side(ny, 0, nx + 1, 4)]
        elements = quads
        for s in sides:
            elements = elements.union(s)
        return PolygonMesh.of(nodes, elements, overlay)

    def edges(self) -> DataFrame:
        """(mesh_cell, k, a, b, ax, ay, bx, by) of every cell's sides, in order."""
        n, k = F.size("nodes"), F.col("k")
        rows = self.cells.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
        after = (k + 1) % n
        return rows.select("mesh_cell", "k", at("nodes", k).alias("a"), at("nodes", after).alias("b"), at("xs", k).alias("ax"), at("ys", k).alias("ay"), at("xs", after).alias("bx"), at("ys", after).alias("by"))

    def vertices(self) -> DataFrame:
        """(mesh_cell, k, node, x_0, x_1) of every cell's corners, in order."""
        rows = self.cells.select("mesh_cell", F.posexplode(F.arrays_zip("nodes", "xs", "ys")).alias("k", "c"))
        return rows.select("mesh_cell", "k", F.col("c.nodes").alias("node"), F.col("c.xs").alias("x_0"), F.col("c.ys").alias("x_1"))

    def centres(self) -> DataFrame:
        """(mesh_cell, x_0, x_1): the mean of each cell's corners."""
        mean = lambda name: F.aggregate(name, F.lit(0.0), lambda a, x: a + x) / F.size(name)
        return self.cells.select("mesh_cell", mean("xs").alias("x_0"), mean("ys").alias("x_1"))

    def labelled(self, tag: int) -> DataFrame:
        """(node) of the corners of the edges marked with a tag."""
        return self.lines.where(F.col("tag") == tag).select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def volumes(self) -> DataFrame:
        """(mesh_cell, volume)."""
        return self.edges().groupBy("mesh_cell").agg((F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2).alias("volume"))

    def boundary(self) -> DataFrame:
        """(edge, mesh_cell, boundary_group, ax.., normal_0, normal_1) of sides that one cell has; normals point inwards."""
        e = self.edges()
        turned = e.groupBy("mesh_cell").agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("area"))
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        once = e.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
        own = e.withColumns({"lo": lo, "hi": hi}).join(once, ["lo", "hi"]).join(turned, "mesh_cell")
        marked = own.join(self.lines.select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("tag").alias("boundary_group")), ["lo", "hi"], "left")
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        length, sign = F.sqrt(dx * dx + dy * dy), F.signum("area")
        return marked.select((F.shiftleft(F.col("lo"), 31) + F.col("hi")).alias("edge"), "mesh_cell", "boundary_group", "ax", "ay", "bx", "by", (-sign * dy / length).alias("normal_0"), (sign * dx / length).alias("normal_1"))

    def candidates(self) -> DataFrame:
        """(cell, mesh_cell, ord): overlay cells and the polygons whose boxes meet them."""
        boxes = self.cells.select("mesh_cell", F.array_min("xs").alias("lo_0"), F.array_max("xs").alias("hi_0"), F.array_min("ys").alias("lo_1"), F.array_max("ys").alias("hi_1"))
        return mapping.claim_boxes(boxes, self.overlay, ("mesh_cell",)).select("cell", "mesh_cell", F.col("mesh_cell").alias("ord"))

    def locate(self, df: DataFrame, position: list[Column], keep: list[str]) -> DataFrame:
        """(keep..., mesh_cell) of each point; null outside."""
        return mapping.locate(df, self.edges().select("mesh_cell", "ax", "ay", "bx", "by"), self.candidates(), self.overlay, position, keep)

    def uniform(self, per_cell: int | DataFrame, seed: int) -> DataFrame:
        """(mesh_cell, k, P_0, P_1): points uniform in each cell; per_cell is a number or a table (mesh_cell, n).

        A quad is two triangles of a fan, chosen by area.
        """
        n = self.cells.withColumn("n", F.lit(per_cell)) if isinstance(per_cell, int) else self.cells.join(per_cell, "mesh_cell")
        rows = n.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
        row = [F.col("mesh_cell"), F.col("k")]
        u, v, w = (rng.uniform(seed, 3, row, c) for c in range(3))

        def area(i: int | Column, j: int | Column) -> Column:
            return F.abs((at("xs", i) - at("xs", 0)) * (at("ys", j) - at("ys", 0)) - (at("xs", j) - at("xs", 0)) * (at("ys", i) - at("ys", 0)))

        quad = F.size("xs") == 4
        first = ~quad | (w * (area(1, 2) + F.when(quad, area(2, F.size("xs") - 1)).otherwise(0.0)) < area(1, 2))
        i, j = F.when(first, 1).otherwise(2), F.when(first, 2).otherwise(F.size("xs") - 1)
        s = F.sqrt(u)
        weights = [1.0 - s, s * (1.0 - v), s * v]
        point = [weights[0] * at(c, 0) + weights[1] * at(c, i) + weights[2] * at(c, j) for c in ("xs", "ys")]
        return rows.select("mesh_cell", "k", point[0].alias("P_0"), point[1].alias("P_1"))

    def counts_for(self, values: DataFrame, weight: float) -> DataFrame:
        """(mesh_cell, n): rows of one weight for a density given at nodes (node, value): average times volume over weight."""
        flat = self.cells.select("mesh_cell", F.explode("nodes").alias("node")).join(values, "node")
        mean = flat.groupBy("mesh_cell").agg(F.avg("value").alias("average"))
        mass = F.greatest(F.col("average") * F.col("volume"), F.lit(0.0))
        return mean.join(self.volumes(), "mesh_cell").select("mesh_cell", F.floor(mass / F.lit(weight) + F.lit(0.5)).cast("bigint").alias("n"))
