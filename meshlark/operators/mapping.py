"""Where rows belong: owners of cells, point location on polygon meshes, candidate lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import CartesianMesh, linear


def owners(claims: DataFrame) -> DataFrame:
    """(cell, owner) of claims (cell, rank, weight): the greatest weight wins, ties go to the highest rank."""
    return claims.groupBy("cell").agg(F.max(F.struct("weight", "rank")).alias("best")).select("cell", F.col("best.rank").alias("owner"))


def claim_boxes(boxes: DataFrame, mesh: CartesianMesh, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., cell, overlap): overlay cells that a box (lo_0.., hi_0..) meets, and the measure shared."""
    out, w = boxes, mesh.fine_width
    for k, n in enumerate(mesh.fine_dims):
        first = F.least(F.greatest((F.col(f"lo_{k}") / w).cast("bigint"), F.lit(0)), F.lit(n - 1))
        last = F.least(F.greatest((F.col(f"hi_{k}") / w).cast("bigint"), F.lit(0)), F.lit(n - 1))
        out = out.withColumn(f"t_{k}", F.explode(F.sequence(first, last)))
    size = F.lit(1.0)
    for k in range(mesh.ndim):
        size = size * F.greatest(F.least(F.col(f"hi_{k}"), (F.col(f"t_{k}") + 1) * F.lit(w)) - F.greatest(F.col(f"lo_{k}"), F.col(f"t_{k}") * F.lit(w)), F.lit(0.0))
    return out.select(*keep, linear([F.col(f"t_{k}") for k in range(mesh.ndim)], mesh.fine_dims).alias("cell"), size.alias("overlap"))


def bounding_boxes(vertices: DataFrame, by: str, ndim: int = 2) -> DataFrame:
    """(by, lo_k, hi_k) of vertices (by, x_0..)."""
    return vertices.groupBy(by).agg(*(F.min(f"x_{k}").alias(f"lo_{k}") for k in range(ndim)), *(F.max(f"x_{k}").alias(f"hi_{k}") for k in range(ndim)))


def map_owner(df: DataFrame, mesh: CartesianMesh, table: DataFrame, position: list[Column]) -> DataFrame:
    """Adds the owner of the row's overlay cell; a row outside the hierarchy raises an error.

    The planner broadcasts the owner table if its size allows.
    """
    t = mesh.hierarchy_tuple(position)
    bad = t[0] < 0
    for c in t[1:]:
        bad = bad | (c < 0)
    index = F.when(~bad, mesh.hierarchy_index(t)).otherwise(F.raise_error(F.lit("a position is outside the hierarchy")))
    return df.withColumn("__h", index).join(table.select(F.col("cell").alias("__h"), "owner"), "__h", "left").drop("__h")


def departing(df: DataFrame, me: int, ranks: int, column: str = "owner") -> DataFrame:
    """Rows with a valid owner that is not this one."""
    return df.where(F.col(column).between(0, ranks - 1) & (F.col(column) != me))


def last_holding(points: DataFrame, shapes: DataFrame, candidates: DataFrame, mesh: CartesianMesh, position: list[Column], keep: list[str], inside: Callable[[Column], Column]) -> DataFrame:
    """(keep..., mesh_cell): of the candidates (cell, mesh_cell, ord) of a point's overlay cell the last whose shape holds it, null if none.

    shapes is (mesh_cell, sides), sides an array that inside() tests against the columns p_0.. of a
    point. Each overlay cell carries its candidates in order, as many as the mesh has there, so a
    point meets them in one row: points are joined once and never grouped.
    """
    listed = candidates.join(shapes, "mesh_cell").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("ord", "mesh_cell", "sides"))).alias("__listed"))
    at = points.select(*keep, mesh.cell(position).alias("cell"), *(p.alias(f"p_{k}") for k, p in enumerate(position)))
    held = F.filter("__listed", lambda c: inside(c["sides"]))
    # an absent element is null where there is no candidate or none holds the point
    return at.join(listed, "cell", "left").select(*keep, F.try_element_at(held, F.lit(-1))["mesh_cell"].alias("mesh_cell"))


def locate(points: DataFrame, edges: DataFrame, candidates: DataFrame, mesh: CartesianMesh, position: list[Column], keep: list[str]) -> DataFrame:
    """(keep..., mesh_cell): the polygon that holds each point, null if none.

    A grid-bucket join gives candidates (cell of the overlay, mesh_cell, ord); edges is
    (mesh_cell, ax, ay, bx, by). A point on an edge or a corner is inside; of several
    polygons the last candidate wins.
    """
    shapes = edges.groupBy("mesh_cell").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("sides"))
    px, py = F.col("p_0"), F.col("p_1")

    def on(e: Column) -> Column:
        turn = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return (turn == 0) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crosses(e: Column) -> Column:
        return ((e["ay"] > py) != (e["by"] > py)) & F.coalesce(px < e["ax"] + F.try_divide((e["bx"] - e["ax"]) * (py - e["ay"]), e["by"] - e["ay"]), F.lit(False))

    return last_holding(points, shapes, candidates, mesh, position, keep, lambda sides: F.exists(sides, on) | (F.size(F.filter(sides, crosses)) % 2 == 1))


def locate_convex(points: DataFrame, faces: DataFrame, candidates: DataFrame, mesh: CartesianMesh, position: list[Column], keep: list[str], tol: float = 0.0) -> DataFrame:
    """(keep..., mesh_cell): the convex cell of any dimension that holds each point, null if none.

    faces is (mesh_cell, n_0.., d), a half-space n . x >= d a row; a point on a face (or beyond it by
    at most tol) is inside, and of several cells the last candidate wins. Candidates come from a
    grid-bucket join, as in locate().
    """
    names = [f"n_{k}" for k in range(len(position))]
    shapes = faces.groupBy("mesh_cell").agg(F.collect_list(F.struct(*names, "d")).alias("sides"))

    def above(f: Column) -> Column:
        height = -f["d"]
        for k, n in enumerate(names):
            height = height + f[n] * F.col(f"p_{k}")
        return height >= -tol

    return last_holding(points, shapes, candidates, mesh, position, keep, lambda sides: F.forall(sides, above))


def local_move(rows: DataFrame, mesh: CartesianMesh, owner: DataFrame, before: str, after: str, stencil: int = 1) -> DataFrame:
    """Rows with the owners of their cells before and after a step, as from and to; owner is (cell, owner).

    A local move reaches only owners that have a cell in the neighbourhood (periodic, `stencil` cells
    wide) of the owner left; a row beyond raises an error. hybrid_move() has no such bound.
    """
    return _moved(rows, mesh, owner, before, after, stencil).withColumn("to", F.when(F.col("how") != "global", F.col("to")).otherwise(F.raise_error(F.lit("a local move to an owner that is no neighbour")))).drop("how")


def hybrid_move(rows: DataFrame, mesh: CartesianMesh, owner: DataFrame, before: str, after: str, stencil: int = 1) -> DataFrame:
    """Rows with from, to and how: stay, local (to a neighbouring owner) or global."""
    return _moved(rows, mesh, owner, before, after, stencil)


def _moved(rows: DataFrame, mesh: CartesianMesh, owner: DataFrame, before: str, after: str, stencil: int) -> DataFrame:
    near = mesh.neighbours(owner, stencil, True).join(owner.select("cell", F.col("owner").alias("from")), "cell")
    near = near.join(owner.select(F.col("cell").alias("neighbour"), F.col("owner").alias("to")), "neighbour").select("from", "to").distinct().withColumn("__near", F.lit(True))
    out = rows.join(owner.select(F.col("cell").alias(before), F.col("owner").alias("from")), before).join(owner.select(F.col("cell").alias(after), F.col("owner").alias("to")), after)
    how = F.when(F.col("from") == F.col("to"), "stay").when(F.col("__near"), "local").otherwise("global")
    return out.join(near, ["from", "to"], "left").withColumn("how", how).drop("__near")


def straight_steps(df: DataFrame, start: list[Column], target: list[str], steps: int, tol: float = 1e-6) -> DataFrame:
    """Rows moved from start to their target columns in equal steps, then put on the target exactly.

    A row whose sum of steps is further than tol from its target raises an error.
    """
    out = df
    for s, t in zip(start, target):
        step = (F.col(t) - s) / F.lit(float(steps))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), s.cast("double"), lambda x, _: x + step)
        drift = F.abs(end - F.col(t)) <= tol
        out = out.withColumn(f"__{t}", F.when(drift, F.col(t)).otherwise(F.raise_error(F.lit("a row missed its target"))))
    return out.withColumns({t: F.col(f"__{t}") for t in target}).drop(*(f"__{t}" for t in target))


def exchange(contributions: DataFrame, by: str = "geom_id", value: str = "value") -> DataFrame:
    """Sums per surface element; the reverse is a join on the element."""
    return contributions.groupBy(by).agg(F.sum(value).alias(value))
