"""Boundaries: hits of steps with a Cartesian domain or polygon edges, truncation, reflection, surface functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import meets_aligned, segments_meet
from ..mesh import CartesianMesh, linear

#: Inward normals of the facets (fixed values): south, east, north, west, bottom, top.
NORMALS = [(0, 1, 0), (-1, 0, 0), (0, -1, 0), (1, 0, 0), (0, 0, 1), (0, 0, -1)]
#: Per normal dimension: the facet at the low and at the high end (fixed values).
FACETS = {1: (0, 2), 0: (3, 1), 2: (4, 5)}


def departing(mesh: CartesianMesh, position: list[Column]) -> Column:
    """Whether a position lies on or beyond the domain's boundary."""
    out = F.lit(False)
    for p, e in zip(position, mesh.extents):
        out = out | (p <= 0.0) | (p >= e)
    return out


def trajectory_hits(df: DataFrame, mesh: CartesianMesh, previous: list[Column], position: list[Column], groups: dict[int, int], tol: float = 1e-10) -> DataFrame:
    """Departing rows with facet, boundary group, hit point, inward normal and face element.

    Added columns: facet, boundary_group (null if the facet is in none), point_k, normal_k,
    element. A departing row without a hit raises an error. In 2-D a hit of the south or north
    facet wins over east or west; in 3-D the last of (z, y, x) wins.
    """
    low, high = [F.lit(0.0)] * mesh.ndim, [F.lit(e) for e in mesh.extents]
    order = [0, 1] if mesh.ndim == 2 else [2, 1, 0]  # later ones win
    facet, point = F.lit(None).cast("int"), [F.lit(None).cast("double")] * mesh.ndim
    for axis in order:
        base = position[axis] - F.lit(tol) <= 0.0
        level = F.when(base, F.lit(0.0)).otherwise(high[axis])
        hit = meets_aligned(previous, position, axis, level, low, high, tol)
        facet = F.when(hit["hit"], F.when(base, FACETS[axis][0]).otherwise(FACETS[axis][1])).otherwise(facet)
        point = [F.when(hit["hit"], hit[f"x_{d}"]).otherwise(point[d]) for d in range(mesh.ndim)]
    gone = departing(mesh, position)
    # the optimiser may test later filters before this one, so only departing rows may raise
    facet = F.when(facet.isNull() & gone, F.raise_error(F.lit("a departing row meets no facet"))).otherwise(facet)
    # a generator computes the hit once; what follows refers to its columns instead of repeating it
    found = F.struct(facet.cast("int").alias("facet"), *(p.alias(f"point_{d}") for d, p in enumerate(point)))
    out = df.where(gone).select("*", F.inline(F.array(found)))
    at = mesh.cell_tuple([F.col(f"point_{d}") for d in range(mesh.ndim)])
    normals = F.array(*(F.array(*(F.lit(float(x)) for x in n)) for n in NORMALS))
    group = F.lit(None).cast("int")
    for f, g in groups.items():
        group = F.when(F.col("facet") == f, F.lit(g)).otherwise(group)
    return out.withColumns({"boundary_group": group, **{f"normal_{d}": F.element_at(F.element_at(normals, F.col("facet") + 1), d + 1) for d in range(mesh.ndim)}, "element": mesh.face_index(F.col("facet"), at)})


def has_boundary_columns(df: DataFrame, ndim: int) -> bool:
    """Whether the columns that a hit adds are present."""
    return {"boundary_group", "element", *(f"point_{d}" for d in range(ndim)), *(f"normal_{d}" for d in range(ndim))} <= set(df.columns)


def truncate(df: DataFrame, ndim: int, reset_distance: float, position: str = "P", previous: str = "PP", step: str = "TSP") -> DataFrame:
    """Moves rows back by reset_distance before their hit and scales the last step to the share achieved.

    A row whose way from its previous position to the hit is no longer than that distance returns
    to the previous position. The share is the hit's way over the whole way, 1 for a row that
    hardly moved.
    """
    dims = range(ndim)
    way = lambda a, b: F.sqrt(sum((F.pow(F.col(f"{a}_{d}") - F.col(f"{b}_{d}"), 2.0) for d in dims), F.lit(0.0)))
    # a generator computes both lengths once
    ways = F.array(F.struct(way(previous, "point").alias("__to_hit"), way(previous, position).alias("__whole")))
    out = df.select("*", F.inline(ways))
    part = F.try_divide(F.lit(reset_distance), F.col("__to_hit"))
    place = {f"{position}_{d}": F.when(F.col("__to_hit") > reset_distance, F.col(f"point_{d}") + (F.col(f"{previous}_{d}") - F.col(f"point_{d}")) * part).otherwise(F.col(f"{previous}_{d}")) for d in dims}
    if f"{step}_0" in df.columns:
        share = F.when(F.col("__whole") > 1e-16, F.least(F.lit(1.0), F.try_divide(F.col("__to_hit"), F.col("__whole")))).otherwise(F.lit(1.0))
        done, last = F.col(f"{step}_0"), F.col(f"{step}_1")
        place |= {f"{step}_0": done - last * (1.0 - share), f"{step}_1": last * share}
    return out.withColumns(place).drop("__to_hit", "__whole")


def reflect(df: DataFrame, ndim: int, reset_distance: float, velocity: str = "V", **names: str) -> DataFrame:
    """Truncation, then the velocity mirrored in the hit's normal."""
    v, n = ([F.col(f"{c}_{d}") for d in range(ndim)] for c in (velocity, "normal"))
    along = sum((a * b for a, b in zip(v, n)), F.lit(0.0))
    out = truncate(df, ndim, reset_distance, **names)
    return out.withColumns({f"{velocity}_{d}": v[d] - 2.0 * along * n[d] for d in range(ndim)})


def surface_function(df: DataFrame, value: Column, scale: float) -> DataFrame:
    """(element, value): contributions of hits, times scale (1/width in 2-D)."""
    return df.groupBy("element").agg((F.sum(value) * F.lit(scale)).alias("value"))


def surface_evaluate(df: DataFrame, function: DataFrame, name: str) -> DataFrame:
    """Each hit's value of a surface function; zero where nothing was contributed."""
    return df.join(function.select("element", F.col("value").alias(name)), "element", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def nearest_edge(steps: DataFrame, edges: DataFrame, mesh: CartesianMesh, previous: list[Column], position: list[Column], key: str = "id", tol: float = 1e-10) -> DataFrame:
    """(key, edge, boundary_group, x, y): the first boundary edge that each step meets, if any.

    Steps and edges (edge, boundary_group, ax, ay, bx, by) meet in the overlay cells that their
    boxes cover; the hit nearest to the step's start wins, the smallest edge on a tie.
    """
    def cells(df: DataFrame, a: list[Column], b: list[Column]) -> DataFrame:
        for k, n in enumerate(mesh.fine_dims):
            w = F.lit(1.0 / mesh.fine_width)
            lo = F.least(F.greatest((F.least(a[k], b[k]) * w).cast("bigint"), F.lit(0)), F.lit(n - 1))
            hi = F.least(F.greatest((F.greatest(a[k], b[k]) * w).cast("bigint"), F.lit(0)), F.lit(n - 1))
            df = df.withColumn(f"__t{k}", F.explode(F.sequence(lo, hi)))
        return df.withColumn("__cell", linear([F.col(f"__t{k}") for k in range(mesh.ndim)], mesh.fine_dims)).drop(*(f"__t{k}" for k in range(mesh.ndim)))

    s = steps.select(key, *(c.alias(f"__s{k}") for k, c in enumerate(previous)), *(c.alias(f"__e{k}") for k, c in enumerate(position)))
    start, end = [F.col("__s0"), F.col("__s1")], [F.col("__e0"), F.col("__e1")]
    e = cells(edges, [F.col("ax"), F.col("ay")], [F.col("bx"), F.col("by")])
    met = cells(s, start, end).join(e, "__cell").withColumn("hit", segments_meet(*start, *end, *(F.col(c) for c in ("ax", "ay", "bx", "by")), tol=tol)).where("hit.hit")
    far = (F.col("hit.x") - start[0]) ** 2 + (F.col("hit.y") - start[1]) ** 2
    best = met.groupBy(key).agg(F.min(F.struct(far.alias("d2"), "edge", "boundary_group", F.col("hit.x").alias("x"), F.col("hit.y").alias("y"))).alias("best"))
    return best.select(key, "best.edge", "best.boundary_group", "best.x", "best.y")
