"""Queries: cell-wise and global reductions, scans, spatial mapping."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import CartesianMesh
from ..operators import cellwise, mapping, sampling
from ..operators.arrays import NDArray
from ..polygons import PolygonMesh
from ..polyhedra import PolyhedralMesh
from .catalog import query
from .fixtures import EV, MESH, OR, cell_sql, draw_sql, events, orders, table, uniform_sql

H = CartesianMesh((15, 12), 2.0, 1)


@query(EV + ", s AS (SELECT cell, sum(W_0) AS w FROM ev GROUP BY cell) SELECT c AS cell, CAST(1000 + coalesce(w, 0) AS BIGINT) AS value FROM range(720) t(c) LEFT JOIN s ON s.cell = c")
def e1_reduce_cellwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per cell on top of what the target held."""
    prior = cellwise.fill(spark, MESH).withColumn("value", F.lit(1000).cast("bigint"))
    return cellwise.reduce_cellwise(events(spark, sf_dir).df, [F.col("W_0")], "plus", prior).select("cell", "value")


@query(EV + "SELECT cell, k // 2 AS row, k % 2 AS col, CASE k WHEN 0 THEN min(V_0) WHEN 1 THEN min(V_1) WHEN 2 THEN min(P_0) ELSE min(P_1) END AS value FROM ev, range(4) t(k) GROUP BY cell, k")
def e2_reduce_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components at once, row by row into a 2 x 2 matrix per cell."""
    return cellwise.reduce_cellwise(events(spark, sf_dir).df, [F.col(c) for c in ("V_0", "V_1", "P_0", "P_1")], "min", ncol=2)


@query(EV + ", s AS (SELECT cell, max(W_0 * SPECIES_0) AS w FROM ev WHERE Q_0 > 30 GROUP BY cell) SELECT c AS cell, CASE WHEN w IS NULL THEN 2000 ELSE greatest(2000, w) END AS value FROM range(720) t(c) LEFT JOIN s ON s.cell = c")
def e3_reduce_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum over an expression of a sub group, seeded with the prior value."""
    prior = cellwise.fill(spark, MESH).withColumn("value", F.lit(2000).cast("bigint"))
    rows = events(spark, sf_dir).sub(F.col("Q_0") > 30).rows()
    return cellwise.reduce_cellwise(rows, [F.col("W_0") * F.col("SPECIES_0")], "max", prior).select("cell", "value")


@query(EV + ", a AS (SELECT cell, CAST(sum(W_0) AS BIGINT) AS s, min(W_0) AS lo, max(W_0) AS hi FROM ev GROUP BY cell) SELECT CAST(c AS BIGINT) AS cell, CAST(c + coalesce(s, 0) AS BIGINT) AS s, least(1000, lo) AS lo, greatest(9000, hi) AS hi FROM range(720) t(c) LEFT JOIN a ON a.cell = c")
def e4_cell_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, min and max of every row on its cell's accumulators, which hold values already."""
    held = spark.range(MESH.ncells).select(F.col("id").alias("cell"), F.col("id").alias("s"), F.lit(1000).cast("bigint").alias("lo"), F.lit(9000).cast("bigint").alias("hi"))
    return cellwise.accumulate(events(spark, sf_dir).df, ["cell"], {n: (op, F.col("W_0")) for n, op in (("s", "plus"), ("lo", "min"), ("hi", "max"))}, held)


@query(EV + "SELECT CAST(count(*) + 10 AS BIGINT) AS n, CAST(sum(W_0) AS BIGINT) AS w FROM ev")
def e5_global_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.global_reduce(events(spark, sf_dir).df, {"n": F.lit(1), "w": F.col("W_0")}, "plus", {"n": 10})


@query(EV + ", w AS (SELECT SPECIES_0 AS i, sum(W_0) AS v FROM ev GROUP BY ALL) SELECT k AS i, CAST(7 + coalesce(v, 0) AS BIGINT) AS value FROM range(4) t(k) LEFT JOIN w ON w.i = k")
def e6_local_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = NDArray.filled(spark, (4,)).fill(7).add(events(spark, sf_dir).df, [F.col("SPECIES_0")], F.col("W_0"))
    return a.table.select("i", F.col("value").cast("bigint").alias("value"))


@query(EV + ", h AS (SELECT SPECIES_0 AS i, CAST(trunc(P_1) AS BIGINT) AS j, CAST(sum(W_0) AS BIGINT) AS w FROM ev GROUP BY ALL) SELECT a AS i_0, b AS i_1, CAST(coalesce(w, 0) AS BIGINT) AS value FROM range(4) t(a) CROSS JOIN range(24) u(b) LEFT JOIN h ON h.i = a AND h.j = b")
def e7_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.histogram(events(spark, sf_dir).df, [F.col("SPECIES_0"), F.col("P_1").cast("bigint")], [4, 24], F.col("W_0"))


@query(EV + ", n AS (SELECT cell, count(*) AS n FROM ev GROUP BY cell) SELECT c AS cell, coalesce(n, 0) AS npart FROM range(720) t(c) LEFT JOIN n ON n.cell = c")
def e8_npart_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.counts(events(spark, sf_dir).df, MESH)


@query(EV + "SELECT count(*) AS npart FROM ev")
def e9_npart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).df.agg(F.count("*").alias("npart"))


@query(EV + "SELECT id, count(*) OVER (PARTITION BY cell) AS npart_cell FROM ev WHERE SPECIES_0 = 1")
def e10_cell_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy within the rows at hand."""
    return cellwise.occupancy(events(spark, sf_dir).df.where("SPECIES_0 = 1")).select("id", "npart_cell")


@query(EV + "SELECT id, CAST(coalesce(sum(W_0) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM ev")
def e11_exclusive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.exclusive_scan(events(spark, sf_dir).df, "id", "W_0").select("id", "scan")


@query(EV + "SELECT id, CAST(sum(W_0) OVER (PARTITION BY cell ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inclusive, CAST(coalesce(sum(W_0) OVER (PARTITION BY cell ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS exclusive FROM ev")
def e12_segmented_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cellwise.segmented_scan(events(spark, sf_dir).df, "cell", "id", "W_0", True, "inclusive")
    return cellwise.segmented_scan(rows, "cell", "id", "W_0", False, "exclusive").select("id", "inclusive", "exclusive")


@query(EV + ", s AS (SELECT cell, sum(W_0) AS w FROM ev GROUP BY cell) SELECT c AS cell, CAST(coalesce(w, 0) AS BIGINT) AS total FROM range(720) t(c) LEFT JOIN s ON s.cell = c")
def e13_segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.segment_totals(events(spark, sf_dir).df, MESH.cells(spark), "cell", "W_0")


@query(EV + "SELECT CAST(sum(W_0) AS BIGINT) AS s, min(W_0) AS lo, max(W_0) AS hi FROM ev")
def e14_reduce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.accumulate(events(spark, sf_dir).df, [], {n: (op, F.col("W_0")) for n, op in (("s", "plus"), ("lo", "min"), ("hi", "max"))})


@query(OR + "SELECT cell, count(*) AS n, CAST(sum(W_0) AS BIGINT) AS w FROM ord GROUP BY cell")
def e15_orders_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.accumulate(orders(spark, sf_dir), ["cell"], {"n": ("plus", F.lit(1)), "w": ("plus", F.col("W_0"))})


@query("SELECT 8 * 8 AS bytes")
def e16_particle_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(events(spark, sf_dir).spec.row_bytes).cast("bigint").alias("bytes"))


@query("SELECT l_orderkey % 97 AS cell, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min(l_discount) AS d FROM lineitem GROUP BY l_orderkey % 97")
def e18_lineitem_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table reduced by cell."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("cell"), "l_quantity", "l_discount")
    return li.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.min("l_discount").alias("d"))


# --- I: spatial mapping

_OUT = "(CASE WHEN id % 97 = 0 THEN P_0 + 100 WHEN id % 97 = 1 THEN P_0 - 100 ELSE P_0 END)"


@query(EV + f"SELECT id, {cell_sql(_OUT, 'P_1')} AS cell FROM ev")
def i1_cell_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions outside go to the edge cells."""
    k = F.col("id") % 97
    x = F.when(k == 0, F.col("P_0") + 100).when(k == 1, F.col("P_0") - 100).otherwise(F.col("P_0"))
    return events(spark, sf_dir).df.select("id", MESH.cell([x, F.col("P_1")]).alias("cell"))


_C = "CAST(trunc({p} * 0.5::DOUBLE) AS BIGINT)"
_F = "CAST(trunc(({p} - {c} * 2.0::DOUBLE) * 1.0::DOUBLE) AS BIGINT)"
_C0, _C1 = _C.format(p="P_0"), _C.format(p="P_1")
_F0, _F1 = _F.format(p="P_0", c=_C0), _F.format(p="P_1", c=_C1)
_HI = f"(({_C0} + 15 * {_C1}) * 4 + {_F0} + 2 * {_F1})"


@query(EV + f"SELECT id, {_C0} AS c_0, {_C1} AS c_1, {_F0} AS f_0, {_F1} AS f_1 FROM ev UNION ALL SELECT -1, 14, 11, 1, 1 UNION ALL SELECT -2, -2, -2, -2, -2")
def i2_hierarchy_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on the upper edge snap back; positions beyond it are marked."""
    edge = spark.createDataFrame([(-1, 30.0, 24.0), (-2, 40.0, 40.0)], "id long, P_0 double, P_1 double")
    rows = events(spark, sf_dir).df.select("id", "P_0", "P_1").union(edge)
    t = H.hierarchy_tuple([F.col("P_0"), F.col("P_1")])
    return rows.select("id", *(c.alias(n) for c, n in zip(t, ("c_0", "c_1", "f_0", "f_1"))))


@query(EV + "SELECT id, CASE WHEN P_0 - 15 < 0 THEN -(CAST(trunc(abs(P_0 - 15)) AS BIGINT) + 1) ELSE CAST(trunc(P_0 - 15) AS BIGINT) END AS t_0 FROM ev")
def i3_untruncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = MESH.untruncated_tuple([F.col("P_0") - 15])
    return events(spark, sf_dir).df.select("id", t[0].alias("t_0"))


@query(EV + f"SELECT id, {_HI} AS h, {_C0} * 2 + {_F0} AS x, {_C1} * 2 + {_F1} AS y FROM ev")
def i4_index_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the global index and back to the fine tuple."""
    rows = events(spark, sf_dir).df.select("id", H.hierarchy_index(H.hierarchy_tuple([F.col("P_0"), F.col("P_1")])).alias("h"))
    back = H.cart_of(H.hierarchy_untuple(F.col("h")))
    return rows.select("id", "h", back[0].alias("x"), back[1].alias("y"))


@query(EV + f"SELECT id, {_HI} % 7 AS owner FROM ev")
def i5_global_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = spark.range(H.ncells).select(F.col("id").alias("cell"), (F.col("id") % 7).alias("owner"))
    return mapping.map_owner(events(spark, sf_dir).df, H, owner, [F.col("P_0"), F.col("P_1")]).select("id", "owner")


@query(EV + ", claims AS (SELECT cell, SPECIES_0 AS rank, count(*) AS weight FROM ev GROUP BY ALL) SELECT cell, rank AS owner FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY weight DESC, rank DESC) AS k FROM claims) WHERE k = 1")
def i6_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = events(spark, sf_dir).df.groupBy("cell", F.col("SPECIES_0").alias("rank")).agg(F.count("*").alias("weight"))
    return mapping.owners(claims)


@query("SELECT DISTINCT c AS cell, ((c % 30 + a + 29) % 30) + 30 * ((c // 30 + b + 23) % 24) AS neighbour FROM range(720) t(c), range(3) u(a), range(3) v(b)")
def i7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESH.neighbours(MESH.cells(spark), 1, True)


@query(EV + f"SELECT id, {cell_sql('P_0', 'P_1')} % 5 AS owner FROM ev")
def i8_local_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = spark.range(MESH.ncells).select(F.col("id").alias("cell"), (F.col("id") % 5).alias("owner"))
    return events(spark, sf_dir).df.join(table_, "cell").select("id", "owner")


# each fine cell of a 10 x 8 mesh of width 3 is split into two triangles along its rising diagonal
_TRI = "(CASE WHEN (P_0 - 3 * floor(P_0 / 3)) <= (P_1 - 3 * floor(P_1 / 3)) THEN 1 ELSE 0 END)"


def triangles(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(corner table (mesh_cell, x_0, y_0, ..., volume), edge table) of 160 triangles on the fixture's domain."""
    cells = CartesianMesh((10, 8), 3.0).cells(spark)
    x, y = F.col("x_0"), F.col("x_1")
    lower = F.struct((F.col("cell") * 2).alias("mesh_cell"), *(c.alias(n) for c, n in zip((x, y, x + 3, y, x + 3, y + 3), ("x_0", "y_0", "x_1", "y_1", "x_2", "y_2"))))
    upper = F.struct((F.col("cell") * 2 + 1).alias("mesh_cell"), *(c.alias(n) for c, n in zip((x, y, x + 3, y + 3, x, y + 3), ("x_0", "y_0", "x_1", "y_1", "x_2", "y_2"))))
    corners = cells.select(F.inline(F.array(lower, upper))).withColumn("volume", F.lit(4.5))
    sides = F.array(*(F.struct(F.col(f"x_{k}").alias("ax"), F.col(f"y_{k}").alias("ay"), F.col(f"x_{(k + 1) % 3}").alias("bx"), F.col(f"y_{(k + 1) % 3}").alias("by")) for k in range(3)))
    return corners, corners.select("mesh_cell", F.inline(sides))


# on an edge counts as inside and the last candidate wins: the box right of and above a grid line, but for the domain's own edges
_BOX3 = ["least(floor(P_0 / 3), 9)", "least(floor(P_1 / 3), 7)"]


@query(EV + f"SELECT id, CASE WHEN P_0 BETWEEN 0 AND 30 AND P_1 BETWEEN 0 AND 24 THEN (CAST({_BOX3[0]} AS BIGINT) + 10 * CAST({_BOX3[1]} AS BIGINT)) * 2 + CASE WHEN P_0 - 3 * {_BOX3[0]} <= P_1 - 3 * {_BOX3[1]} THEN 1 ELSE 0 END END AS mesh_cell FROM ev")
def i9_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location on a triangle mesh by a grid-bucket join and crossing counts; on an edge the last candidate wins."""
    return _in_triangles(spark, events(spark, sf_dir).df)


def _in_triangles(spark: SparkSession, rows: DataFrame) -> DataFrame:
    corners, edges = triangles(spark)
    vertices = corners.select("mesh_cell", F.inline(F.array(*(F.struct(F.col(f"x_{k}").alias("x"), F.col(f"y_{k}").alias("y")) for k in range(3))))).select("mesh_cell", F.col("x").alias("x_0"), F.col("y").alias("x_1"))
    boxes = mapping.bounding_boxes(vertices, "mesh_cell")
    candidates = mapping.claim_boxes(boxes, MESH, ("mesh_cell",)).select("cell", "mesh_cell", F.col("mesh_cell").alias("ord"))
    return mapping.locate(rows.select("id", "P_0", "P_1"), edges, candidates, MESH, [F.col("P_0"), F.col("P_1")], ["id"])


@query(EV + f"SELECT id, {cell_sql('P_0 + 4 * V_0', 'P_1 + 4 * V_1')} AS cell FROM ev")
def i12_cell_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return g.update({f"P_{d}": F.col(f"P_{d}") + 4 * F.col(f"V_{d}") for d in range(2)}).move_cells().df.select("id", "cell")


_OWNER = "({c} % 30 // 6 + 5 * ({c} // 30 // 8))"  # blocks of 6 x 8 cells


@query(
    EV + f", t AS (SELECT id, {_OWNER.format(c='cell')} AS f, {_OWNER.format(c=cell_sql('P_0 + 4 * V_0', 'P_1 + 4 * V_1'))} AS t, cell, {cell_sql('P_0 + 4 * V_0', 'P_1 + 4 * V_1')} AS next FROM ev) "
    "SELECT id, cell, next, f AS \"from\", t AS \"to\", CASE WHEN f = t THEN 'stay' WHEN (abs(f % 5 - t % 5) <= 1 OR abs(f % 5 - t % 5) = 4) AND (abs(f // 5 - t // 5) <= 1 OR abs(f // 5 - t // 5) = 2) THEN 'local' ELSE 'global' END AS how FROM t"
)
def i13_hybrid_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a step, with the owners of 6 x 8 cells that they leave and reach, and the kind of their move."""
    c = F.col("id")
    owner = spark.range(MESH.ncells).select(c.alias("cell"), (F.floor(c % 30 / 6) + 5 * F.floor(F.floor(c / 30) / 8)).alias("owner"))
    rows = events(spark, sf_dir).df.withColumn("next", MESH.cell([F.col(f"P_{d}") + 4 * F.col(f"V_{d}") for d in range(2)]))
    return mapping.hybrid_move(rows.select("id", "cell", "next"), MESH, owner, "cell", "next").select("id", "cell", "next", "from", "to", "how")


@query(EV + "SELECT id, cell % 6 - 1 AS owner FROM ev WHERE cell % 6 - 1 BETWEEN 0 AND 4 AND cell % 6 - 1 <> 2")
def i14_departing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).df.withColumn("owner", F.col("cell") % 6 - 1)
    return mapping.departing(rows, 2, 5).select("id", "owner")


@query(EV + "SELECT id, CAST(-1 AS BIGINT) AS rank_0, CAST(-1 AS BIGINT) AS rank_1 FROM ev")
def i16_reset_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).df.select("id", F.lit(-1).cast("bigint").alias("rank_0"), F.lit(-1).cast("bigint").alias("rank_1"))


_MOVE = [f"(P_{d} + 40::DOUBLE * V_{d})" for d in range(2)]


@query(EV + f"SELECT id, fmod({_MOVE[0]} + (abs(CAST(trunc({_MOVE[0]} * {1 / 30}::DOUBLE) AS BIGINT)) + 2) * 30::DOUBLE, 30::DOUBLE) AS P_0, fmod({_MOVE[1]} + (abs(CAST(trunc({_MOVE[1]} * {1 / 24}::DOUBLE) AS BIGINT)) + 2) * 24::DOUBLE, 24::DOUBLE) AS P_1 FROM ev")
def i18_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = [F.col(f"P_{d}") + F.lit(40.0) * F.col(f"V_{d}") for d in range(2)]
    return events(spark, sf_dir).df.select("id", *(p.alias(f"P_{d}") for d, p in enumerate(MESH.periodic(moved))))


@query("SELECT f AS face, CASE WHEN f < 30 THEN 0 WHEN f < 54 THEN 1 WHEN f < 84 THEN 2 ELSE 3 END AS facet, CASE WHEN f < 30 THEN f WHEN f < 54 THEN 29 + 30 * (f - 30) WHEN f < 84 THEN f - 54 + 30 * 23 ELSE 30 * (f - 84) END AS cell FROM range(108) t(f)")
def i19_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESH.faces(spark)


@query(OR + "SELECT cell % 32 AS geom_id, CAST(sum(W_0) AS BIGINT) AS value FROM ord GROUP BY cell % 32")
def i21_boundary_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.exchange(orders(spark, sf_dir).select((F.col("cell") % 32).alias("geom_id"), F.col("W_0").alias("value")))


@query("SELECT c AS mesh_cell, x + 30 * y AS cell, (least(lo + 2.5, x + 1) - greatest(lo, x)) * (least(hi + 1.5, y + 1) - greatest(hi, y)) * 1::DOUBLE AS overlap FROM (SELECT c, c % 10 * 2.5 AS lo, c // 10 * 2.25 AS hi FROM range(80) t(c)), range(30) u(x), range(24) v(y) WHERE x BETWEEN floor(lo) AND floor(lo + 2.5) AND y BETWEEN floor(hi) AND floor(hi + 1.5)")
def f14_overlay_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay cells that boxes meet, with the area shared."""
    k = F.col("id")
    lo, hi = k % 10 * F.lit(2.5), F.floor(k / 10) * F.lit(2.25)
    boxes = spark.range(80).select(k.alias("mesh_cell"), lo.alias("lo_0"), (lo + 2.5).alias("hi_0"), hi.alias("lo_1"), (hi + 1.5).alias("hi_1"))
    return mapping.claim_boxes(boxes, MESH, ("mesh_cell",))


# --- M: generated rows

@query(EV + f"SELECT id, {draw_sql(3, 1, 'id', 0)} AS r_0, {draw_sql(3, 1, 'id', 1)} AS r_1, {uniform_sql(3, 1, 'id', 2)} AS u FROM ev")
def m1_per_row_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import rng

    i = F.col("id")
    return events(spark, sf_dir).df.select("id", rng.draw(3, 1, i, 0).alias("r_0"), rng.draw(3, 1, i, 1).alias("r_1"), rng.Uniform(3, 1, 3).at(i, 2).alias("u"))


@query(EV + f", o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM ev) SELECT id, CASE WHEN k < 500 THEN {uniform_sql(9, 0, 'k', 0)} ELSE 0 END AS u, k < 500 AS ok FROM o")
def m2_shared_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by ordinal from a pool of 500; beyond it they are 0 and not ok."""
    from ..functions import rng

    pool = rng.Pool(9, 500)
    rows = cellwise.exclusive_scan(events(spark, sf_dir).df.withColumn("one", F.lit(1)), "id", "one", "k")
    return rows.select("id", pool.at(F.col("k")).alias("u"), pool.ok(F.col("k")).alias("ok"))


@query(EV + f"SELECT id, CAST(0 AS DOUBLE) AS a, {uniform_sql(4, 0, 'id', 0)} AS b FROM ev")
def m3_null_and_tuple_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import rng

    s = rng.Tuple(rng.Null(), rng.Uniform(4))
    return events(spark, sf_dir).df.select("id", s.at(F.col("id"), 0).alias("a"), s.at(F.col("id"), 1).alias("b"))


@query(f"SELECT i AS id, {uniform_sql(1, 0, 'i', 0)} * 30::DOUBLE AS P_0, {uniform_sql(1, 0, 'i', 1)} * 24::DOUBLE AS P_1 FROM range(5000) t(i)")
def m5_uniform_within_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_within_extents(spark, 5000, MESH.extents, 1)


@query(f"SELECT i AS id, i // 5 AS cell, (i // 5 % 30 + {uniform_sql(2, 2, 'i', 0)}) AS P_0, (i // 5 // 30 + {uniform_sql(2, 2, 'i', 1)}) AS P_1 FROM range(3600) t(i)")
def m6_uniform_within_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_within_cells(spark, MESH, 5, 2)


_U = [f"((CAST({draw_sql(7, 1, 'i', 2 * k)} AS DOUBLE) + 1) / 2147483648::DOUBLE)" for k in range(2)]
_N = [f"round(1.5 + 0.5 * sqrt(-2.0 * ln({_U[k]})) * cos(2 * pi() * {uniform_sql(7, 1, 'i', 2 * k + 1)}), 6)" for k in range(2)]


@query(f"SELECT i AS id, {_N[0]} AS V_0, {_N[1]} AS V_1 FROM range(5000) t(i)")
def m5_normal_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal draws of mean 1.5 and deviation 0.5, rounded, since engines' logarithms differ in the last bit."""
    return sampling.normal_rows(spark, 5000, 2, 1.5, 0.5, 7).select("id", *(F.round(f"V_{k}", 6).alias(f"V_{k}") for k in range(2)))


@query("SELECT c AS cell, CAST(floor(greatest((c % 11 - 2) * 0.5, 0) / 0.75 + 0.5) AS BIGINT) AS n FROM range(720) t(c)")
def k14_counts_for_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = MESH.cells(spark).select("cell", ((F.col("cell") % 11 - 2) * F.lit(0.5)).alias("average"), "volume")
    return sampling.counts_for_density(cells, 0.75)


@query(EV + f", o AS (SELECT id, cell, {uniform_sql(8, 2, 'id', 0)} AS u FROM ev) SELECT id, u < 0.25 AS chosen FROM o")
def m4_generation_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source made from a function of (row, component)."""
    from ..functions import rng

    s = rng.Source.of(lambda row, comp: rng.uniform(8, 2, row, comp))
    return events(spark, sf_dir).df.select("id", (s.at(F.col("id"), 0) < 0.25).alias("chosen"))


# the 3-D mesh over the first three components of the vectors, each shifted by one
_V = [f"(CAST(list_extract(embedding, {k + 1}) AS DOUBLE) + 1)" for k in range(3)]
_VC = [f"least(greatest(CAST(trunc({v} * 4::DOUBLE) AS BIGINT), 0), 7)" for v in _V]


@query(f"SELECT {_VC[0]} + 8 * {_VC[1]} + 64 * {_VC[2]} AS cell, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM embeddings GROUP BY 1")
def i10_cells_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors binned on a 3-D mesh by their first three components."""
    mesh = CartesianMesh((2, 2, 2), 1.0, 2)
    x = [F.element_at("embedding", k + 1).cast("double") + 1 for k in range(3)]
    e = table(spark, sf_dir, "embeddings").select(mesh.cell(x).alias("cell"), "label")
    return e.groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


def prisms(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(boxes (mesh_cell, lo_0.., hi_0..), faces (mesh_cell, n_0.., d)) of 128 prisms: 64 boxes of width 0.5, each cut along x = y."""
    c = F.floor(F.col("id") / 2)
    x = [(F.floor(c / 4**k) % 4 * 0.5).cast("double") for k in range(3)]
    boxes = spark.range(128).select(F.col("id").alias("mesh_cell"), *(x[k].alias(f"lo_{k}") for k in range(3)), *((x[k] + 0.5).alias(f"hi_{k}") for k in range(3)))
    face = lambda n, d: F.struct(*(F.lit(float(v)).alias(f"n_{k}") for k, v in enumerate(n)), d.alias("d"))
    lo, hi = [F.col(f"lo_{k}") for k in range(3)], [F.col(f"hi_{k}") for k in range(3)]
    ends = (face((0, 0, 1), lo[2]), face((0, 0, -1), -hi[2]))
    lower = F.array(face((0, 1, 0), lo[1]), face((-1, 0, 0), -hi[0]), face((1, -1, 0), lo[0] - lo[1]), *ends)
    upper = F.array(face((1, 0, 0), lo[0]), face((0, -1, 0), -hi[1]), face((-1, 1, 0), lo[1] - lo[0]), *ends)
    return boxes, boxes.select("mesh_cell", F.inline(F.when(F.col("mesh_cell") % 2 == 0, lower).otherwise(upper)))


def _in_prisms(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(id, mesh_cell) of points (id, x_0, x_1, x_2)."""
    mesh = CartesianMesh((2, 2, 2), 1.0, 2)
    boxes, faces = prisms(spark)
    candidates = mapping.claim_boxes(boxes, mesh, ("mesh_cell",)).select("cell", "mesh_cell", F.col("mesh_cell").alias("ord"))
    return mapping.locate_convex(points, faces, candidates, mesh, [F.col(f"x_{k}") for k in range(3)], ["id"])


_VB = [f"least(floor({v} * 2), 3)" for v in _V]


@query(f"SELECT vec_id AS id, CASE WHEN {' AND '.join(f'{v} BETWEEN 0 AND 2' for v in _V)} THEN CAST(2 * ({_VB[0]} + 4 * {_VB[1]} + 16 * {_VB[2]}) + CASE WHEN {_V[0]} - {_VB[0]} / 2 <= {_V[1]} - {_VB[1]} / 2 THEN 1 ELSE 0 END AS BIGINT) END AS mesh_cell FROM embeddings")
def i10_point_in_polyhedron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors located on a mesh of 3-D prisms by a grid-bucket join and half-space tests."""
    x = [(F.element_at("embedding", k + 1).cast("double") + 1).alias(f"x_{k}") for k in range(3)]
    return _in_prisms(spark, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *x))


def tetrahedra(spark: SparkSession) -> PolyhedralMesh:
    """The box of width 2 in 64 cubes, each cut into six tetrahedra by the order of its coordinates; sides are marked 1 to 6."""
    i = F.col("id")
    nodes = spark.range(125).select(i.alias("node"), *((F.floor(i / 5**d) % 5 * 0.5).alias(n) for d, n in enumerate("xyz")))
    cube, strides = F.floor(i / 6), [1, 5, 25]
    low = sum((F.floor(cube / 4**d) % 4 * strides[d] for d in range(3)), F.lit(0)).cast("bigint")
    corners = F.lit(None).cast("array<bigint>")
    for k, order in enumerate(permutations(range(3))):
        a, b = strides[order[0]], strides[order[0]] + strides[order[1]]
        corners = F.when(i % 6 == k, F.array(low, low + a, low + b, low + 31)).otherwise(corners)
    solids = spark.range(384).select(i.alias("element"), F.lit(4).alias("kind"), F.lit(0).alias("tag"), corners.alias("nodes"))
    sides = None
    for d in range(3):
        u, v = (strides[e] for e in range(3) if e != d)
        for high in (0, 1):
            base = F.lit(4 * high * strides[d]) + F.floor(i / 2) % 4 * u + F.floor(i / 8) * v
            nodes_of = F.when(i % 2 == 0, F.array(base, base + u, base + u + v)).otherwise(F.array(base, base + v, base + u + v))
            one = spark.range(32).select((i + 1000 * (2 * d + high + 1)).alias("element"), F.lit(2).alias("kind"), F.lit(2 * d + high + 1).alias("tag"), nodes_of.cast("array<bigint>").alias("nodes"))
            sides = one if sides is None else sides.union(one)
    return PolyhedralMesh.of(nodes, solids.union(sides), CartesianMesh((2, 2, 2), 1.0, 2))


_REST = [f"({v} - {b} / 2)" for v, b in zip(_V, _VB)]
_ORDER = " ".join(f"WHEN {_REST[p[0]]} >= {_REST[p[1]]} AND {_REST[p[1]]} >= {_REST[p[2]]} THEN {k}" for k, p in reversed(list(enumerate(permutations(range(3))))))


@query(f"SELECT vec_id AS id, CASE WHEN {' AND '.join(f'{v} BETWEEN 0 AND 2' for v in _V)} THEN CAST(6 * ({_VB[0]} + 4 * {_VB[1]} + 16 * {_VB[2]}) + CASE {_ORDER} END AS BIGINT) END AS mesh_cell FROM embeddings")
def i10_tetrahedra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors located on an unstructured mesh of tetrahedra given by nodes and elements."""
    x = [(F.element_at("embedding", k + 1).cast("double") + 1).alias(f"x_{k}") for k in range(3)]
    return tetrahedra(spark).locate(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *x), [F.col(f"x_{k}") for k in range(3)], ["id"])


@query("SELECT g AS boundary_group, 32 AS n, 32.0 * CASE WHEN (g - 1) // 2 = 0 THEN 1 - (g - 1) % 2 * 2 ELSE 0 END::DOUBLE AS normal_0, 32.0 * CASE WHEN (g - 1) // 2 = 1 THEN 1 - (g - 1) % 2 * 2 ELSE 0 END::DOUBLE AS normal_1, 32.0 * CASE WHEN (g - 1) // 2 = 2 THEN 1 - (g - 1) % 2 * 2 ELSE 0 END::DOUBLE AS normal_2 FROM (SELECT CAST(i + 1 AS INTEGER) AS g FROM range(6) t(i))")
def i20_boundary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary faces of the mesh of tetrahedra by group, with the sum of their inward normals."""
    b = tetrahedra(spark).boundary()
    return b.groupBy("boundary_group").agg(F.count("*").cast("int").alias("n"), *((F.sum(f"normal_{d}") + 0.0).alias(f"normal_{d}") for d in range(3)))


@query("SELECT CAST(c AS BIGINT) AS mesh_cell, round(0.125::DOUBLE / 6, 12) AS volume, CAST(c % 4 AS BIGINT) AS n FROM range(384) t(c) WHERE c % 4 > 0")
def k14_uniform_in_tetrahedra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes, and points drawn in each tetrahedron that are found there again."""
    mesh = tetrahedra(spark)
    drawn = mesh.uniform(spark.range(384).select(F.col("id").alias("mesh_cell"), (F.col("id") % 4).alias("n")), 5).withColumnRenamed("mesh_cell", "drawn_in")
    found = mesh.locate(drawn, [F.col(f"P_{d}") for d in range(3)], ["drawn_in", "k"], 1e-12)
    return found.where("mesh_cell = drawn_in").groupBy("mesh_cell").agg(F.count("*").alias("n")).join(mesh.volumes(), "mesh_cell").select("mesh_cell", F.round(F.col("volume"), 12).alias("volume"), "n")


@query(EV + "SELECT id, cell, 1 AS candidates FROM ev")
def f13_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each point by its overlay cell, where every overlay cell is a candidate of itself."""
    boxes = MESH.cells(spark).select(F.col("cell").alias("mesh_cell"), (F.col("x_0") + 0.25).alias("lo_0"), (F.col("x_0") + 0.75).alias("hi_0"), (F.col("x_1") + 0.25).alias("lo_1"), (F.col("x_1") + 0.75).alias("hi_1"))
    listed = mapping.claim_boxes(boxes, MESH, ("mesh_cell",))
    return events(spark, sf_dir).df.join(listed, "cell").groupBy("id", F.col("mesh_cell").alias("cell")).agg(F.count("*").cast("int").alias("candidates"))


@query(EV + "SELECT id, CASE WHEN P_0 BETWEEN 0 AND 30 AND P_1 BETWEEN 0 AND 24 THEN CAST(least(floor(P_0 / 2), 14) AS BIGINT) + 15 * CAST(least(floor(P_1 / 3), 7) AS BIGINT) END AS mesh_cell FROM ev")
def i9_unstructured_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows located on a mesh of 2 x 3 quads given by nodes and elements."""
    return _in_quads(spark, events(spark, sf_dir).df)


def _in_quads(spark: SparkSession, rows: DataFrame) -> DataFrame:
    n = F.col("id")
    nodes = spark.range(16 * 9).select(n.alias("node"), (n % 16 * 2.0).alias("x"), (F.floor(n / 16) * 3.0).alias("y"))
    low = F.floor(n / 15).cast("bigint") * 16 + n % 15
    quads = spark.range(15 * 8).select(n.alias("element"), F.lit(3).alias("kind"), F.lit(0).alias("tag"), F.array(low, low + 1, low + 17, low + 16).alias("nodes"))
    mesh = PolygonMesh.of(nodes, quads, MESH)
    return mesh.locate(rows, [F.col("P_0"), F.col("P_1")], ["id"])


@query("SELECT * FROM (VALUES (1, 30, 0.0::DOUBLE, 30.0::DOUBLE), (2, 24, -24.0::DOUBLE, 0.0::DOUBLE), (3, 30, 0.0::DOUBLE, -30.0::DOUBLE), (4, 24, 24.0::DOUBLE, 0.0::DOUBLE)) t(boundary_group, n, normal_0, normal_1)")
def i20_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary edges of a polygon mesh by group, with the sum of their inward normals."""
    b = PolygonMesh.grid(spark, 30, 24, 1.0, MESH).boundary()
    return b.groupBy("boundary_group").agg(F.count("*").cast("int").alias("n"), *((F.sum(f"normal_{d}") + 0.0).alias(f"normal_{d}") for d in range(2)))


@query("SELECT CAST(c AS BIGINT) AS mesh_cell, c % 30 + 0.5::DOUBLE AS x_0, c // 30 + 0.5::DOUBLE AS x_1, CAST(CASE WHEN c < 30 THEN 2 ELSE 0 END AS BIGINT) AS south, CAST(4 * (c % 30) + 2 AS DOUBLE) AS nodes_x FROM range(720) t(c)")
def k14_mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each polygon's mean point, its corners on the side marked 1, and the sum of its corners' first coordinates."""
    mesh = PolygonMesh.grid(spark, 30, 24, 1.0, MESH)
    corners = mesh.vertices().join(mesh.labelled(1).withColumn("marked", F.lit(1)), "node", "left")
    found = corners.groupBy("mesh_cell").agg(F.count("marked").alias("south"), F.sum("x_0").alias("nodes_x"))
    return mesh.centres().join(found, "mesh_cell")


@query("SELECT CAST(c AS BIGINT) AS mesh_cell, CAST(c % 3 AS BIGINT) AS n FROM range(720) t(c) WHERE c % 3 > 0")
def k14_uniform_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points drawn in each polygon are found there again."""
    mesh = PolygonMesh.grid(spark, 30, 24, 1.0, MESH)
    wanted = spark.range(720).select(F.col("id").alias("mesh_cell"), (F.col("id") % 3).alias("n"))
    drawn = mesh.uniform(wanted, 3).withColumnRenamed("mesh_cell", "drawn_in")
    found = mesh.locate(drawn, [F.col("P_0"), F.col("P_1")], ["drawn_in", "k"])
    return found.where("mesh_cell = drawn_in").groupBy("mesh_cell").agg(F.count("*").alias("n"))
