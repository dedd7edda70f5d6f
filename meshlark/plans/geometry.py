"""Queries: scalar and geometry functions, boundaries, deposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import maths as M
from ..operators import boundary, deposit
from .catalog import query as register
from .fixtures import EV, MESH, events
from .reductions import triangles


#: Added before rounding to six places: the inputs lie on a grid that would put many values on a tie.
OFF_TIE = 1.23e-8


def query(sql: str):
    return register(sql.replace(", 6)", f" + {OFF_TIE}::DOUBLE, 6)"))


def six(c: Column) -> Column:
    return F.round(c + F.lit(OFF_TIE), 6)


def _round(df: DataFrame, *keep: str) -> DataFrame:
    """Reals to six places, where sums or functions may differ in the last bits."""
    return df.select(*(F.col(c) if c in keep else six(F.col(c)).alias(c) for c in df.columns))


@query(EV + "SELECT id, round(sqrt(P_0), 6) AS a, round(exp(-P_1), 6) AS b, round(atan2(P_0 + 1, P_1 + 1), 6) AS c, round(fmod(P_0 * 7, 3::DOUBLE), 6) AS d, round(log2(P_0 + 1) + log10(P_1 + 1) + ln(P_0 + 2), 6) AS e, trunc(V_0 * 10) AS f, round(gamma(P_1 / 4 + 0.5), 4) AS g, round(V_0 * 10 + P_0, 6) AS h, round(sin(P_0) + cos(P_1) + tan(V_0), 6) AS i, round(1 / sqrt(P_0 + 1), 6) AS j FROM ev")
def j1_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    p0, p1, v0 = F.col("P_0"), F.col("P_1"), F.col("V_0")
    df = events(spark, sf_dir).df.select("id", M.sqrt(p0).alias("a"), M.exp(-p1).alias("b"), M.atan2(p0 + 1, p1 + 1).alias("c"), M.fmod(p0 * 7, F.lit(3.0)).alias("d"), (M.log2(p0 + 1) + M.log10(p1 + 1) + M.log(p0 + 2)).alias("e"), M.trunc(v0 * 10).alias("f"), F.round(M.tgamma(p1 / 4 + 0.5), 4).alias("g"), M.fma(v0, F.lit(10.0), p0).alias("h"), (M.sincos(p0)[0] + M.sincos(p1)[1] + M.tan(v0)).alias("i"), M.rsqrt(p0 + 1).alias("j"))
    return _round(df, "id", "f", "g")


@query(EV + "SELECT id, V_0 * V_0 + V_1 * 2 + 3 * V_0 AS dot, V_1 * V_0 - 3 * 2 AS c_0, 3 * V_0 - V_0 * V_0 AS c_1, V_0 * 2 - V_1 * V_0 AS c_2 FROM ev")
def j2_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = [F.col("V_0"), F.col("V_1"), F.lit(3.0)], [F.col("V_0"), F.lit(2.0), F.col("V_0")]
    return events(spark, sf_dir).df.select("id", M.dot(a, b).alias("dot"), *(c.alias(f"c_{k}") for k, c in enumerate(M.cross(a, b))))


@query(EV + "SELECT id, CASE WHEN V_0 = V_1 THEN P_0 < P_1 ELSE V_0 < V_1 END AS first FROM ev")
def j3_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).df.select("id", G.ordered_by_x(F.col("V_0"), F.col("P_0"), F.col("V_1"), F.col("P_1")).alias("first"))


@query(EV + ", s AS (SELECT id, P_0, P_1, P_0 + 8 * V_0 - P_0 AS ux, P_1 + 8 * V_1 - P_1 AS uy FROM ev WHERE V_0 + V_1 <> 0), l AS (SELECT *, ((10 - P_0) * (-10) - (15 - P_1) * 10) / (ux * (-10) - uy * 10) AS l FROM s) SELECT id, l BETWEEN 0 AND 1 AND P_0 + l * ux BETWEEN 10 AND 20 AND P_1 + l * uy BETWEEN 5 AND 15 AS hit, round(l, 6) AS along FROM l")
def j4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps against the segment from (10, 15) to (20, 5)."""
    p, v = [F.col("P_0"), F.col("P_1")], [F.col("V_0") * 8, F.col("V_1") * 8]
    m = G.segments_meet(p[0], p[1], p[0] + v[0], p[1] + v[1], *(F.lit(x) for x in (10.0, 15.0, 20.0, 5.0)))
    return events(spark, sf_dir).df.where("V_0 + V_1 <> 0").withColumn("m", m).select("id", F.col("m.hit").alias("hit"), six(F.col("m.along")).alias("along"))


@query(EV + ", s AS (SELECT id, P_0, 8 * V_0 AS ux, P_1 - 12 AS da, P_1 + 8 * V_1 - 12 AS db FROM ev) SELECT id, da * db <= 0 AND abs(da) + abs(db) <> 0 AND P_0 + (abs(da) / (abs(da) + abs(db))) * ux BETWEEN 5 AND 25 AS hit FROM s")
def j5_aligned_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps against the edge from (5, 12) to (25, 12)."""
    p, step = [F.col("P_0"), F.col("P_1")], [8 * F.col("V_0"), 8 * F.col("V_1")]
    m = G.meets_aligned(p, [p[0] + step[0], p[1] + step[1]], 1, F.lit(12.0), [F.lit(5.0), F.lit(0.0)], [F.lit(25.0), F.lit(0.0)], step=step)
    return events(spark, sf_dir).df.select("id", m["hit"].alias("hit"))


@query(EV + ", s AS (SELECT id, P_0, P_1, 8 * V_0 AS ux, 8 * V_1 AS uy, Q_0 - 30 AS da, 30 - Q_0 AS db FROM ev) SELECT id, abs(da) + abs(db) <> 0 AND P_0 + 0.5 * ux BETWEEN 5 AND 25 AND P_1 + 0.5 * uy BETWEEN 4 AND 20 AS hit FROM s")
def j6_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in 3-D through a rectangle at half way.

    Heights are from the plane: 60 - Q_0 is rounded for heights below it, and then half way is not half.
    """
    p = [F.col("P_0"), F.col("P_1"), F.col("Q_0") - 30]
    step = [8 * F.col("V_0"), 8 * F.col("V_1"), -2 * p[2]]
    end = [p[0] + step[0], p[1] + step[1], -p[2]]
    m = G.meets_aligned(p, end, 2, F.lit(0.0), [F.lit(5.0), F.lit(4.0), F.lit(0.0)], [F.lit(25.0), F.lit(20.0), F.lit(0.0)], step=step)
    return events(spark, sf_dir).df.select("id", m["hit"].alias("hit"))


@query(EV + "SELECT id, round(1 / (P_0 + 1), 6) AS i_00, round(-V_0 / ((P_0 + 1) * (P_1 + 2)), 6) AS i_01, round((V_0 * V_1 / (P_1 + 2)) / ((P_0 + 1) * 4), 6) AS i_02, 0.25::DOUBLE AS i_22 FROM ev")
def j7_matrix_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse of an upper triangular 3 x 3 matrix by cofactors."""
    z, l = F.lit(0.0), F.lit
    m = [[F.col("P_0") + 1, F.col("V_0"), z], [z, F.col("P_1") + 2, F.col("V_1")], [z, z, l(4.0)]]
    i = M.inverse(m)
    return _round(events(spark, sf_dir).df.select("id", i[0][0].alias("i_00"), i[0][1].alias("i_01"), i[0][2].alias("i_02"), i[2][2].alias("i_22")), "id")


@query(EV + "SELECT id, round(1 / (P_0 + 1), 6) AS i_0, round(-V_0 / ((P_0 + 1) * (P_1 + 2)), 6) AS i_1, round(1 / (P_1 + 2), 6) AS i_3 FROM ev")
def j8_invert_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.array(F.col("P_0") + 1, F.col("V_0"), F.lit(0.0), F.col("P_1") + 2)
    got = events(spark, sf_dir).df.select("id", M.invert_matrix(m).alias("m"))
    return _round(got.select("id", F.element_at("m", 1).alias("i_0"), F.element_at("m", 2).alias("i_1"), F.element_at("m", 4).alias("i_3")), "id")


@query(EV + "SELECT id, round(1 - x / 3 , 6) AS l_0, round((x - y) / 3, 6) AS l_1, round(y / 3, 6) AS l_2 FROM (SELECT id, P_0 % 3 AS x, P_1 % 3 AS y FROM ev)")
def j10_triangle_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, l = F.col("P_0") % 3, F.col("P_1") % 3, F.lit
    w = G.triangle_weights([(l(0.0), l(0.0)), (l(3.0), l(0.0)), (l(3.0), l(3.0))], x, y)
    return _round(events(spark, sf_dir).df.select("id", *(c.alias(f"l_{k}") for k, c in enumerate(w))), "id")


@query(EV + "SELECT id, round((1 - s) * (1 - t), 6) AS l_0, round(s * (1 - t), 6) AS l_1, round(s * t, 6) AS l_2, round((1 - s) * t, 6) AS l_3 FROM (SELECT id, (greatest(-1, least(1, 2 * V_0)) + 1) * 0.5 AS s, (greatest(-1, least(1, V_1)) + 1) * 0.5 AS t FROM ev)")
def j11_quad_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = G.quad_weights(F.col("V_0") * 2, F.col("V_1"))
    return _round(events(spark, sf_dir).df.select("id", *(c.alias(f"l_{k}") for k, c in enumerate(w))), "id")


_QUAD = [(0.0, 0.0), (2.0, 0.25), (2.25, 1.75), (0.25, 1.5)]


@query(EV + "SELECT id, round(P_0 / 15 - 1, 6) + 0 AS e_0, round(P_1 / 12 - 1, 6) + 0 AS e_1 FROM ev")
def j12_quad_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a skewed quad and back: the inverse returns the collapsed coordinates."""
    q = [(F.lit(a), F.lit(b)) for a, b in _QUAD]
    xy = events(spark, sf_dir).df.select("id", *(c.alias(n) for c, n in zip(G.quad_point(q, F.col("P_0") / 15 - 1, F.col("P_1") / 12 - 1), ("x", "y"))))
    e = G.quad_collapsed(q, F.col("x"), F.col("y"))
    return xy.select("id", (six(e[0]) + 0).alias("e_0"), (six(e[1]) + 0).alias("e_1"))


@query(EV + "SELECT id, round((1 - s) * (1 - t) * 0 + s * (1 - t) * 2 + s * t * 2.25 + (1 - s) * t * 0.25, 6) AS x, round(s * (1 - t) * 0.25 + s * t * 1.75 + (1 - s) * t * 1.5, 6) AS y FROM (SELECT id, P_0 / 30 AS s, P_1 / 24 AS t FROM ev)")
def j13_quad_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [(F.lit(a), F.lit(b)) for a, b in _QUAD]
    x, y = G.quad_point(q, F.col("P_0") / 15 - 1, F.col("P_1") / 12 - 1)
    return _round(events(spark, sf_dir).df.select("id", x.alias("x"), y.alias("y")), "id")


@query(EV + "SELECT id, round(sqrt(pow(sqrt(x * x + y * y) - 3, 2) + z * z), 6) AS r, round(atan2(y, x), 6) AS phi, round(atan2(z, sqrt(x * x + y * y) - 3), 6) AS theta, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM (SELECT id, P_0 + 1 AS x, P_1 + 1 AS y, V_0 AS z FROM ev)")
def j14_torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To torus coordinates and back."""
    t = G.to_torus(3.0, F.col("P_0") + 1, F.col("P_1") + 1, F.col("V_0"))
    df = events(spark, sf_dir).df.select("id", *(c.alias(n) for c, n in zip(t, ("r", "phi", "theta"))))
    back = G.from_torus(3.0, F.col("r"), F.col("phi"), F.col("theta"))
    return _round(df.select("*", *(c.alias(n) for c, n in zip(back, ("x", "y", "z")))), "id")


@query("SELECT v AS k, (v + 6) // 7 AS up, (v + 6) // 7 * 7 AS multiple, v > 0 AND bit_count(v) = 1 AS power, v % 8 * 12 + least(v % 8, 4) AS start, v % 3 * 20 + v % 4 * 5 + v % 5 AS nd FROM range(256) t(v)")
def j15_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return spark.range(256).select(k.alias("k"), M.div_round_up(k, F.lit(7)).alias("up"), M.next_multiple(k, F.lit(7)).alias("multiple"), M.is_power_of_two(k).alias("power"), M.decomp_1d(8, 100, k % 8)[0].alias("start"), M.nd_index([k % 3, k % 4, k % 5], [3, 4, 5]).alias("nd"))


# --- K: deposition and boundaries

@query(EV + ", s AS (SELECT cell, sum(W_0) AS w FROM ev GROUP BY cell) SELECT c AS cell, CAST(coalesce(w, 0) AS DOUBLE) / 1 AS dof_0 FROM range(720) t(c) LEFT JOIN s ON s.cell = c")
def k1_project_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    project, _ = deposit.project_evaluate("DG", 0)
    return project(events(spark, sf_dir).df, [F.col("W_0").cast("double")], MESH.cells(spark).select("cell", "volume"))


@query(EV + ", s AS (SELECT cell, CAST(sum(W_0) AS DOUBLE) AS w FROM ev GROUP BY cell) SELECT id, w AS R_0 FROM ev JOIN s USING (cell)")
def k2_evaluate_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).df
    dofs = deposit.project_constant(rows, [F.col("W_0").cast("double")], MESH.cells(spark).select("cell", "volume"))
    return deposit.evaluate_constant(rows, dofs, "R").select("id", "R_0")


_TRI_ROWS = ", tri AS (SELECT id, W_0, P_0, P_1, x, y, y >= x AS up, (CAST(floor(P_0 / 3) AS BIGINT) + 10 * CAST(floor(P_1 / 3) AS BIGINT)) * 2 + CASE WHEN y >= x THEN 1 ELSE 0 END AS cell FROM (SELECT *, P_0 - 3 * floor(P_0 / 3) AS x, P_1 - 3 * floor(P_1 / 3) AS y FROM ev)), wt AS (SELECT *, CASE WHEN up THEN 1 - y / 3 ELSE 1 - x / 3 END AS l0, CASE WHEN up THEN x / 3 ELSE (x - y) / 3 END AS l1, CASE WHEN up THEN (y - x) / 3 ELSE y / 3 END AS l2 FROM tri) "


def _on_triangles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corners, _ = triangles(spark)
    x, y = (F.col(f"P_{d}") - 3 * F.floor(F.col(f"P_{d}") / 3) for d in range(2))
    cell = (F.floor(F.col("P_0") / 3) + 10 * F.floor(F.col("P_1") / 3)) * 2 + F.when(y >= x, 1).otherwise(0)
    return events(spark, sf_dir).df.select("id", "P_0", "P_1", "W_0", cell.cast("bigint").alias("cell")), corners.withColumnRenamed("mesh_cell", "cell")


@query(EV + _TRI_ROWS + "SELECT cell, round(sum(l0 * W_0), 4) AS q_0, round(sum(l1 * W_0), 4) AS q_1, round(sum(l2 * W_0), 4) AS q_2 FROM wt GROUP BY cell")
def k3_project_barycentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, corners = _on_triangles(spark, sf_dir)
    q = deposit.project_barycentric(rows, corners, F.col("P_0"), F.col("P_1"), F.col("W_0"))
    return q.select("cell", *(F.round(f"q_{k}", 4).alias(f"q_{k}") for k in range(3)))


@query(EV + _TRI_ROWS + "SELECT id, round(l0 * cell + l1 * 2 * cell + l2 * 3, 6) AS value FROM wt")
def k4_evaluate_barycentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, corners = _on_triangles(spark, sf_dir)
    _, evaluate = deposit.project_evaluate("Barycentric", 1)
    values = corners.select("cell", F.col("cell").cast("double").alias("q_0"), (F.col("cell") * 2.0).alias("q_1"), F.lit(3.0).alias("q_2"))
    return _round(evaluate(rows, corners, values, F.col("P_0"), F.col("P_1"), "value").select("id", "value"), "id")


@query(EV + ", s AS (SELECT cell, CAST(sum(W_0) AS BIGINT) AS w FROM ev GROUP BY cell) SELECT cell * 7 % 720 AS external, CAST(w AS BIGINT) AS value FROM s")
def k6_external_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs = events(spark, sf_dir).df.groupBy("cell").agg(F.sum("W_0").alias("value")).withColumn("dof", F.lit(0))
    index = spark.range(MESH.ncells).select(F.col("id").alias("cell"), F.lit(0).alias("dof"), (F.col("id") * 7 % 720).alias("external"))
    return deposit.to_external(dofs, index)


# steps of 16 V of every row; the closed domain is drawn in by half a cell, so that each step starts inside
_INNER = [0.5, 29 / 30, 23 / 24]
_STEP = f""", i AS (SELECT id, W_0, V_0, V_1, {_INNER[0]} + P_0 * {_INNER[1]!r}::DOUBLE AS a0, {_INNER[0]} + P_1 * {_INNER[2]!r}::DOUBLE AS a1 FROM ev),
s AS (SELECT *, a0 + 16 * V_0 AS b0, a1 + 16 * V_1 AS b1 FROM i),
d AS (SELECT *, CASE WHEN b1 - 1e-10 <= 0 THEN 0::DOUBLE ELSE 24::DOUBLE END AS ly, CASE WHEN b0 - 1e-10 <= 0 THEN 0::DOUBLE ELSE 30::DOUBLE END AS lx FROM s WHERE b0 <= 0 OR b0 >= 30 OR b1 <= 0 OR b1 >= 24),
e AS (SELECT *, abs(a1 - ly) AS y1, abs(b1 - ly) AS y2, abs(a0 - lx) AS x1, abs(b0 - lx) AS x2 FROM d),
f AS (SELECT *, a0 + CASE WHEN y1 + y2 = 0 THEN 0 ELSE y1 / (y1 + y2) END * (b0 - a0) AS hx, a1 + CASE WHEN x1 + x2 = 0 THEN 0 ELSE x1 / (x1 + x2) END * (b1 - a1) AS hy FROM e),
h AS (SELECT *, (a1 - ly) * (b1 - ly) <= 0 AND y1 + y2 <> 0 AND hx BETWEEN -1e-10 AND 30 + 1e-10 AS vertical FROM f),
hit AS (SELECT *, CASE WHEN vertical THEN CASE WHEN ly = 0 THEN 0 ELSE 2 END ELSE CASE WHEN lx = 0 THEN 3 ELSE 1 END END AS facet, CASE WHEN vertical THEN hx ELSE lx END AS p0, CASE WHEN vertical THEN ly ELSE hy END AS p1 FROM h),
el AS (SELECT *, CASE facet WHEN 0 THEN least(CAST(trunc(p0) AS BIGINT), 29) WHEN 2 THEN 54 + least(CAST(trunc(p0) AS BIGINT), 29) WHEN 1 THEN 30 + least(CAST(trunc(p1) AS BIGINT), 23) ELSE 84 + least(CAST(trunc(p1) AS BIGINT), 23) END AS element FROM hit) """
_GROUPS = {0: 1, 1: 2, 2: 1}


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = [F.lit(_INNER[0]) + F.col(f"P_{d}") * F.lit(_INNER[1 + d]) for d in range(2)]
    rows = events(spark, sf_dir).df.select("id", "W_0", "V_0", "V_1", *(p.alias(f"PP_{d}") for d, p in enumerate(before)))
    rows = rows.withColumns({f"P_{d}": F.col(f"PP_{d}") + 16 * F.col(f"V_{d}") for d in range(2)})
    return boundary.trajectory_hits(rows, MESH, [F.col("PP_0"), F.col("PP_1")], [F.col("P_0"), F.col("P_1")], _GROUPS)


@query(EV + _STEP + "SELECT id, facet, CASE facet WHEN 3 THEN NULL WHEN 1 THEN 2 ELSE 1 END AS boundary_group, round(p0, 6) AS point_0, round(p1, 6) AS point_1, element FROM el")
def k7_trajectory_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_hits(spark, sf_dir).select("id", "facet", "boundary_group", "point_0", "point_1", "element"), "id", "facet", "boundary_group", "element")


@query(EV + _STEP + "SELECT element, CAST(sum(W_0) AS DOUBLE) AS value, count(*) AS n FROM el WHERE facet <> 3 GROUP BY element")
def k8_surface_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions on the faces of two boundary groups, evaluated again at the hits."""
    hits = _hits(spark, sf_dir).where("boundary_group IS NOT NULL")
    f = boundary.surface_function(hits, F.col("W_0"), 1 / MESH.fine_width)
    return boundary.surface_evaluate(hits, f, "value").groupBy("element").agg(F.first("value").alias("value"), F.count("*").alias("n"))


@query(EV + ", s AS (SELECT id, P_0 AS a0, P_1 AS a1, P_0 + 16 * V_0 AS b0, V_0 FROM ev WHERE V_1 = 0 AND V_0 <> 0) SELECT id, e AS edge, CAST(e % 2 AS INTEGER) AS boundary_group, CAST(4 + 5 * e AS DOUBLE) AS x, round(a1, 6) AS y FROM (SELECT s.*, e, row_number() OVER (PARTITION BY id ORDER BY abs(4 + 5 * e - a0), e) AS k FROM s, range(5) t(e) WHERE 4 + 5 * e BETWEEN least(a0, b0) AND greatest(a0, b0) AND a1 <= 20) WHERE k = 1")
def k9_nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal steps against five upright edges; the nearest wins."""
    k = F.col("id")
    x = (4 + 5 * k).cast("double")
    edges = spark.range(5).select(k.alias("edge"), (k % 2).cast("int").alias("boundary_group"), x.alias("ax"), F.lit(0.0).alias("ay"), x.alias("bx"), F.lit(20.0).alias("by"))
    steps = events(spark, sf_dir).df.where("V_1 = 0 AND V_0 <> 0")
    got = boundary.nearest_edge(steps, edges, MESH, [F.col("P_0"), F.col("P_1")], [F.col("P_0") + 16 * F.col("V_0"), F.col("P_1")])
    return _round(got, "id", "edge", "boundary_group")


@query(EV + _STEP + "SELECT id, CASE facet WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END::DOUBLE AS normal_0, CASE facet WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END::DOUBLE AS normal_1 FROM el")
def k10_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("id", "normal_0", "normal_1")


_TRUNC = """, o AS (SELECT *, sqrt((a0 - p0) * (a0 - p0) + (a1 - p1) * (a1 - p1)) AS len, sqrt((b0 - a0) * (b0 - a0) + (b1 - a1) * (b1 - a1)) AS full_ FROM el),
r AS (SELECT *, CASE WHEN len > 0.25 THEN p0 + (a0 - p0) * (0.25 / len) ELSE a0 END AS n0, CASE WHEN len > 0.25 THEN p1 + (a1 - p1) * (0.25 / len) ELSE a1 END AS n1, CASE WHEN full_ > 1e-16 THEN least(1, len / full_) ELSE 1 END AS share FROM o) """


@query(EV + _STEP + _TRUNC + "SELECT id, round(n0, 6) AS P_0, round(n1, 6) AS P_1, round(1 - 0.5 + 0.5 * share, 6) AS TSP_0, round(0.5 * share, 6) AS TSP_1 FROM r")
def k11_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumns({"TSP_0": F.lit(1.0), "TSP_1": F.lit(0.5)})
    return _round(boundary.truncate(hits, 2, 0.25).select("id", "P_0", "P_1", "TSP_0", "TSP_1"), "id")


@query(EV + _STEP + "SELECT id, CASE WHEN facet IN (1, 3) THEN -V_0 ELSE V_0 END + 0 AS V_0, CASE WHEN facet IN (0, 2) THEN -V_1 ELSE V_1 END + 0 AS V_1 FROM el")
def k12_reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    assert boundary.has_boundary_columns(hits, 2)
    return boundary.reflect(hits, 2, 0.25).select("id", (F.col("V_0") + 0).alias("V_0"), (F.col("V_1") + 0).alias("V_1"))


@query("SELECT * FROM (VALUES ('Barycentric', 1, true), ('Barycentric', 0, false), ('DG', 0, true), ('DG', 1, false)) t(space, ord, known)")
def k5_function_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which function spaces can be projected to and evaluated."""
    rows = []
    for space in ("DG", "Barycentric"):
        for order in (0, 1):
            try:
                rows.append((space, order, bool(deposit.project_evaluate(space, order))))
            except ValueError:
                rows.append((space, order, False))
    return spark.createDataFrame(rows, "space string, ord int, known boolean")


@query(EV + "SELECT true AS hits, false AS rows")
def k13_boundary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables hold what a boundary hit adds."""
    return spark.createDataFrame([(boundary.has_boundary_columns(_hits(spark, sf_dir), 2), boundary.has_boundary_columns(events(spark, sf_dir).df, 2))], "hits boolean, rows boolean")
