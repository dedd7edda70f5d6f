"""Queries: sources and sinks, properties, row updates, selections, layers, sets, row mutation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..group import Ephemeral, Group, cell_range, disjoint_union, with_layers
from ..mesh import CartesianMesh
from ..operators import cellwise, mapping, products
from ..operators.arrays import NDArray
from ..polygons import PolygonMesh
from ..sources import export, metrics, steps, tables, vtkhdf
from ..spec import INT, Prop, Spec
from .catalog import query
from .fixtures import EV, MESH, OR, SPEC, event_rows, events, orders, table


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; in local mode a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="meshlark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/q-{uuid.uuid4().hex}"


# --- A: sources and sinks

@query(EV + "SELECT id, cell, P_0, P_1, W_0, CAST(0 AS DOUBLE) AS X_0, CAST(0 AS BIGINT) AS N_0 FROM ev")
def a1_particle_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row batch: properties that it lacks are zero."""
    spec = Spec((SPEC.get("P"), SPEC.get("W"), Prop("X"), Prop("N", 1, INT)))
    return spec.align(events(spark, sf_dir).df, keep=("id", "cell"))


@query(EV + "SELECT cell, count(*) AS n, CAST(sum(W_0) AS BIGINT) AS w FROM (SELECT cell, W_0 FROM ev UNION ALL SELECT cell, 0 FROM ev WHERE id % 3 = 0) GROUP BY cell")
def a2_add_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    batch = g.df.where("id % 3 = 0").select((-F.col("id") - 1).alias("id"), "cell", "P_0", "P_1", F.lit(1.0).alias("EXTRA_0"))
    return g.add(batch).df.groupBy("cell").agg(F.count("*").alias("n"), F.sum("W_0").alias("w"))


@query(EV + "SELECT SPECIES_0, count(*) AS n, CAST(sum(W_0) AS BIGINT) AS w FROM (SELECT SPECIES_0, W_0 FROM ev UNION ALL SELECT 0, W_0 FROM ev WHERE id % 2 = 0) GROUP BY SPECIES_0")
def a4_add_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    spec = Spec((SPEC.get("P"), SPEC.get("W"), Prop("ONLY")))
    other = Group.of(g.df.where("id % 2 = 0"), spec, MESH)
    return g.add_group(other).df.groupBy("SPECIES_0").agg(F.count("*").alias("n"), F.sum("W_0").alias("w"))


@query(EV + "SELECT cell, count(*) AS n FROM (SELECT cell FROM ev UNION ALL SELECT cell FROM ev WHERE Q_0 > 50) GROUP BY cell")
def a5_add_sub_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return g.add_group(g.sub(F.col("Q_0") > 50)).df.groupBy("cell").agg(F.count("*").alias("n"))


@query(EV + "SELECT step, count(*) AS n, CAST(sum(W_0) AS BIGINT) AS w, max(P_0) AS x FROM (SELECT 0 AS step, W_0, P_0 FROM ev UNION ALL SELECT 5, W_0, P_0 FROM ev WHERE SPECIES_0 = 0) GROUP BY step")
def a6_write_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t = events(spark, sf_dir), steps.Trajectory(scratch(spark), SPEC, ["W"])
    t.write(g.df)
    t.write(g.sub(F.col("SPECIES_0") == 0).rows(), 5)
    return t.read(spark, xyz=True).groupBy("step").agg(F.count("*").alias("n"), F.sum("W_0").alias("w"), F.max("x").alias("x"))


@query(EV + "SELECT id, P_0 + 0 AS P_0, P_1 + 0 AS P_1 FROM ev")
def a7_array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    spec = Spec((SPEC.get("P"),))
    return steps.from_arrays(steps.as_arrays(g.df.select("id", *spec.columns), spec), spec).select("id", "P_0", "P_1")


@query(EV + "SELECT P_0, P_1, W_0, 1 AS step FROM ev WHERE id % 10 = 1")
def a8_read_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t = events(spark, sf_dir), steps.Trajectory(scratch(spark), SPEC, ["W"])
    for k in range(10):  # the ten steps hold every row
        t.write(g.df.where(F.col("id") % 10 == k))
    return t.read(spark, 1).select("P_0", "P_1", "W_0", "step")


@query(EV + "SELECT cell, layer, concat_ws(' ', CAST(id AS VARCHAR), CAST(W_0 AS VARCHAR)) AS line FROM lay WHERE cell >= 100 AND cell < 120")
def a9_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.dump(events(spark, sf_dir).df, ["id", "W_0"], (100, 120))


@query(EV + "SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, id, W_0 FROM lay")
def a10_get_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows at every (cell, layer), asked for in order of id."""
    g = events(spark, sf_dir)
    requests = cellwise.exclusive_scan(with_layers(g.df).withColumn("one", F.lit(1)), "id", "one", "ordinal").select("ordinal", "cell", "layer")
    return g.get(requests).select("ordinal", "id", "W_0")


@query(EV + "SELECT layer, P_0, P_1 FROM lay WHERE cell = 100")
def a11_get_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).cell_rows(100, "P")


@query("SELECT CAST(c AS BIGINT) AS cell, corner, CAST(c % 30 + (corner // 2) AS DOUBLE) AS x_0, CAST(c // 30 + corner % 2 AS DOUBLE) AS x_1 FROM range(720) t(c), range(4) s(corner)")
def a12_cell_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.cell_outlines(spark, MESH)


@query("SELECT CAST(c AS BIGINT) AS cell, CAST(9 AS INTEGER) AS kind, k AS corner, CAST(c % 30 + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS DOUBLE) AS x_0, CAST(c // 30 + CASE WHEN k >= 2 THEN 1 ELSE 0 END AS DOUBLE) AS x_1, c * 0.25::DOUBLE AS w FROM range(720) t(c), (SELECT CAST(i AS INTEGER) AS k FROM range(4) s(i))")
def a12_vtkhdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as VTKHDF files with a value each, and read back: corners in the viewer's order."""
    path = scratch(spark) + "/grid"
    vtkhdf.write(vtkhdf.cells_of(export.cell_outlines(spark, MESH), 2).withColumn("w", F.col("cell") * 0.25), path)
    rows = vtkhdf.read(spark, path).select(F.element_at("cell_data", "cell").cast("bigint").alias("cell"), "kind", F.element_at("cell_data", "w").alias("w"), F.posexplode("points").alias("corner", "p"))
    return rows.select("cell", "kind", "corner", *(F.element_at("p", d + 1).alias(f"x_{d}") for d in range(2)), "w")


@query("SELECT CAST(c AS BIGINT) AS cell, c % 16 AS c_0, c // 16 AS c_1, (c % 16) * 0.5::DOUBLE AS x_0, (c // 16) * 0.5::DOUBLE AS x_1, 0.25::DOUBLE AS volume FROM range(128) t(c)")
def a13_hierarchy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CartesianMesh((8, 4), 1.0, 1).cells(spark)


@query("SELECT CAST(l AS INTEGER) AS level, CAST(c AS BIGINT) AS cell, (c % (8 * (l + 1))) * 1.0::DOUBLE / (l + 1) AS x_0, (c // (8 * (l + 1))) * 1.0::DOUBLE / (l + 1) AS x_1, 1.0::DOUBLE / (l + 1) AS width FROM range(2) s(l), range(128) t(c) WHERE c < 32 * (l + 1) * (l + 1)")
def a13_hierarchy_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse and fine cells of a hierarchy dumped for viewers, and read back: their first corners and widths."""
    path = scratch(spark)
    for level in (0, 1):
        outlines = export.cell_outlines(spark, CartesianMesh((8, 4), 1.0, level))
        vtkhdf.write(vtkhdf.cells_of(outlines, 2).withColumn("level", F.lit(level)), f"{path}/{level}")
    rows = vtkhdf.read(spark, f"{path}/0").union(vtkhdf.read(spark, f"{path}/1"))
    data, corner = (lambda k: F.element_at("cell_data", k)), (lambda k, d: F.element_at(F.element_at("points", k), d))
    return rows.select(data("level").cast("int").alias("level"), data("cell").cast("bigint").alias("cell"), corner(1, 1).alias("x_0"), corner(1, 2).alias("x_1"), (corner(2, 1) - corner(1, 1)).alias("width"))


@query(EV + "SELECT 'loop' AS key1, 'advect' AS key2, count(*) AS rows, 64 * count(*) AS bytes, 4 * count(*) AS flops FROM ev UNION ALL SELECT 'loop', 'hot', count(*), 64 * count(*), 0 FROM ev WHERE Q_0 > 30")
def a14_row_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, property bytes and operations of two loops, observed while they run."""
    g, seen = events(spark, sf_dir), metrics.Regions()
    moved = g.update({f"P_{d}": F.col(f"P_{d}") + 0.1 * F.col(f"V_{d}") for d in range(2)}).df
    for name, df, flops in (("advect", moved, 4), ("hot", g.sub(F.col("Q_0") > 30).rows(), 0)):
        with seen.region("program", name):
            seen.observe(df, "loop", name, g.spec, flops).write.format("noop").mode("overwrite").save()
    return seen.table(spark).where("key1 = 'loop'").select("key1", "key2", "rows", "bytes", "flops")


@query(EV + "SELECT concat('events:', USER_0) AS name, 'PERF' AS cat, 'X' AS ph, id * 1e6::DOUBLE AS ts, greatest(1, (id + CAST(W_0 AS DOUBLE) / 1024) * 1e6 - id * 1e6)::DOUBLE AS dur, SPECIES_0 AS pid, SPECIES_0 AS tid FROM ev WHERE id >= 100 AND id + CAST(W_0 AS DOUBLE) / 1024 <= 1e9")
def a15_trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles written as JSON, a region for each event, converted to trace events from second 100 on."""
    path = scratch(spark)
    region = F.array(F.lit("events"), F.col("USER_0").cast("string"), F.col("id").cast("string"), (F.col("id") + F.col("W_0") / F.lit(1024.0)).cast("string"), *[F.lit("0")] * 3)
    events(spark, sf_dir).df.select(F.col("SPECIES_0").alias("rank"), F.array(region).alias("regions")).write.json(path + "/profile")
    return metrics.trace_events(spark, path + "/profile", 100.0, 1e9)


# --- B: properties

@query(EV + "SELECT id, CAST(0 AS DOUBLE) AS E_0, CAST(0 AS DOUBLE) AS E_1, W_0 FROM ev")
def b1_add_remove_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).add_prop(Prop("E", 2)).remove_prop("Q")
    assert "Q_0" not in g.df.columns
    return g.df.select("id", "E_0", "E_1", "W_0")


@query("SELECT * FROM (VALUES ('P', 2), ('Q', 1), ('SPECIES', 1), ('USER', 1), ('V', 2), ('W', 1)) t(name, ncomp)")
def b3_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return spark.createDataFrame([(p.name, p.ncomp) for p in g.spec.props if p.name in g.spec], "name string, ncomp int")


@query(EV + "SELECT count(*) AS n FROM ev WHERE false")
def b4_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).clear().df.agg(F.count("*").alias("n"))


@query(EV + "SELECT id, CASE WHEN SPECIES_0 = 1 THEN W_0 * 2 ELSE W_0 END AS W_0 FROM ev")
def b6_ephemeral_to_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = events(spark, sf_dir).sub(F.col("SPECIES_0") == 1)
    return Ephemeral(view, {"E_0": F.col("W_0") * 2}).to_group({"E_0": "W_0"}).df.select("id", "W_0")


@query("SELECT CAST(NULL AS BIGINT) AS n WHERE false")
def b7_temporary_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([], SPEC.struct()).select(F.col("W_0").alias("n"))


@query(EV + "SELECT id, P_0 + V_0 AS s_0, P_1 + V_1 AS s_1 FROM ev")
def b8_property_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kernel over a list of properties, by position."""
    chosen = [SPEC.get("P"), SPEC.get("V")]
    return events(spark, sf_dir).df.select("id", *((F.col(chosen[0].columns[k]) + F.col(chosen[1].columns[k])).alias(f"s_{k}") for k in range(2)))


# --- C: row-wise updates

@query(EV + "SELECT id, W_0 * 2 + SPECIES_0 AS W_0 FROM ev")
def c1_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).update({"W_0": F.col("W_0") * 2 + F.col("SPECIES_0")}).df.select("id", "W_0")


@query(EV + "SELECT id, V_0 * 2 AS V_0, V_1 * 2 AS V_1 FROM ev")
def c2_loop_over_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return g.update({c: F.col(c) * 2 for c in g.spec.get("V").columns}).df.select("id", "V_0", "V_1")


@query(EV + "SELECT id, CASE WHEN Q_0 > 30 AND SPECIES_0 < 2 THEN -1 ELSE W_0 END AS W_0 FROM ev")
def c3_loop_over_sub_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = events(spark, sf_dir).sub(F.col("Q_0") > 30).sub(F.col("SPECIES_0") < 2)
    return view.update({"W_0": F.lit(-1)}).df.select("id", "W_0")


@query(EV + "SELECT id, CASE WHEN cell >= 100 AND cell < 300 THEN 0 ELSE W_0 END AS W_0 FROM ev")
def c4_cell_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).update({"W_0": F.lit(0)}, cells=(100, 300)).df.select("id", "W_0")


@query(EV + "SELECT id, W_0 * (SPECIES_0 * 10 + 1) AS W_0 FROM ev")
def c6_local_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of factors, looked up by species."""
    k = spark.range(4)
    factors = NDArray(k.select(F.col("id").alias("i"), (F.col("id") * 10 + 1).alias("value")), (4,))
    return factors.read(events(spark, sf_dir).df, [F.col("SPECIES_0")], "f").select("id", (F.col("W_0") * F.col("f")).alias("W_0"))


@query(EV + ", w AS (SELECT SPECIES_0 * 2 + USER_0 % 2 AS i, max_by(W_0, id) AS v FROM ev GROUP BY ALL) SELECT k AS i, CAST(coalesce(v, -1) AS BIGINT) AS value FROM range(8) t(k) LEFT JOIN w ON w.i = k")
def c7_local_array_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scatter whose last writer is the largest id."""
    a = NDArray.filled(spark, (4, 2)).fill(-1)
    return a.write(events(spark, sf_dir).df, [F.col("SPECIES_0"), F.col("USER_0") % 2], F.col("W_0"), F.col("id")).table.select("i", F.col("value").cast("bigint").alias("value"))


@query(EV + "SELECT id, W_0 + cell % 10 AS W_0 FROM ev")
def c8_cell_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_cell = spark.range(MESH.ncells).select(F.col("id").alias("cell"), (F.col("id") % 10).alias("m"))
    return events(spark, sf_dir).df.join(per_cell, "cell").select("id", (F.col("W_0") + F.col("m")).alias("W_0"))


@query("SELECT CAST(c AS BIGINT) AS cell, r AS row, k AS col, CASE WHEN c = 7 AND r = 1 AND k = 0 THEN 42.0 ELSE 0.5 END::DOUBLE AS value FROM range(720) t(c), range(2) s(r), range(2) u(k)")
def c10_cell_matrix_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(7, 1, 0, 42.0)], "cell long, row int, col int, value double")
    return cellwise.set_values(cellwise.fill(spark, MESH, 2, 2, 0.5), new)


@query(EV + ", s AS (SELECT SPECIES_0 AS row, sum(W_0) AS w, count(*) AS n FROM ev GROUP BY SPECIES_0) SELECT ev.id, CAST(CASE WHEN SPECIES_0 = 2 THEN -1 ELSE 100 + w END AS BIGINT) AS W_0, CAST(n AS DOUBLE) AS Q_0 FROM ev JOIN s ON s.row = SPECIES_0")
def c12_product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows of an integer and a real component: adds by every event, a write to one row, and a read by every event."""
    g = events(spark, sf_dir)
    made = products.Rows.zeros(spark, 4, Spec((SPEC.get("W"), SPEC.get("Q")))).add(spark.range(4).select(F.col("id").alias("row"), F.lit(100).alias("W_0")))
    made = made.add(g.df.select(F.col("SPECIES_0").alias("row"), "W_0", F.lit(1.0).alias("Q_0"))).write(spark.range(2, 3).select(F.col("id").alias("row"), F.lit(-1).alias("W_0")))
    return made.read(g.df.select("id", F.col("SPECIES_0").alias("row"))).select("id", "W_0", "Q_0")


@query(EV + "SELECT id, cell * 3 AS W_0 FROM ev")
def c15_cellwise_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.range(MESH.ncells).select(F.col("id").alias("cell"), (F.col("id") * 3).alias("value"))
    return cellwise.broadcast_values(events(spark, sf_dir).df, values, MESH, "W_0").select("id", "W_0")


@query("SELECT CAST(c AS BIGINT) AS cell, r AS row, k AS col, (2.0 + CAST(c AS DOUBLE)) * 3.0 AS value FROM range(720) t(c), range(2) s(r), range(3) u(k)")
def c16_element_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cellwise.fill(spark, MESH, 2, 3, 2.0).withColumn("value", F.col("value") + F.col("cell"))
    b = spark.range(MESH.ncells).select(F.col("id").alias("cell"), F.lit(3.0).alias("value"))
    return cellwise.element_wise(lambda x, y: x * y, a, b)


@query("SELECT CAST(c AS BIGINT) AS cell, k AS row, r AS col, CAST(c * 10 + r * 3 + k AS DOUBLE) AS value FROM range(720) t(c), range(2) s(r), range(3) u(k)")
def c17_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cellwise.fill(spark, MESH, 2, 3).withColumn("value", (F.col("cell") * 10 + F.col("row") * 3 + F.col("col")).cast("double"))
    return cellwise.transpose(m)


@query(EV + "SELECT id, P_0 + 0.125::DOUBLE * V_0 AS P_0, P_1 + 0.125::DOUBLE * V_1 AS P_1 FROM ev")
def c18_advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return g.update({f"P_{d}": F.col(f"P_{d}") + F.lit(0.125) * F.col(f"V_{d}") for d in range(2)}).df.select("id", "P_0", "P_1")


# --- D: selections

@query(EV + "SELECT id, W_0 FROM ev WHERE Q_0 > 30 AND SPECIES_0 <> 1")
def d1_sub_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).sub(F.col("Q_0") > 30).sub(F.col("SPECIES_0") != 1).rows().select("id", "W_0")


@query(EV + "SELECT count(*) AS n FROM ev")
def d2_whole_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).sub().rows().agg(F.count("*").alias("n"))


@query(EV + "SELECT id FROM ev WHERE SPECIES_0 = 2")
def d3_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).sub(F.col("SPECIES_0") == 2).sub().rows().select("id")


@query(EV + "SELECT id, cell FROM ev WHERE cell = 50 OR (cell >= 200 AND cell < 250)")
def d4_cell_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = events(spark, sf_dir).sub()
    return disjoint_union([view.cells(50), view.cells(200, 250)]).rows().select("id", "cell")


@query(EV + "SELECT id, W_0 + 5 AS W_0 FROM ev WHERE W_0 > 3000")
def d5_static_sub_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps its rows when columns change."""
    scratch(spark)
    g = events(spark, sf_dir)
    held = g.sub(F.col("W_0") > 3000).static()
    return held.rows(g.update({"W_0": F.col("W_0") + 5})).select("id", "W_0")


@query(EV + "SELECT id, W_0 + 5 AS W_0 FROM ev WHERE W_0 + 5 > 3000")
def d6_lazy_sub_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows its parent when columns change."""
    g = events(spark, sf_dir)
    return g.sub(F.col("W_0") > 3000).rows(g.update({"W_0": F.col("W_0") + 5})).select("id", "W_0")


@query(EV + "SELECT SPECIES_0 AS part, count(*) AS n, CAST(sum(W_0) AS BIGINT) AS w FROM ev WHERE SPECIES_0 < 3 GROUP BY SPECIES_0")
def d8_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views by species (others are in none), counted in one pass over their union."""
    views = events(spark, sf_dir).sub().partition("SPECIES", 3)
    return disjoint_union(views).rows().groupBy(F.col("SPECIES_0").alias("part")).agg(F.count("*").alias("n"), F.sum("W_0").alias("w"))


@query(EV + "SELECT cell, layer FROM lay WHERE SPECIES_0 = 0")
def d9_cells_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_layers(events(spark, sf_dir).df).where("SPECIES_0 = 0").select("cell", "layer")


@query(EV + "SELECT id FROM ev WHERE USER_0 <> 3")
def d10_remover_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).df.where(F.col("USER_0") != 3).select("id")


# --- G: layers and order

@query(EV + "SELECT id, cell, layer FROM lay")
def g1_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_layers(events(spark, sf_dir).df).select("id", "cell", "layer")


@query(EV + ", s AS (SELECT cell, sum(count(*)) OVER (ORDER BY cell) - count(*) AS start FROM ev GROUP BY cell) SELECT id, layer, CAST(start + layer AS BIGINT) AS loop_index FROM lay JOIN s USING (cell)")
def g2_loop_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cellwise.loop_indices(events(spark, sf_dir).df).select("id", "layer", "loop_index")


@query(EV + "SELECT id, cell FROM lay WHERE layer < 2")
def g3_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).sub().truncate(2).rows().select("id", "cell")


@query(EV + "SELECT id, cell FROM lay WHERE layer >= 2")
def g4_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).sub().discard(2).rows().select("id", "cell")


@query(EV + "SELECT id, row_number() OVER (ORDER BY id) - 1 + 100 AS ordinal FROM ev WHERE SPECIES_0 = 1")
def g5_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch-and-add of 1 as a total order of the rows that take part, from 100 on."""
    rows = events(spark, sf_dir).df.where("SPECIES_0 = 1").withColumn("one", F.lit(1))
    return cellwise.exclusive_scan(rows, "id", "one", "k").select("id", (F.col("k") + 100).alias("ordinal"))


@query("SELECT v AS k, list_extract(list_sort([(v * 7) % 8, (v * 5 + 3) % 8, v % 3]), 1) AS low, list_extract(list_sort([(v * 7) % 8, (v * 5 + 3) % 8, v % 3]), 3) AS high FROM range(64) t(v)")
def g6_small_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    s = F.array_sort(F.array((k * 7) % 8, (k * 5 + 3) % 8, k % 3))
    return spark.range(64).select(k.alias("k"), F.element_at(s, 1).alias("low"), F.element_at(s, 3).alias("high"))


# --- H: sets

@query(EV + "SELECT id FROM ev WHERE SPECIES_0 = 0 UNION ALL SELECT id FROM lay WHERE SPECIES_0 = 2")
def h1_disjoint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return disjoint_union([g.sub(F.col("SPECIES_0") == 0), g.sub(F.col("SPECIES_0") == 2)], check=True).rows().select("id")


@query(EV + "SELECT DISTINCT USER_0 AS value FROM ev WHERE USER_0 NOT IN (SELECT USER_0 FROM ev WHERE id % 50 = 0)")
def h2_unseen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch(spark)
    rows, extractor = events(spark, sf_dir).df, products.Unseen()
    extractor.extract(rows.where("id % 50 = 0"), "USER_0")
    return extractor.extract(rows, "USER_0")


@query(EV + "SELECT USER_0 FROM ev WHERE SPECIES_0 = 0 INTERSECT SELECT USER_0 FROM ev WHERE SPECIES_0 = 1 EXCEPT SELECT USER_0 FROM ev WHERE SPECIES_0 = 2 AND id % 7 = 0")
def h3_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lambda k: events(spark, sf_dir).df.where(F.col("SPECIES_0") == k)
    return u(0).select("USER_0").intersect(u(1).select("USER_0")).subtract(u(2).where("id % 7 = 0").select("USER_0"))


@query(EV + "SELECT cell, CAST(max(SPECIES_0) AS BIGINT) AS value FROM ev GROUP BY cell")
def h4_flatten_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a map column as rows."""
    m = events(spark, sf_dir).df.groupBy("cell").agg(F.create_map(F.lit("last"), F.max("SPECIES_0")).alias("m"))
    return m.select("cell", F.explode(F.map_values("m")).alias("value"))


# --- L: row mutation

@query(EV + "SELECT id FROM lay WHERE NOT (layer = 0 AND cell % 2 = 0)")
def l1_remove_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.range(0, MESH.ncells, 2).select(F.col("id").alias("cell"), F.lit(0).alias("layer"))
    return events(spark, sf_dir).remove_at(requests).df.select("id")


@query(EV + "SELECT id FROM ev WHERE NOT (Q_0 > 30 AND SPECIES_0 = 1)")
def l2_remove_sub_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    return g.remove(g.sub(F.col("Q_0") > 30).sub(F.col("SPECIES_0") == 1)).df.select("id")


@query(EV + "SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY id) - 1 AS layer FROM ev WHERE id % 4 <> 0")
def l3_dense_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers stay dense after a removal."""
    g = events(spark, sf_dir)
    return with_layers(g.remove(g.sub(F.col("id") % 4 == 0)).df).select("id", "cell", "layer")


@query(EV + "SELECT id FROM ev WHERE SPECIES_0 <> 2")
def l4_remove_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).remove_key("SPECIES", 2).df.select("id")


@query(EV + "SELECT id * 3 + k AS id, cell, id AS parent, k AS product, W_0 + k AS W_0, USER_0 FROM ev, range(3) t(k) WHERE (id + k) % 2 = 0")
def l5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec((SPEC.get("W"), SPEC.get("USER")))
    made = products.descendants(events(spark, sf_dir).df, 3, {"W_0": [F.col("W_0") + k for k in range(3)]}, [(F.col("id") + k) % 2 == 0 for k in range(3)], spec)
    return products.numbered(made, 3, 0).select("id", "cell", "parent", "product", "W_0", "USER_0")


@query(EV + "SELECT count(*) AS n, CAST(sum(W_0) AS BIGINT) AS w, CAST(sum(USER_0) AS BIGINT) AS u FROM (SELECT W_0, USER_0 FROM ev UNION ALL SELECT 7, 9 FROM ev)")
def l6_product_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of every event, appended with a default."""
    g = events(spark, sf_dir)
    rows = g.df.select((F.col("id") + 10**9).alias("id"), "cell", F.lit(7).alias("W_0"))
    return products.add_matrix(g, rows, Spec((SPEC.get("W"),)), {"USER_0": 9}).df.agg(F.count("*").alias("n"), F.sum("W_0").alias("w"), F.sum("USER_0").alias("u"))


@query(EV + "SELECT id, cell, CAST(5 AS BIGINT) AS SPECIES_0, W_0 FROM ev")
def l7_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec((SPEC.get("SPECIES"), SPEC.get("W")))
    return spec.align(event_rows(spark, sf_dir).withColumn("cell", MESH.cell([F.col("P_0"), F.col("P_1")])).drop("SPECIES_0"), {"SPECIES_0": 5}, ("id", "cell"))


# --- rows of the inventory that need more than one of the above

@query(EV + "SELECT id, cell, W_0 FROM ev WHERE cell >= 100 AND cell < 230")
def d4_cells_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell range of a stored group; other folders are pruned."""
    path = scratch(spark)
    tables.write(events(spark, sf_dir).df, path)
    return tables.read(spark, path, SPEC, (100, 230)).select("id", "cell", "W_0")


@query("SELECT * FROM (VALUES (true, true, false, false)) t(has_v, has_v2, has_v3, has_x)")
def b2_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of properties by name, and by name and components."""
    s = events(spark, sf_dir).spec
    return spark.createDataFrame([("V" in s, Prop("V", 2) in s, Prop("V", 3) in s, "X" in s)], "has_v boolean, has_v2 boolean, has_v3 boolean, has_x boolean")


@query(EV + "SELECT id, W_0 * 10 AS E_0 FROM ev WHERE SPECIES_0 = 3")
def b5_ephemeral_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that exist on a view alone."""
    return Ephemeral(events(spark, sf_dir).sub(F.col("SPECIES_0") == 3), {"E_0": F.col("W_0") * 10}).df.select("id", "E_0")


@query(EV + "SELECT cell, CAST(sum(SPECIES_0) AS BIGINT) AS s FROM ev GROUP BY cell")
def c5_declared_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop that reads one property: the scan holds the columns it and the cell are made from, no others."""
    return cellwise.accumulate(events(spark, sf_dir).df, ["cell"], {"s": ("plus", F.col("SPECIES_0"))})


@query(EV + ", m AS (SELECT cell, layer AS row, 0 AS col, W_0 AS value FROM lay) SELECT cell, row, col, CAST(CASE WHEN row = 1 THEN -5 ELSE value END AS BIGINT) AS value FROM m")
def c9_cell_rows_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-cell table with as many rows as the cell has, and a write to one of them."""
    m = with_layers(events(spark, sf_dir).df).select("cell", F.col("layer").alias("row"), F.lit(0).alias("col"), F.col("W_0").alias("value"))
    return cellwise.set_values(m, m.where("row = 1").withColumn("value", F.lit(-5).cast("bigint")))


@query(EV + "SELECT id, W_0 * W_0 + 2 * W_0 * SPECIES_0 AS v FROM ev")
def c11_scratch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate values of a kernel are columns that go again."""
    df = events(spark, sf_dir).df.withColumns({"t_0": F.col("W_0") * F.col("W_0"), "t_1": 2 * F.col("W_0") * F.col("SPECIES_0")})
    return df.select("id", (F.col("t_0") + F.col("t_1")).alias("v"))


def _direct(df: DataFrame) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.add(b.column(1), 1)], ["id", "v"])

    return df.select("id", "W_0").mapInArrow(run, "id long, v long")


@query(EV + "SELECT id, W_0 + 1 AS v FROM ev")
def c13_direct_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The escape hatch: Arrow batches of chosen columns in a Python function."""
    return _direct(events(spark, sf_dir).df)


@query(EV + "SELECT id, CAST(sum(1) OVER (PARTITION BY cell ORDER BY id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS layer FROM ev WHERE Q_0 > 30")
def d7_scan_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a selection by a scan of ones within its cells."""
    rows = events(spark, sf_dir).sub(F.col("Q_0") > 30).rows().withColumn("one", F.lit(1))
    return cellwise.segmented_scan(rows, "cell", "id", "one", name="layer").select("id", "layer")


@query(EV + "SELECT id, P_0 + 0 AS P_0, P_1 + 0 AS P_1, cell FROM ev")
def i17_parallel_initialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty small moves of every row from the domain's centre to its target, with the drift tested at the end."""
    g = events(spark, sf_dir)
    there = mapping.straight_steps(g.df, [F.lit(e / 2) for e in MESH.extents], ["P_0", "P_1"], 20)
    return there.select("id", "P_0", "P_1", MESH.cell([F.col("P_0"), F.col("P_1")]).alias("cell"))


@query(OR + ", b AS (SELECT cell, count(*) AS n FROM ord GROUP BY cell) SELECT CAST(c AS BIGINT) AS mesh_cell, 1.0::DOUBLE AS volume, CAST(4 - CASE WHEN c % 32 IN (0, 31) THEN 1 ELSE 0 END - CASE WHEN c // 32 IN (0, 15) THEN 1 ELSE 0 END AS BIGINT) AS neighbours, coalesce(n, 0) AS rows FROM range(512) t(c) LEFT JOIN b ON b.cell = c")
def i20_mesh_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and sides of a mesh of 32 x 16 polygons: volumes, cells beyond a side, and rows inside."""
    mesh = PolygonMesh.grid(spark, 32, 16, 1.0, CartesianMesh((32, 16)))
    sides = mesh.edges().select("mesh_cell", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    shared = sides.join(sides.withColumnRenamed("mesh_cell", "other"), ["lo", "hi"]).groupBy("mesh_cell").agg(F.count_if(F.col("other") != F.col("mesh_cell")).alias("neighbours"))
    inside = mesh.locate(orders(spark, sf_dir), [F.col("P_0"), F.col("P_1")], ["id"]).groupBy("mesh_cell").agg(F.count("*").alias("rows"))
    return mesh.volumes().join(shared, "mesh_cell").join(inside, "mesh_cell", "left").select("mesh_cell", "volume", "neighbours", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(EV + "SELECT SPECIES_0, CAST(sum(W_0) AS BIGINT) AS s, min(W_0) AS lo, max(W_0) AS hi FROM ev GROUP BY SPECIES_0")
def j9_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch-and-add, -min and -max as aggregates."""
    return cellwise.accumulate(events(spark, sf_dir).df, ["SPECIES_0"], {n: (op, F.col("W_0")) for n, op in (("s", "plus"), ("lo", "min"), ("hi", "max"))})


__all__ = ["scratch", "cell_range", "orders", "table"]
