"""Small exports for viewing: cell outlines, text dumps, gmsh meshes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import CartesianMesh


def cell_outlines(spark: SparkSession, mesh: CartesianMesh) -> DataFrame:
    """(cell, corner, x_0..): the corners of every fine cell, for unstructured-grid writers."""
    df = mesh.cells(spark)
    corners = list(product(*([(0, 1)] * mesh.ndim)))
    rows = F.array(*(F.struct(F.lit(k).alias("corner"), *((F.col(f"x_{d}") + F.lit(o[d] * mesh.fine_width)).alias(f"p_{d}") for d in range(mesh.ndim))) for k, o in enumerate(corners)))
    return df.select("cell", F.inline(rows)).select("cell", "corner", *(F.col(f"p_{d}").alias(f"x_{d}") for d in range(mesh.ndim)))


def write_unstructured(df: DataFrame, path: str) -> None:
    """One JSON row a cell: its points in corner order and any data columns (must be constant in a cell)."""
    data = [c for c in df.columns if c not in ("cell", "corner") and not c.startswith("x_")]
    dims = sorted(c for c in df.columns if c.startswith("x_"))
    points = F.array_sort(F.collect_list(F.struct("corner", F.array(*dims).alias("p"))))
    df.groupBy("cell").agg(F.transform(points, lambda c: c["p"]).alias("points"), *(F.first(c).alias(c) for c in data)).write.mode("overwrite").json(path)


def dump(df: DataFrame, columns: list[str], cells: tuple[int, int] | None = None) -> DataFrame:
    """(cell, layer, line): a text line per row, in order of cell and layer."""
    from ..group import with_layers

    rows = df if cells is None else df.where(F.col("cell").between(cells[0], cells[1] - 1))
    return with_layers(rows).select("cell", "layer", F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("line")).orderBy("cell", "layer")


#: Bytes of a mesh file that the driver parses at most.
MESH_BYTES = 256 << 20


def read_gmsh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, x, y, z), elements (element, kind, tag, nodes)) of a gmsh 4.1 ASCII file of at most MESH_BYTES, parsed on the driver."""
    size = spark.read.format("binaryFile").load(path).select(F.max("length")).first()[0] or 0
    if size > MESH_BYTES:
        raise ValueError(f"{path} has {size} bytes; store meshes above {MESH_BYTES} as tables of nodes and elements")
    text = spark.read.text(path, wholetext=True).first()[0].splitlines()
    at = {line: k for k, line in enumerate(text) if line.startswith("$")}
    nodes, elements = [], []
    k = at["$Nodes"] + 2
    while k < at["$EndNodes"]:
        n = int(text[k].split()[3])
        for m in range(n):
            nodes.append((int(text[k + 1 + m]), *map(float, text[k + 1 + n + m].split()[:3])))
        k += 1 + 2 * n
    k = at["$Elements"] + 2
    while k < at["$EndElements"]:
        _, tag, kind, n = map(int, text[k].split())
        for m in range(n):
            first, *rest = map(int, text[k + 1 + m].split())
            elements.append((first, kind, tag, rest))
        k += 1 + n
    return spark.createDataFrame(nodes, "node long, x double, y double, z double"), spark.createDataFrame(elements, "element long, kind int, tag int, nodes array<long>")
