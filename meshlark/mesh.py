"""Meshes as integer Columns: Cartesian cells, the two-level hierarchy, faces, neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative tolerance at the upper edge of the hierarchy, and the mark of a failed mapping (fixed values).
EDGE_TOLERANCE, OUTSIDE = 1e-10, -2


def truncated(x: Column) -> Column:
    """Towards zero, as an integer."""
    return x.cast("bigint")


def linear(tuple_: list[Column], dims: list[int]) -> Column:
    """Index of a cell tuple, dimension 0 fastest."""
    out, stride = F.lit(0).cast("bigint"), 1
    for t, n in zip(tuple_, dims):
        out, stride = out + t * F.lit(stride), stride * n
    return out


def unlinear(index: Column, dims: list[int]) -> list[Column]:
    """The tuple of a linear index, dimension 0 fastest."""
    out, stride = [], 1
    for n in dims:
        out.append(F.floor(index / F.lit(stride)).cast("bigint") % F.lit(n))
        stride *= n
    return out


@dataclass(frozen=True)
class CartesianMesh:
    """Square coarse cells of one width per dimension, each split 2**order times a dimension."""

    dims: tuple[int, ...]
    width: float = 1.0
    order: int = 0

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def split(self) -> int:
        return 1 << self.order

    @property
    def fine_dims(self) -> list[int]:
        return [n * self.split for n in self.dims]

    @property
    def fine_width(self) -> float:
        return self.width / self.split

    @property
    def ncells(self) -> int:
        out = 1
        for n in self.fine_dims:
            out *= n
        return out

    @property
    def extents(self) -> list[float]:
        return [n * self.width for n in self.dims]

    # --- binning
    def cell_tuple(self, position: list[Column]) -> list[Column]:
        """Fine cell of a position; outside positions go to the nearest edge cell."""
        inverse = 1.0 / self.fine_width
        return [F.least(F.greatest(truncated(p * F.lit(inverse)), F.lit(0)), F.lit(n - 1)) for p, n in zip(position, self.fine_dims)]

    def cell(self, position: list[Column]) -> Column:
        return linear(self.cell_tuple(position), self.fine_dims)

    def hierarchy_tuple(self, position: list[Column]) -> list[Column]:
        """(coarse..., fine...): OUTSIDE where a position lies beyond the upper edge by more than the tolerance."""
        coarse, fine = [], []
        for p, n in zip(position, self.dims):
            extent = n * self.width
            c = truncated(p * F.lit(1.0 / self.width))
            near = F.abs(p - F.lit(extent)) <= F.lit(EDGE_TOLERANCE) * F.abs(p)
            used = F.when(c < n, c).when(near, F.lit(n - 1)).otherwise(F.lit(0))
            coarse.append(F.when((c < n) | near, used).otherwise(F.lit(OUTSIDE)).cast("bigint"))
            rest = p - used * F.lit(self.width)
            f = truncated(rest * F.lit(1.0 / self.fine_width))
            close = F.abs(rest - F.lit(self.width)) <= F.lit(EDGE_TOLERANCE) * F.abs(rest)
            fine.append(F.when(f < self.split, f).when(close, F.lit(self.split - 1)).otherwise(F.lit(OUTSIDE)).cast("bigint"))
        return coarse + fine

    def hierarchy_index(self, tuple_: list[Column]) -> Column:
        """Global hierarchy index: coarse index times fine cells of a coarse cell, plus fine index."""
        coarse, fine = tuple_[: self.ndim], tuple_[self.ndim :]
        return linear(coarse, list(self.dims)) * F.lit(self.split**self.ndim) + linear(fine, [self.split] * self.ndim)

    def hierarchy_untuple(self, index: Column) -> list[Column]:
        per = self.split**self.ndim
        return unlinear(F.floor(index / F.lit(per)).cast("bigint"), list(self.dims)) + unlinear(index % F.lit(per), [self.split] * self.ndim)

    def cart_of(self, tuple_: list[Column]) -> list[Column]:
        """Fine Cartesian tuple of a hierarchy tuple."""
        return [c * F.lit(self.split) + f for c, f in zip(tuple_[: self.ndim], tuple_[self.ndim :])]

    def untruncated_tuple(self, position: list[Column], origin: float = 0.0) -> list[Column]:
        """Fine cells without bounds; below the origin cells count down from -1."""
        out = []
        for p in position:
            steps = F.abs(p - F.lit(origin)) * F.lit(1.0 / self.fine_width)
            out.append(F.when(p < origin, -(truncated(steps) + 1)).otherwise(truncated(steps)))
        return out

    def periodic(self, position: list[Column], mask: list[bool] | None = None) -> list[Column]:
        """Positions wrapped into the domain, per (masked) dimension; the origin is zero."""
        out = []
        for k, (p, e) in enumerate(zip(position, self.extents)):
            times = F.abs((p * F.lit(1.0 / e)).cast("int")) + F.lit(2)
            out.append((p + times * F.lit(e)) % F.lit(e) if mask is None or mask[k] else p)
        return out

    # --- tables
    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, c_0.., low corner x_0.., volume) of every fine cell."""
        df = spark.range(self.ncells).select(F.col("id").alias("cell"))
        parts = unlinear(F.col("cell"), self.fine_dims)
        df = df.select("cell", *(t.alias(f"c_{k}") for k, t in enumerate(parts)))
        return df.select("*", *((F.col(f"c_{k}") * F.lit(self.fine_width)).alias(f"x_{k}") for k in range(self.ndim)), F.lit(self.fine_width**self.ndim).alias("volume"))

    def neighbours(self, df: DataFrame, offset: int = 1, periodic: bool = True, keep: tuple[str, ...] = ("cell",)) -> DataFrame:
        """(keep..., neighbour) for each row's cell: all cells within the offset, wrapped or cut off at the edge."""
        parts = unlinear(F.col("cell"), self.fine_dims)
        out = df.select(*keep, *(t.alias(f"t_{k}") for k, t in enumerate(parts)))
        for k, n in enumerate(self.fine_dims):
            out = out.withColumn(f"o_{k}", F.explode(F.sequence(F.lit(-offset), F.lit(offset))))
            moved = F.col(f"t_{k}") + F.col(f"o_{k}")
            out = out.withColumn(f"t_{k}", F.pmod(moved, F.lit(n)).cast("bigint")) if periodic else out.withColumn(f"t_{k}", moved).where(F.col(f"t_{k}").between(0, n - 1))
        return out.select(*keep, linear([F.col(f"t_{k}") for k in range(self.ndim)], self.fine_dims).alias("neighbour")).distinct()

    # --- faces: 2-D 0 south, 1 east, 2 north, 3 west; 3-D adds 4 bottom and 5 top
    def face_axes(self, facet: int) -> list[int]:
        """The dimensions that span a facet."""
        normal = {0: 1, 2: 1, 1: 0, 3: 0, 4: 2, 5: 2}[facet]
        return [d for d in range(self.ndim) if d != normal]

    def face_counts(self) -> list[int]:
        out = []
        for facet in range(2 * self.ndim):
            n = 1
            for d in self.face_axes(facet):
                n *= self.fine_dims[d]
            out.append(n)
        return out

    def face_offsets(self) -> list[int]:
        out, total = [], 0
        for n in self.face_counts():
            out.append(total)
            total += n
        return out

    def face_index(self, facet: Column, tuple_: list[Column]) -> Column:
        """Linear id of the boundary face of a facet that belongs to a fine cell tuple."""
        out = F.lit(None).cast("bigint")
        for f, base in enumerate(self.face_offsets()):
            axes = self.face_axes(f)
            out = F.when(facet == f, F.lit(base) + linear([tuple_[d] for d in axes], [self.fine_dims[d] for d in axes])).otherwise(out)
        return out

    def faces(self, spark: SparkSession) -> DataFrame:
        """(face, facet, owner cell) of every boundary face."""
        counts, offsets = self.face_counts(), self.face_offsets()
        df = spark.range(sum(counts)).select(F.col("id").alias("face"))
        facet = F.lit(0)
        for f, base in enumerate(offsets):
            facet = F.when(F.col("face") >= base, F.lit(f)).otherwise(facet)
        df = df.withColumn("facet", facet)
        owner = F.lit(None).cast("bigint")
        for f, base in enumerate(offsets):
            axes = self.face_axes(f)
            inside = unlinear(F.col("face") - F.lit(base), [self.fine_dims[d] for d in axes])
            normal = next(d for d in range(self.ndim) if d not in axes)
            edge = self.fine_dims[normal] - 1 if f in (1, 2, 5) else 0
            at = [inside[axes.index(d)] if d in axes else F.lit(edge) for d in range(self.ndim)]
            owner = F.when(F.col("facet") == f, linear(at, self.fine_dims)).otherwise(owner)
        return df.withColumn("cell", owner)
