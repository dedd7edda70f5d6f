"""Particle groups and lazily re-evaluated sub groups.

A group is an immutable description: a DataFrame with a unique `id`, the partition key `cell`
and the flat columns of its spec. Every change returns a new group with a higher version. A
sub group stores its predicate, not its rows, so it follows its parent; a static sub group
keeps the rows it first had, and refuses to serve a parent whose structure has changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mesh import CartesianMesh
from .operators.scan import grouped_scan
from .spec import Prop, Spec

BASE = ("id", "cell")


def with_layers(df: DataFrame, name: str = "layer") -> DataFrame:
    """Adds the dense row number within the cell, in order of id; large cells are numbered in blocks."""
    return grouped_scan(df, ["cell"], "id", None, name).select(*df.columns, name)


@dataclass(frozen=True)
class Group:
    """A particle table on a mesh."""

    df: DataFrame
    spec: Spec
    mesh: CartesianMesh
    structure: int = 0
    data: int = 0

    @staticmethod
    def of(df: DataFrame, spec: Spec, mesh: CartesianMesh, check_cells: bool = True) -> "Group":
        """A group of rows that have id, cell and any of the spec's columns; others are left out."""
        out = spec.align(df, keep=BASE)
        if check_cells:
            bad = F.raise_error(F.concat(F.lit("cell out of range: "), F.col("cell").cast("string")))
            out = out.withColumn("cell", F.when(F.col("cell").between(0, mesh.ncells - 1), F.col("cell")).otherwise(bad))
        return Group(out, spec, mesh)

    @property
    def positions(self) -> list[Column]:
        return [F.col(c) for c in self.spec.positions.columns]

    def _with(self, df: DataFrame, structural: bool = True, spec: Spec | None = None) -> "Group":
        return replace(self, df=df, spec=spec or self.spec, structure=self.structure + structural, data=self.data + 1)

    # --- rows
    def add(self, rows: DataFrame) -> "Group":
        """Appends a batch: id and cell are needed, absent properties are zero, others are ignored."""
        return self._with(self.df.unionByName(Group.of(rows, self.spec, self.mesh).df))

    def add_group(self, other: "Group") -> "Group":
        """Appends another group's rows (or a sub group's) cell by cell."""
        if isinstance(other, SubGroup):
            rows, mesh = other.rows(), other.parent_group.mesh
            if other.whole and other.parent_group is self:
                raise ValueError("a group cannot be added to itself")
        else:
            rows, mesh = other.df, other.mesh
        if other is self:
            raise ValueError("a group cannot be added to itself")
        if mesh.ncells != self.mesh.ncells:
            raise ValueError("the meshes differ in their number of cells")
        return self._with(self.df.unionByName(self.spec.align(rows, keep=BASE)))

    def clear(self) -> "Group":
        return self._with(self.df.limit(0))

    def remove(self, which: "SubGroup") -> "Group":
        """Removes the rows of one of this group's sub groups."""
        if which.parent_group is not self and which.parent_group.df is not self.df:
            raise ValueError("the sub group belongs to another group")
        keep = which.complement()
        return self._with(self.df.where(keep)) if keep is not None else self._with(self.df.join(which.rows().select("id"), "id", "left_anti"))

    def remove_at(self, requests: DataFrame) -> "Group":
        """Removes rows by (cell, layer)."""
        rows = with_layers(self.df)
        return self._with(rows.join(requests.select("cell", "layer").distinct(), ["cell", "layer"], "left_anti").drop("layer"))

    def remove_key(self, name: str, key: int | float) -> "Group":
        """Removes the rows whose first component of a property equals the key."""
        return self._with(self.df.where(F.col(f"{name}_0") != F.lit(key)))

    def get(self, requests: DataFrame) -> DataFrame:
        """The rows at (ordinal, cell, layer) of the requests; an absent place raises an error."""
        found = requests.join(with_layers(self.df), ["cell", "layer"], "left")
        bad = F.raise_error(F.concat(F.lit("no row at cell "), F.col("cell").cast("string"), F.lit(", layer "), F.col("layer").cast("string")))
        return found.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(bad))

    def cell_rows(self, cell: int, name: str) -> DataFrame:
        """One property of one cell, a row per layer."""
        return with_layers(self.df.where(F.col("cell") == cell)).select("layer", *self.spec.get(name).columns)

    # --- properties
    def add_prop(self, prop: Prop) -> "Group":
        return self._with(self.df.withColumns({c: F.lit(0).cast(prop.kind) for c in prop.columns}), False, self.spec.push(prop))

    def remove_prop(self, name: str) -> "Group":
        p = self.spec.get(name)
        if p.positions or p.cells:
            raise ValueError(f"{name} cannot be removed")
        return self._with(self.df.drop(*p.columns), False, self.spec.remove(name))

    def update(self, values: dict[str, Column], cells: tuple[int, ...] | None = None, where: Column | None = None) -> "Group":
        """The row-wise update (a particle loop): new values of components, from the old ones.

        cells: none for all, (i,) for one, (i, j) for [i, j). where: only these rows change.
        """
        unknown = set(values) - set(self.spec.columns)
        if unknown:
            raise KeyError(f"not in the spec: {sorted(unknown)}")
        on = where
        if cells is not None:
            span = cell_range(*cells)
            on = span if on is None else on & span
        return self._with(self.df.withColumns({c: v if on is None else F.when(on, v).otherwise(F.col(c)) for c, v in values.items()}), False)

    def move_cells(self) -> "Group":
        """Recomputes every row's cell from its position."""
        return self._with(self.df.withColumn("cell", self.mesh.cell(self.positions)))

    def dealt(self, partitions: int) -> "Group":
        """The same rows, physically hash-partitioned by cell, for several cell-wise operators in a row."""
        return replace(self, df=self.df.repartition(partitions, "cell"))

    def sub(self, predicate: Column | None = None) -> "SubGroup":
        return SubGroup(self, predicate)


def cell_range(start: int | None = None, end: int | None = None) -> Column:
    """all, one cell, or [start, end); an end alone is an error."""
    if start is None:
        if end is not None:
            raise ValueError("an end without a start")
        return F.lit(True)
    return F.col("cell") == start if end is None else (F.col("cell") >= start) & (F.col("cell") < end)


class SubGroup:
    """A view of a group: a predicate, or a transform of the parent's rows (first layers and the like)."""

    def __init__(self, parent: "Group | SubGroup", predicate: Column | None = None, transform: Callable[[DataFrame], DataFrame] | None = None):
        self.parent, self.predicate, self.transform, self._held, self._token = parent, predicate, transform, None, None

    @property
    def parent_group(self) -> Group:
        return self.parent if isinstance(self.parent, Group) else self.parent.parent_group

    @property
    def whole(self) -> bool:
        return self.predicate is None and self.transform is None and (isinstance(self.parent, Group) or self.parent.whole)

    def static(self) -> "SubGroup":
        """Keeps the ids that are selected now, in a reliable checkpoint."""
        out = SubGroup(self.parent, self.predicate, self.transform)
        out._held, out._token = self.rows().select("id").checkpoint(), self.parent_group.structure
        return out

    def valid(self, group: Group | None = None) -> bool:
        return self._held is None or (group or self.parent_group).structure == self._token

    def rows(self, group: Group | None = None) -> DataFrame:
        """The selected rows of the parent (or of a later version of it)."""
        if self._held is not None:
            if not self.valid(group):
                raise RuntimeError("a static sub group was used after a structural change")
            return (group or self.parent_group).df.join(self._held, "id", "left_semi")
        df = (group or self.parent).df if isinstance(self.parent, Group) else self.parent.rows(group)
        if self.predicate is not None:
            df = df.where(self.predicate)
        return self.transform(df) if self.transform else df

    def complement(self) -> Column | None:
        """A predicate for the rows that are not selected, if predicates alone define the view."""
        if self.transform is not None or self._held is not None:
            return None
        own = self.predicate if self.predicate is not None else F.lit(True)
        if isinstance(self.parent, Group):
            return ~F.coalesce(own, F.lit(False))
        above = self.parent.complement()
        return None if above is None else above | ~F.coalesce(own, F.lit(False))

    def sub(self, predicate: Column | None = None) -> "SubGroup":
        return SubGroup(self, predicate)

    def cells(self, start: int, end: int | None = None) -> "SubGroup":
        n = self.parent_group.mesh.ncells
        return SubGroup(self) if (start, end) == (0, n) else SubGroup(self, cell_range(start, end))

    def truncate(self, n: int) -> "SubGroup":
        """The first n layers of each cell."""
        # a plain row number lets the planner cut each cell to n rows before the shuffle
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("id"))
        return SubGroup(self, None, lambda df: df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank"))

    def discard(self, n: int) -> "SubGroup":
        """All but the first n layers of each cell."""
        return SubGroup(self, None, lambda df: with_layers(df, "__layer").where(F.col("__layer") >= n).drop("__layer"))

    def partition(self, name: str, n: int) -> list["SubGroup"]:
        """n views by the first component of an integer property; other values are in none."""
        return [SubGroup(self, F.col(f"{name}_0") == k) for k in range(n)]

    def update(self, values: dict[str, Column]) -> Group:
        """Updates the selected rows of the parent group; all others stay as they are."""
        group, keep = self.parent_group, self.complement()
        if keep is not None:
            return group.update(values, where=~keep)
        mine = self.rows().select("id").withColumn("__mine", F.lit(True))
        df = group.df.join(mine, "id", "left")
        df = df.withColumns({c: F.when(F.col("__mine"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("__mine")
        return group._with(df, False)


def disjoint_union(views: list[SubGroup], check: bool = False) -> SubGroup:
    """UNION ALL of views of one group; with check, an id that occurs twice raises an error."""
    if not views:
        raise ValueError("at least one view is needed")
    group = views[0].parent_group
    if any(v.parent_group is not group for v in views):
        raise ValueError("the views belong to different groups")
    if len(views) == 1:
        return views[0]
    if any(v.whole for v in views):
        raise ValueError("a whole group cannot be part of a union")

    def together(_: DataFrame) -> DataFrame:
        df = reduce(DataFrame.unionByName, [v.rows() for v in views])
        if check:
            n = F.count("*").over(Window.partitionBy("id"))
            df = df.withColumn("id", F.when(n == 1, F.col("id")).otherwise(F.raise_error(F.lit("the views overlap"))))
        return df

    return SubGroup(group, None, together)


class Ephemeral:
    """Extra columns of a view that vanish when the view is built again."""

    def __init__(self, view: SubGroup, values: dict[str, Column]):
        self.view, self.names, self.df = view, list(values), view.rows().withColumns(values)

    def to_group(self, names: dict[str, str]) -> Group:
        """Copies ephemeral columns (keys) into the group's components (values) for the view's rows."""
        group = self.view.parent_group
        part = self.df.select("id", *(F.col(k).alias(f"__{v}") for k, v in names.items()), F.lit(True).alias("__mine"))
        df = group.df.join(part, "id", "left").withColumns({v: F.when(F.col("__mine"), F.col(f"__{v}")).otherwise(F.col(v)) for v in names.values()})
        return group._with(df.select(*group.df.columns), False)
