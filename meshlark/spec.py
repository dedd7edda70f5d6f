"""Particle specifications: named, typed, multi-component properties as flat columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REAL, INT = "double", "bigint"


@dataclass(frozen=True)
class Prop:
    """A property: name, components, and whether it holds reals or integers, positions or cells."""

    name: str
    ncomp: int = 1
    kind: str = REAL
    positions: bool = False
    cells: bool = False

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}_{k}" for k in range(self.ncomp)]

    def same(self, other: "Prop") -> bool:
        """Equal name, type and components; the role does not matter."""
        return (self.name, self.kind, self.ncomp) == (other.name, other.kind, other.ncomp)


@dataclass(frozen=True)
class Spec:
    """An ordered set of properties; a name may occur once over both types."""

    props: tuple[Prop, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [p.name for p in self.props]
        if len(set(names)) != len(names):
            raise ValueError("a property name occurs twice")

    def push(self, prop: Prop) -> "Spec":
        return Spec((*self.props, prop))

    def remove(self, name: str) -> "Spec":
        if name not in self:
            raise KeyError(name)
        return Spec(tuple(p for p in self.props if p.name != name))

    def get(self, name: str) -> Prop:
        return next(p for p in self.props if p.name == name)

    def __contains__(self, what: str | Prop) -> bool:
        if isinstance(what, Prop):
            return any(p.same(what) for p in self.props)
        return any(p.name == what for p in self.props)

    def covers(self, other: "Spec") -> bool:
        """Whether every property of other is in this one."""
        return all(p in self for p in other.props)

    @property
    def columns(self) -> list[str]:
        return [c for p in self.props for c in p.columns]

    @property
    def row_bytes(self) -> int:
        """Bytes of a row's properties."""
        return 8 * sum(p.ncomp for p in self.props)

    @property
    def positions(self) -> Prop:
        return next(p for p in self.props if p.positions)

    def struct(self) -> T.StructType:
        kinds = {REAL: T.DoubleType(), INT: T.LongType()}
        return T.StructType([T.StructField(c, kinds[p.kind]) for p in self.props for c in p.columns])

    def align(self, df: DataFrame, defaults: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """df with exactly this spec's columns: absent ones take their default or zero, others go.

        A property that df has with another number of components raises ValueError.
        """
        out: list[Column] = [F.col(k) for k in keep]
        for p in self.props:
            have = [c for c in df.columns if c.rsplit("_", 1)[0] == p.name and c.rsplit("_", 1)[-1].isdigit()]
            if have and len(have) != p.ncomp:
                raise ValueError(f"{p.name} has {len(have)} components, not {p.ncomp}")
            for c in p.columns:
                value = F.col(c) if have else F.lit((defaults or {}).get(c, 0))
                out.append(value.cast(p.kind).alias(c))
        return df.select(*out)
