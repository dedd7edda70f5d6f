"""Particle analytics on Spark: typed particle tables binned onto meshes."""

from .group import Ephemeral, Group, SubGroup, cell_range, disjoint_union, with_layers
from .mesh import CartesianMesh
from .polygons import PolygonMesh
from .spec import INT, REAL, Prop, Spec

__all__ = ["INT", "REAL", "CartesianMesh", "Ephemeral", "Group", "PolygonMesh", "Prop", "Spec", "SubGroup", "cell_range", "disjoint_union", "with_layers"]
