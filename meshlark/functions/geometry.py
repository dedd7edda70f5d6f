"""Intersections and coordinate maps as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import rsqrt


def ordered_by_x(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether end a comes first: by x, then by y."""
    return F.when(ax == bx, ay < by).otherwise(ax < bx)


def segments_meet(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column, qx: Column, qy: Column, tol: float = 0.0) -> Column:
    """struct(hit, x, y, along): where segment a-b meets p-q, and the share of a-b up to there.

    The share may leave [0, 1] and the point the box of p-q by the tolerance; parallel
    segments do not meet (x, y and along are null).
    """
    ux, uy, vx, vy = bx - ax, by - ay, qx - px, qy - py
    turn = ux * vy - uy * vx
    along = F.try_divide((px - ax) * vy - (py - ay) * vx, turn)
    x, y, t = ax + along * ux, ay + along * uy, F.lit(tol)
    inside = along.between(-t, F.lit(1.0) + t) & x.between(F.least(px, qx) - t, F.greatest(px, qx) + t) & y.between(F.least(py, qy) - t, F.greatest(py, qy) + t)
    return F.struct(F.coalesce(inside, F.lit(False)).alias("hit"), x.alias("x"), y.alias("y"), along.alias("along"))


def crosses_level(a: Column, b: Column, level: Column) -> tuple[Column, Column]:
    """Whether a step from a to b touches the level (not if it lies in it), and the share of the step there."""
    da, db = a - level, b - level
    span = F.abs(da) + F.abs(db)
    share = F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(da), span))
    return (da * db <= 0) & (span != 0), share


def _between(x: Column, lo: Column, hi: Column, tol: float) -> Column:
    return x.between(F.least(lo, hi) - F.lit(tol), F.greatest(lo, hi) + F.lit(tol))


def meets_aligned(start: list[Column], end: list[Column], axis: int, level: Column, low: list[Column], high: list[Column], tol: float = 0.0, step: list[Column] | None = None) -> Column:
    """struct(hit, x_0..): where a step meets an axis-aligned edge (2-D) or rectangle (3-D).

    axis is the normal's dimension; low and high bound the other dimensions, inclusively. A caller
    that knows the step passes it: end - start has the rounding of end, which moves points off a bound.
    """
    crossed, share = crosses_level(start[axis], end[axis], level)
    if step is None:
        step = [e - s for s, e in zip(start, end)]
    point = [level if d == axis else start[d] + share * step[d] for d in range(len(start))]
    hit = crossed
    for d in range(len(start)):
        if d != axis:
            hit = hit & _between(point[d], low[d], high[d], tol)
    return F.struct(hit.alias("hit"), *(p.alias(f"x_{d}") for d, p in enumerate(point)))


def triangle_weights(corners: list[tuple[Column, Column]], x: Column, y: Column) -> list[Column]:
    """Barycentric weights of a point: each corner's is the signed area opposite it over the whole; null for a flat triangle."""

    def area(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])

    whole, p = area(*corners), (x, y)
    return [F.try_divide(area(p, corners[(k + 1) % 3], corners[(k + 2) % 3]), whole) for k in range(3)]


def from_weights(corners: list[tuple[Column, Column]], weights: list[Column]) -> tuple[Column, Column]:
    """The point of barycentric weights."""
    x, y = F.lit(0.0), F.lit(0.0)
    for (cx, cy), w in zip(corners, weights):
        x, y = x + w * cx, y + w * cy
    return x, y


def quad_weights(e0: Column, e1: Column) -> list[Column]:
    """Bilinear weights of the four corners at collapsed coordinates, which are clamped to [-1, 1]."""
    s, t = ((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e)) + 1.0) * 0.5 for e in (e0, e1))
    return [(1.0 - s) * (1.0 - t), s * (1.0 - t), s * t, (1.0 - s) * t]


def quad_point(corners: list[tuple[Column, Column]], e0: Column, e1: Column) -> tuple[Column, Column]:
    """The point at collapsed coordinates, unclamped."""
    a, b = (1.0 - e0) * 0.5, (1.0 + e0) * 0.5
    c, d = (1.0 - e1) * 0.5, (1.0 + e1) * 0.5
    return from_weights(corners, [a * c, b * c, b * d, a * d])


def quad_collapsed(corners: list[tuple[Column, Column]], x: Column, y: Column) -> tuple[Column, Column]:
    """Collapsed coordinates of a point: the inverse of the bilinear map.

    With p = c0 + c1 e0 + c2 e1 + c3 e0 e1 (2-D vectors), eliminating e1 leaves a quadratic in
    e0. Its roots are taken in the form free of cancellation. The root inside the square is
    chosen, or the one nearer to it.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners

    def parts(a, b, c, d):
        return [0.25 * (a + b + c + d), 0.25 * (-a + b + c - d), 0.25 * (-a - b + c + d), 0.25 * (a - b + c - d)]

    cx, cy = parts(x0, x1, x2, x3), parts(y0, y1, y2, y3)
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    v = [(cx[k], cy[k]) for k in range(4)]
    r = (x - cx[0], y - cy[0])
    # r = c1 e0 + e1 (c2 + c3 e0), so r - c1 e0 is parallel to c2 + c3 e0
    qa, qb, qc = -cross(v[1], v[3]), cross(r, v[3]) - cross(v[1], v[2]), cross(r, v[2])
    root = F.sqrt(F.greatest(qb * qb - 4.0 * qa * qc, F.lit(0.0)))
    q = -0.5 * (qb + F.when(qb < 0, -root).otherwise(root))
    candidates = [F.try_divide(qc, q), F.try_divide(q, qa)]

    def other(e0):
        # the longer component of c2 + c3 e0 gives e1
        dx, dy = cx[2] + cx[3] * e0, cy[2] + cy[3] * e0
        return F.when(F.abs(dx) > F.abs(dy), F.try_divide(r[0] - cx[1] * e0, dx)).otherwise(F.try_divide(r[1] - cy[1] * e0, dy))

    pairs = [(e, other(e)) for e in candidates]
    far = [F.coalesce(F.greatest(F.abs(a), F.abs(b)), F.lit(float("inf"))) for a, b in pairs]
    first = (far[0] <= 1.0) | (far[0] <= far[1])
    return F.when(first, pairs[0][0]).otherwise(pairs[1][0]), F.when(first, pairs[0][1]).otherwise(pairs[1][1])


def quad_cartesian_weights(corners: list[tuple[Column, Column]], x: Column, y: Column) -> list[Column]:
    return quad_weights(*quad_collapsed(corners, x, y))


def to_torus(major: float, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(r, phi, theta) about the circle of the major radius."""
    plane = F.sqrt(x * x + y * y) - F.lit(major)
    return F.sqrt(plane * plane + z * z), F.atan2(y, x), F.atan2(z, plane)


def from_torus(major: float, r: Column, phi: Column, theta: Column) -> tuple[Column, Column, Column]:
    out = F.lit(major) + r * F.cos(theta)
    return out * F.cos(phi), out * F.sin(phi), r * F.sin(theta)


def unit(v: list[Column]) -> list[Column]:
    """v at length one."""
    n = F.lit(0.0)
    for c in v:
        n = n + c * c
    inv = rsqrt(n)
    return [c * inv for c in v]
