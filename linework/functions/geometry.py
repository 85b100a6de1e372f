"""Scalar geometry as Column expressions; a segment is four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
Segment = tuple[Column, Column, Column, Column]


def segment(alias: str = "") -> Segment:
    dot = f"{alias}." if alias else ""
    return tuple(F.col(f"{dot}{c}") for c in ("x1", "y1", "x2", "y2"))


def slope(s: Segment) -> Column:
    """dy / dx; infinite for a vertical or zero-length segment."""
    x1, y1, x2, y2 = s
    return F.when(x1 == x2, F.lit(INF)).otherwise(F.try_divide((y2 - y1).cast("double"), (x2 - x1).cast("double")))


def intercept(s: Segment) -> Column:
    """y where x is 0; infinite for a vertical segment."""
    x1, y1, x2, _ = s
    return F.when(x1 == x2, F.lit(INF)).otherwise(y1 - slope(s) * x1)


def angle_between(a: Segment, b: Segment) -> Column:
    """Degrees between two segments' lines, 0 to 90; a vertical has a slope of 99999999999."""
    m1, m2 = (F.when(k == INF, F.lit(99999999999.0)).otherwise(k) for k in (slope(a), slope(b)))
    tangent = F.abs(F.try_divide(m1 - m2, 1 + m1 * m2))
    return F.when(m1 * m2 == -1, F.lit(90.0)).otherwise(F.degrees(F.atan(tangent)))


def boxes_overlap(a: Segment, b: Segment) -> Column:
    """Whether the closed bounding boxes meet."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    apart_x = (F.least(ax1, ax2) > F.greatest(bx1, bx2)) | (F.greatest(ax1, ax2) < F.least(bx1, bx2))
    apart_y = (F.least(ay1, ay2) > F.greatest(by1, by2)) | (F.greatest(ay1, ay2) < F.least(by1, by2))
    return ~apart_x & ~apart_y


def squared_length(s: Segment) -> Column:
    x1, y1, x2, y2 = s
    return (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)


def length(s: Segment) -> Column:
    return F.sqrt(squared_length(s).cast("double"))


def point_segment_distance(px: Column, py: Column, s: Segment) -> Column:
    """Distance of a point from a segment; of a zero-length segment, the distance of the points."""
    x1, y1, x2, y2 = s
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def cross_product(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(a - o) x (b - o)."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def segments_cross(a: Segment, b: Segment) -> Column:
    """Whether two segments that are not parallel have a point in common (ends included)."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = a, b
    sides = lambda ox, oy, ex, ey, px, py, qx, qy: F.signum(cross_product(ox, oy, ex, ey, px, py).cast("double")) * F.signum(cross_product(ox, oy, ex, ey, qx, qy).cast("double"))
    parallel = (x1 - x2) * (y3 - y4) - (x3 - x4) * (y1 - y2) == 0
    return ~parallel & (sides(x1, y1, x2, y2, x3, y3, x4, y4) <= 0) & (sides(x3, y3, x4, y4, x1, y1, x2, y2) <= 0)


def same_orientation(k1a: Column, k2a: Column, k1b: Column, k2b: Column) -> Column:
    """Both horizontal or both vertical."""
    return (k1a + k2b != 0) & (k1b + k2a != 0)


def ends_near(a: Segment, b: Segment, eps: float) -> Column:
    """Whether an end of one is nearer than eps to an end of the other."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = a, b
    near = [squared_length((p, q, u, v)) < eps * eps for p, q in ((x1, y1), (x2, y2)) for u, v in ((x3, y3), (x4, y4))]
    return near[0] | near[1] | near[2] | near[3]


def boxes_near(a: Segment, b: Segment, eps: float) -> Column:
    """Whether the bounding boxes are nearer than eps to each other on both axes."""
    near = [F.least(p, q) - F.greatest(u, v) < eps for s, t in ((a, b), (b, a)) for p, q, u, v in ((s[0], s[2], t[0], t[2]), (s[1], s[3], t[1], t[3]))]
    return near[0] & near[1] & near[2] & near[3]


def end_near_segment(a: Segment, b: Segment, eps: float) -> Column:
    """Whether an end of one is nearer than eps to the other segment, exactly for integers.

    With t the projection times the squared length, the squared distance is that
    of an end, or cross^2 / length^2, so nothing is divided.  Most pairs are told apart
    by their boxes.  The rest is one rule over the four ends: written out four times it
    made long code, which Java most likely did not compile with the join around it.
    """

    def near(e):
        px, py, x1, y1, x2, y2 = (e[c] for c in ("px", "py", "x1", "y1", "x2", "y2"))
        dx, dy = x2 - x1, y2 - y1
        t, n = (px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy
        c = (px - x1) * dy - (py - y1) * dx
        inside = (t > 0) & (t < n)
        return F.when(inside, c * c < eps * eps * n).otherwise(F.least(squared_length((px, py, x1, y1)), squared_length((px, py, x2, y2))) < eps * eps)

    ends = [(a[0], a[1], b), (a[2], a[3], b), (b[0], b[1], a), (b[2], b[3], a)]
    ends = F.array(*[F.struct(*[c.alias(n) for c, n in zip((x, y, *s), ("px", "py", "x1", "y1", "x2", "y2"))]) for x, y, s in ends])
    return boxes_near(a, b, eps) & F.exists(ends, near)


def connected(a: Segment, b: Segment, eps: float, ends: bool = True, middles: bool = True, crossing: bool = False) -> Column:
    """End to end, end to middle (needs ends), and crossing, each if switched on."""
    if middles and not ends:
        raise ValueError("middles includes ends: switch ends on, too")
    out = F.lit(False)
    if crossing:
        out = out | segments_cross(a, b)
    if middles:
        out = out | end_near_segment(a, b, eps)
    elif ends:
        out = out | ends_near(a, b, eps)
    return out
