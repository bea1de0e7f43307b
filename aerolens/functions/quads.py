"""Geometry of four-cornered footprints held as plain columns.

A footprint has exactly four corners, so its edges are written out instead of looped over: the whole test is
straight-line generated code. Terms are taken relative to a corner, because grid coordinates are about 5e6 feet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

XY = tuple[Column, Column]


def corners(prefix: str = "") -> list[XY]:
    """The corner columns x0..y3 (optionally qualified) as pairs."""
    return [(F.col(f"{prefix}x{i}"), F.col(f"{prefix}y{i}")) for i in range(4)]


def heights(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}z{i}") for i in range(4)]


def _edges(quad: Sequence[XY]):
    return [(quad[i], quad[(i + 1) % 4]) for i in range(4)]


def bbox(quad: Sequence[XY]) -> tuple[Column, Column, Column, Column]:
    xs, ys = [c[0] for c in quad], [c[1] for c in quad]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def _crosses(quad: Sequence[XY]) -> list[tuple[Column, Column, Column]]:
    """(x sum, y sum, cross product) of each edge, relative to the first corner."""
    ox, oy = quad[0]
    out = []
    for (ax, ay), (bx, by) in _edges(quad):
        ax, ay, bx, by = ax - ox, ay - oy, bx - ox, by - oy
        out.append((ax + bx, ay + by, ax * by - bx * ay))
    return out


def area(quad: Sequence[XY]) -> Column:
    """Unsigned shoelace area."""
    return F.abs(reduce(add, [c for _, _, c in _crosses(quad)])) / F.lit(2.0)


def centroid(quad: Sequence[XY]) -> XY:
    """Area-weighted centroid; NULL for a quad without area."""
    terms = _crosses(quad)
    thrice = F.nullif(reduce(add, [c for _, _, c in terms]) * F.lit(3.0), F.lit(0.0))
    cx = reduce(add, [sx * c for sx, _, c in terms]) / thrice
    cy = reduce(add, [sy * c for _, sy, c in terms]) / thrice
    return quad[0][0] + cx, quad[0][1] + cy


def z_middle(zs: Sequence[Column]) -> Column:
    """Middle of the lowest and highest corner height."""
    return (F.least(*zs) + F.greatest(*zs)) / F.lit(2.0)


def covers(quad: Sequence[XY], px: Column, py: Column) -> Column:
    """Point in quad, the outline included: odd number of crossings, or zero cross product within an edge's box."""
    odd, on_edge = [], []
    for (ax, ay), (bx, by) in _edges(quad):
        turn = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        up = (ay <= py) & (by > py) & (turn > 0)
        down = (ay > py) & (by <= py) & (turn < 0)
        odd.append((up | down).cast("int"))
        on_edge.append(
            (turn == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
        )
    return (reduce(add, odd) % 2 == 1) | reduce(or_, on_edge)


def turning(quad: Sequence[XY]) -> Column:
    """1 for a convex outline drawn counter-clockwise, -1 for a convex clockwise one, 0 for anything else."""
    bends = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = quad[i], quad[(i + 1) % 4], quad[(i + 2) % 4]
        bends.append(F.signum((bx - ax) * (cy - by) - (by - ay) * (cx - bx)))
    return F.when(F.least(*bends) > 0, 1).when(F.greatest(*bends) < 0, -1).otherwise(0)


def left_turns(quad: Sequence[XY], px: Column, py: Column) -> list[Column]:
    """Twice the area between each edge and a point: positive to the left of the edge.

    For a convex counter-clockwise quad the point is covered when none is negative, and divided by the edges' lengths
    the least of them is the distance to the outline.
    """
    return [(bx - ax) * (py - ay) - (px - ax) * (by - ay) for (ax, ay), (bx, by) in _edges(quad)]


def edge_lengths(quad: Sequence[XY]) -> list[Column]:
    return [distance(*a, *b) for a, b in _edges(quad)]


def inside(quad: Sequence[XY], px: Column, py: Column) -> Column:
    """Even-odd test alone; a point on the outline may go either way."""
    odd = []
    for (ax, ay), (bx, by) in _edges(quad):
        turn = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        odd.append((((ay <= py) & (by > py) & (turn > 0)) | ((ay > py) & (by <= py) & (turn < 0))).cast("int"))
    return reduce(add, odd) % 2 == 1


def segment_distance_sq(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Squared distance from a point to a segment (a segment of no length is its point)."""
    dx, dy = bx - ax, by - ay
    length = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def edge_distance(quad: Sequence[XY], px: Column, py: Column) -> Column:
    """Distance from a point to the outline."""
    return F.sqrt(F.least(*[segment_distance_sq(*a, *b, px, py) for a, b in _edges(quad)]))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    return F.sqrt(dx * dx + dy * dy)


def distance3(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = bx - ax, by - ay, bz - az
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def mean_height(zs: Sequence[Column]) -> Column:
    """Mean of the corner heights: the height of flat ground under a photo."""
    return reduce(add, zs) / F.lit(4.0)


def plane_height(quad: Sequence[XY], zs: Sequence[Column], x: Column, y: Column) -> Column:
    """Height at a place of the least-squares plane through the corners; their mean where the plane is not determined."""
    mx = reduce(add, [c[0] for c in quad]) / 4
    my = reduce(add, [c[1] for c in quad]) / 4
    mz = mean_height(zs)
    d = [(q[0] - mx, q[1] - my, z - mz) for q, z in zip(quad, zs)]
    sxx = reduce(add, [a * a for a, _, _ in d])
    sxy = reduce(add, [a * b for a, b, _ in d])
    syy = reduce(add, [b * b for _, b, _ in d])
    sxz = reduce(add, [a * c for a, _, c in d])
    syz = reduce(add, [b * c for _, b, c in d])
    det = sxx * syy - sxy * sxy
    safe = F.when(F.abs(det) >= 1e-9, det)
    tilt = (sxz * syy - syz * sxy) / safe * (x - mx) + (syz * sxx - sxz * sxy) / safe * (y - my)
    return mz + F.coalesce(tilt, F.lit(0.0))


def interior_point(quad: Sequence[XY]) -> XY:
    """A point inside the quad.

    The outline is cut at the height halfway between the two corner heights that bracket the middle of its box; the
    answer is the middle of the widest cut.
    """
    ys = [c[1] for c in quad]
    low, high = F.least(*ys), F.greatest(*ys)
    middle = (low + high) / F.lit(2.0)
    below = F.greatest(*[F.when(y <= middle, y).otherwise(low) for y in ys])
    above = F.least(*[F.when(y > middle, y).otherwise(high) for y in ys])
    scan = (below + above) / F.lit(2.0)
    hits = []
    for (ax, ay), (bx, by) in _edges(quad):
        meets = ((ay <= scan) & (by > scan)) | ((by <= scan) & (ay > scan))
        hits.append(F.when(meets, ax + (bx - ax) * (scan - ay) / F.nullif(by - ay, F.lit(0.0))))
    ordered = F.array_sort(F.array_compact(F.array(*hits)))
    first, second = F.try_element_at(ordered, F.lit(1)), F.try_element_at(ordered, F.lit(2))
    third, fourth = F.try_element_at(ordered, F.lit(3)), F.try_element_at(ordered, F.lit(4))
    later_wider = F.coalesce(fourth - third > second - first, F.lit(False))
    x = F.when(later_wider, (third + fourth) / 2).otherwise((first + second) / 2)
    flat = low == high
    x = F.when(flat, (F.least(*[c[0] for c in quad]) + F.greatest(*[c[0] for c in quad])) / 2).otherwise(x)
    return x, F.when(flat, low).otherwise(scan)
