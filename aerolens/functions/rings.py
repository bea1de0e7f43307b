"""Geometry of outlines of any length, ARRAY<STRUCT<x, y>>, with higher-order functions.

An outline that is computed in the same projection would be computed again for every step of a loop over it, so callers
pass it through `settle` first, which puts it behind a generator the optimiser does not look through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once per row before anything loops over them. No shuffle."""
    packed = F.array(F.struct(*[F.col(n).alias(n) for n in names]))
    others = [c for c in df.columns if c not in names]
    out = df.select(*others, F.explode(packed).alias("__settled"))
    return out.select(*[F.col("__settled." + c).alias(c) if c in names else F.col(c) for c in df.columns])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def closing(ring: Column) -> Column:
    """The outline with its first vertex moved to the end: the far end of each edge."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    """Edges of the closed outline as STRUCT<ax, ay, bx, by>."""
    return F.zip_with(
        ring,
        closing(ring),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )


def legs(path: Column) -> Column:
    """Edges of an open path."""
    return F.slice(edges(path), 1, F.greatest(F.size(path) - 1, F.lit(0)))


def total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def x_of(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["x"])


def y_of(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["y"])


def box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax."""
    return F.array_min(x_of(ring)), F.array_min(y_of(ring)), F.array_max(x_of(ring)), F.array_max(y_of(ring))


def _leg_length(e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    return F.sqrt(dx * dx + dy * dy)


def path_length(path: Column) -> Column:
    """Length along an open path, seen from above."""
    return total(legs(path), _leg_length)


def path_length3(path: Column) -> Column:
    """Length along an open path of STRUCT<x, y, z>, heights included."""

    def step(a: Column, b: Column) -> Column:
        dx, dy, dz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
        return F.sqrt(dx * dx + dy * dy + dz * dz)

    n = F.greatest(F.size(path) - 1, F.lit(0))
    return total(F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), step), lambda v: v)


def perimeter(ring: Column) -> Column:
    """Length round a closed outline; 0 with fewer than two vertices."""
    return F.when(F.size(ring) < 2, F.lit(0.0)).otherwise(total(edges(ring), _leg_length))


def _relative(ring: Column) -> Column:
    """Edges relative to the first vertex: the origin rides along so that it is read once per row, not per edge."""
    return F.zip_with(
        edges(ring),
        F.array_repeat(ring[0], F.size(ring)),
        lambda e, o: F.struct(
            (e["ax"] - o["x"]).alias("ax"),
            (e["ay"] - o["y"]).alias("ay"),
            (e["bx"] - o["x"]).alias("bx"),
            (e["by"] - o["y"]).alias("by"),
        ),
    )


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def signed_area_twice(ring: Column) -> Column:
    return total(_relative(ring), _cross)


def moments_twice(ring: Column) -> tuple[Column, Column]:
    """Sums of the edges' middles, doubled, by their cross products, from the first vertex."""
    rel = _relative(ring)
    return total(rel, lambda e: (e["ax"] + e["bx"]) * _cross(e)), total(rel, lambda e: (e["ay"] + e["by"]) * _cross(e))


def sums_twice(ring: Column) -> Column:
    """STRUCT<a, mx, my>: `signed_area_twice` and `moments_twice` in one walk over the edges."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    add = lambda s, e: F.struct((s["a"] + _cross(e)).alias("a"), (s["mx"] + (e["ax"] + e["bx"]) * _cross(e)).alias("mx"), (s["my"] + (e["ay"] + e["by"]) * _cross(e)).alias("my"))
    return F.aggregate(_relative(ring), zero, add)


def area(ring: Column) -> Column:
    """Unsigned shoelace area; 0 for an empty outline."""
    return F.when(F.size(ring) == 0, F.lit(0.0)).otherwise(F.abs(signed_area_twice(ring)) / F.lit(2.0))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted centroid; NULL for an outline without area."""
    rel = _relative(ring)
    twice = total(rel, _cross)
    safe = F.when(F.abs(twice) > 1e-9, twice * F.lit(3.0))
    cx = total(rel, lambda e: (e["ax"] + e["bx"]) * _cross(e)) / safe
    cy = total(rel, lambda e: (e["ay"] + e["by"]) * _cross(e)) / safe
    return ring[0]["x"] + cx, ring[0]["y"] + cy


def odd_crossings(all_edges: Column, px: Column, py: Column) -> Column:
    """Even-odd test over any edges. Give `px`, `py` as stored columns, not as long expressions."""

    def crossing(e: Column) -> Column:
        # An edge that leaves the point's height aside is told by two comparisons; the turn is worked out for the others alone.
        turn = (e["bx"] - e["ax"]) * (py - e["ay"]) - (px - e["ax"]) * (e["by"] - e["ay"])
        return ((e["ay"] <= py) != (e["by"] <= py)) & F.when(e["ay"] <= py, turn > 0).otherwise(turn < 0)

    return F.aggregate(all_edges, F.lit(0), lambda n, e: n + crossing(e).cast("int")) % 2 == 1


def inside(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd test."""
    return odd_crossings(edges(ring), px, py)


def touches(e: Column, px: Column, py: Column) -> Column:
    """Whether a point lies on an edge."""
    turn = (e["bx"] - e["ax"]) * (py - e["ay"]) - (px - e["ax"]) * (e["by"] - e["ay"])
    within = py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
    return within & (turn == 0)


def covers(ring: Column, px: Column, py: Column) -> Column:
    """Point in outline, the outline included."""
    return covered_by(edges(ring), px, py)


def covered_by(all_edges: Column, px: Column, py: Column) -> Column:
    """Point within the outline that has these edges, or on one of them."""
    return odd_crossings(all_edges, px, py) | F.exists(all_edges, lambda e: touches(e, px, py))


def opened(ring: Column) -> Column:
    """The outline without the repeated first vertex of a closed one."""
    last = F.when((F.size(ring) > 1) & ring[0].eqNullSafe(F.element_at(ring, -1)), F.size(ring) - 1).otherwise(F.size(ring))
    return F.slice(ring, 1, last)


def nearest_edge_distance(all_edges: Column, px: Column, py: Column) -> Column:
    """Distance from a point to the nearest of some edges; NULL without edges.

    The formula of `segment_distance_sq` in steps, as a loop works out anew whatever its formula names twice.
    """
    one = lambda **parts: F.struct(*[c.alias(n) for n, c in parts.items()])
    steps = F.transform(all_edges, lambda e: one(ax=e["ax"], ay=e["ay"], dx=e["bx"] - e["ax"], dy=e["by"] - e["ay"]))
    along = lambda e: ((px - e["ax"]) * e["dx"] + (py - e["ay"]) * e["dy"]) / F.nullif(e["dx"] * e["dx"] + e["dy"] * e["dy"], F.lit(0.0))
    share = lambda e: F.least(F.greatest(F.coalesce(along(e), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    steps = F.transform(steps, lambda e: one(ax=e["ax"], ay=e["ay"], dx=e["dx"], dy=e["dy"], t=share(e)))
    steps = F.transform(steps, lambda e: one(x=px - (e["ax"] + e["t"] * e["dx"]), y=py - (e["ay"] + e["t"] * e["dy"])))
    return F.sqrt(F.array_min(F.transform(steps, lambda d: d["x"] * d["x"] + d["y"] * d["y"])))


def edge_distance(ring: Column, px: Column, py: Column, closed: bool = True) -> Column:
    """Distance from a point to the nearest edge; NULL without edges."""
    return nearest_edge_distance(edges(ring) if closed else legs(ring), px, py)


def side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1 if a third point lies to the left of the line through two others, -1 to the right, 0 on it."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def crosses_itself(ring: Column) -> Column:
    """Whether two sides that share no corner properly cross."""
    numbered = F.transform(edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i"), F.size(ring).alias("n")))

    def against(p: Column) -> Column:
        def crosses(q: Column) -> Column:
            a, c = p["e"], q["e"]
            apart = (q["i"] >= p["i"] + 2) & ~((p["i"] == 0) & (q["i"] == p["n"] - 1))
            one = side(a["ax"], a["ay"], a["bx"], a["by"], c["ax"], c["ay"]) * side(
                a["ax"], a["ay"], a["bx"], a["by"], c["bx"], c["by"]
            )
            two = side(c["ax"], c["ay"], c["bx"], c["by"], a["ax"], a["ay"]) * side(
                c["ax"], c["ay"], c["bx"], c["by"], a["bx"], a["by"]
            )
            return apart & (one < 0) & (two < 0)

        return F.exists(numbered, crosses)

    return (F.size(ring) >= 4) & F.exists(numbered, against)


def box_touches(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a box and an outline share ground: a vertex in the box, a box corner in the outline, or crossing edges."""
    vertex_in = F.exists(ring, lambda p: (p["x"] >= x0) & (p["x"] <= x1) & (p["y"] >= y0) & (p["y"] <= y1))
    quad = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    corner_in = inside(ring, x0, y0) | inside(ring, x1, y0) | inside(ring, x1, y1) | inside(ring, x0, y1)

    def meets(e: Column) -> Column:
        hit = F.lit(False)
        for (cx, cy), (dx, dy) in zip(quad, quad[1:] + quad[:1]):
            apart = side(e["ax"], e["ay"], e["bx"], e["by"], cx, cy) != side(e["ax"], e["ay"], e["bx"], e["by"], dx, dy)
            split = side(cx, cy, dx, dy, e["ax"], e["ay"]) != side(cx, cy, dx, dy, e["bx"], e["by"])
            hit = hit | (apart & split)
        return hit

    return vertex_in | corner_in | F.exists(edges(ring), meets)


def overlap_inclusive(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes that share at least a boundary point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def overlap_strict(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes that share ground."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def covered_share(node: tuple[Column, ...], area_box: tuple[Column, ...]) -> Column:
    """Share of a box that another box covers, 0 to 1."""
    w = F.least(node[2], area_box[2]) - F.greatest(node[0], area_box[0])
    h = F.least(node[3], area_box[3]) - F.greatest(node[1], area_box[1])
    whole = F.nullif((node[2] - node[0]) * (node[3] - node[1]), F.lit(0.0))
    return F.when((w > 0) & (h > 0), w * h / whole).otherwise(F.lit(0.0))


def nearest_on_leg(e: Column, px: Column, py: Column) -> Column:
    """Nearest place of an edge to a point, with its distance."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    length = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(((px - e["ax"]) * dx + (py - e["ay"]) * dy) / length, F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    x, y = e["ax"] + t * dx, e["ay"] + t * dy
    return F.struct(F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("d"), x.alias("x"), y.alias("y"))


def wkt_polygon_z(ring: Column) -> Column:
    """POLYGON Z text with three decimals."""
    parts = F.transform(ring, lambda p: F.format_string("%.3f %.3f %.3f", p["x"], p["y"], p["z"]))
    return F.concat(F.lit("POLYGON Z (("), F.array_join(parts, ", "), F.lit("))"))
