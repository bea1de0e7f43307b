"""Geometry of outlines of several parts and with holes.

A shape is ARRAY<part>, a part ARRAY<ring>, its first ring the outer one and the others its holes, a ring ARRAY<STRUCT<x, y, z>>,
closed or not. Which way rings turn does not matter. Sums run over the edges of all rings, so no geometry is built anew; what a
loop reads often goes through `rings.settle` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.functions import rings

COLUMN = "parts"


def of_frame(columns) -> Column:
    """The shape of a row that carries `ring`, and `parts` where the ring alone does not say it."""
    alone = F.when(F.size("ring") > 0, F.array(F.array(F.col("ring"))))
    return F.coalesce(F.col(COLUMN), alone) if COLUMN in columns else alone


def vertices(shape: Column) -> Column:
    return F.flatten(F.flatten(shape))


def edges(shape: Column) -> Column:
    """Edges of all rings as STRUCT<ax, ay, bx, by>."""
    return F.flatten(F.transform(F.flatten(shape), rings.edges))


def box(shape: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax."""
    return rings.box(vertices(shape))


def _moments(ring: Column, hole: Column) -> Column:
    """Of one ring, from its first vertex: twice its area and the moments of that, taken off for a hole."""
    t = rings.sums_twice(ring)
    sign = lambda t: F.signum(t["a"]) * F.when(hole, F.lit(-1.0)).otherwise(F.lit(1.0))
    first = ring[0]
    # The sums are made once and read from a list of one.
    return F.transform(F.array(t), lambda t: F.struct((sign(t) * t["a"]).alias("a"), (sign(t) * (t["mx"] + t["a"] * first["x"] * 3)).alias("mx"), (sign(t) * (t["my"] + t["a"] * first["y"] * 3)).alias("my")))[0]


def moments(shape: Column) -> Column:
    """STRUCT<a, mx, my> of each ring that has a vertex."""
    part = lambda p: F.transform(F.filter(p, lambda r: F.size(r) > 0), lambda r, i: _moments(r, i > 0))
    return F.flatten(F.transform(shape, part))


def area_of(m: Column) -> Column:
    """Area within the outer rings and outside the holes, from `moments`."""
    return rings.total(m, lambda t: t["a"]) / 2


def centroid_of(m: Column) -> tuple[Column, Column]:
    """Area-weighted centroid from `moments`; NULL for a shape without area."""
    thrice = F.nullif(rings.total(m, lambda t: t["a"]), F.lit(0.0)) * 3
    return rings.total(m, lambda t: t["mx"]) / thrice, rings.total(m, lambda t: t["my"]) / thrice


def area(shape: Column) -> Column:
    return area_of(moments(shape))


def inside(shape: Column, px: Column, py: Column) -> Column:
    """Even-odd over all rings: a place in a hole is outside."""
    return rings.odd_crossings(edges(shape), px, py)


def covers(shape: Column, px: Column, py: Column) -> Column:
    """Place in the shape, the edges of outer rings and holes included."""
    return rings.covered_by(edges(shape), px, py)


def edge_distance(shape: Column, px: Column, py: Column) -> Column:
    """Distance from a place to the nearest edge of any ring; NULL without edges."""
    return rings.nearest_edge_distance(edges(shape), px, py)


def mean_height(shape: Column) -> Column:
    """Mean height of the vertices of the first outer ring, a repeated first vertex counted once."""
    outer = rings.opened(F.try_element_at(F.try_element_at(shape, F.lit(1)), F.lit(1)))
    return F.when(F.size(outer) > 0, F.aggregate(outer, F.lit(0.0), lambda s, p: s + p["z"]) / F.size(outer))


def with_interior_point(df: DataFrame, shape: Column, x: str = "px", y: str = "py") -> DataFrame:
    """`df` with a place inside the shape: each part is cut at the height halfway between the vertex heights that bracket the
    middle of its box, and the middle of the widest stretch of all these cuts is taken, of equal ones the first."""
    level = lambda p: F.transform(F.flatten(p), lambda v: v["y"])
    df = rings.settle(df.withColumn("__cuts", F.transform(F.filter(shape, lambda p: F.size(F.flatten(p)) > 0), lambda p: F.struct(p.alias("p"), F.array_sort(level(p)).alias("ys")))), "__cuts")
    middle = lambda c: (c["ys"][0] + F.element_at(c["ys"], -1)) / 2
    low = lambda c: F.array_max(F.filter(c["ys"], lambda v: v <= middle(c)))
    high = lambda c: F.coalesce(F.array_min(F.filter(c["ys"], lambda v: v > middle(c))), F.element_at(c["ys"], -1))
    df = rings.settle(df.withColumn("__cuts", F.transform("__cuts", lambda c: F.struct(F.flatten(F.transform(c["p"], rings.edges)).alias("e"), ((low(c) + high(c)) / 2).alias("at")))), "__cuts")

    def hits(c: Column) -> Column:
        met = F.filter(c["e"], lambda e: (e["ay"] <= c["at"]) != (e["by"] <= c["at"]))
        return F.array_sort(F.transform(met, lambda e: e["ax"] + (e["bx"] - e["ax"]) * (c["at"] - e["ay"]) / (e["by"] - e["ay"])))

    # A flat part has no stretch: the middle of its box stands for it.
    flat = lambda c: F.array(F.array_min(F.transform(c["e"], lambda e: e["ax"])), F.array_max(F.transform(c["e"], lambda e: e["ax"])))
    df = rings.settle(df.withColumn("__cuts", F.transform("__cuts", lambda c: F.struct(F.when(F.size(hits(c)) > 1, hits(c)).otherwise(flat(c)).alias("x"), c["at"].alias("at")))), "__cuts")

    def stretches(c: Column, part: Column) -> Column:
        each = lambda k: F.struct((c["x"][2 * k + 1] - c["x"][2 * k]).alias("w"), (-part).alias("part"), (-k).alias("k"), ((c["x"][2 * k] + c["x"][2 * k + 1]) / 2).alias("x"), c["at"].alias("y"))
        return F.transform(F.sequence(F.lit(0), (F.size(c["x"]) / 2).cast("int") - 1), each)

    df = rings.settle(df.withColumn("__best", F.array_max(F.flatten(F.transform("__cuts", stretches)))), "__best")
    return df.withColumns({x: F.col("__best.x"), y: F.col("__best.y")}).drop("__best", "__cuts")


def numbered_edges(df: DataFrame, key: str, shape: Column) -> DataFrame:
    """(key, ring, i, n, ax, ay, bx, by): the edges of every ring, numbered within it, without those of no length."""
    given = df.select(key, F.posexplode(F.flatten(shape)).alias("ring", "v"))
    given = given.select(key, "ring", rings.opened(F.col("v")).alias("v"))
    out = given.select(key, "ring", F.size("v").alias("n"), F.posexplode(rings.edges(F.col("v"))).alias("i", "e"))
    return out.select(key, "ring", "i", "n", "e.*").where("ax <> bx OR ay <> by")


def crosses_itself(edges: Column) -> Column:
    """Whether two of a shape's numbered edges (ring, i, n, ax, ay, bx, by) that share no corner properly cross; all pairs are asked."""

    def against(p: Column) -> Column:
        def crosses(q: Column) -> Column:
            same = p["ring"] == q["ring"]
            ordered = (p["ring"] < q["ring"]) | (same & (p["i"] < q["i"]))
            near = same & ((q["i"] - p["i"] == 1) | ((p["i"] == 0) & (q["i"] == q["n"] - 1)))
            side = lambda s, t, u: rings.side(s["ax"], s["ay"], s["bx"], s["by"], t[u + "x"], t[u + "y"])
            return ordered & ~near & (side(p, q, "a") * side(p, q, "b") < 0) & (side(q, p, "a") * side(q, p, "b") < 0)

        return F.exists(edges, crosses)

    return F.coalesce(F.exists(edges, against), F.lit(False))


def edge_list(shape: Column) -> Column:
    """`numbered_edges` as an array on the shape's own row."""

    def of_ring(v: Column, ring: Column) -> Column:
        return F.transform(rings.edges(v), lambda e, i: F.struct(ring.alias("ring"), i.alias("i"), F.size(v).alias("n"), *[e[c].alias(c) for c in ("ax", "ay", "bx", "by")]))

    return F.filter(F.flatten(F.transform(F.transform(F.flatten(shape), rings.opened), of_ring)), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
