"""Drawn features and measurements: geometry, sizes, checks, labels, picking, readings."""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from aerolens.functions import quads, rings, text
from aerolens.functions.angles import js_round
from aerolens.functions.crs import METRES_PER_FOOT, grid_to_lonlat, lonlat_to_grid
from aerolens.functions.quads import distance
from aerolens.operators.gridjoin import points_in_shapes, points_near_edges
from aerolens.operators.terrain import cut_out, heights_within
from aerolens.session import staged

# Kinds with the fewest and most vertices, and what stands in for missing properties.
KINDS = {"point": (1, 1), "text": (1, 1), "line": (2, 100000), "polygon": (3, 100000), "rectangle": (4, 4), "circle": (1, 1)}
DEFAULT_COLOUR, EPOCH = "#e53935", "1970-01-01T00:00:00.000Z"
CIRCLE_SEGMENTS, SURFACE_SAMPLES, OFF_LINE_PX = 64, 40000, 12.0
HIT_TOLERANCE, HANDLE_TOLERANCE, POINT_EXTRA, TEXT_HALF_CHAR, TEXT_HALF_HEIGHT = 9.0, 11.0, 3.0, 4.0, 12.0
LAYERS = {"Point": "points", "LineString": "lines", "Polygon": "polygons"}
APPROXIMATE = "One photo had no elevation patch, so its ground height is only roughly right."
CROSSED = "The outline crosses itself, so the area is not the area it encloses. Undo the last corner or start again."
BELOW = "The second point is below the ground under the first."


def lonlat_struct(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def problem() -> Column:
    """Why a feature (id, kind, coordinates, radius_m, has properties) cannot be used; NULL when it can."""
    n = F.size("coordinates")
    least = most = F.lit(None).cast("int")
    for kind, (lo, hi) in KINDS.items():
        least = F.when(F.col("kind") == kind, lo).otherwise(least)
        most = F.when(F.col("kind") == kind, hi).otherwise(most)
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    not_pair = F.exists("coordinates", lambda c: ~number(c["lon"]) | ~number(c["lat"]))
    far = F.exists("coordinates", lambda c: (F.abs(c["lon"]) > 180) | (F.abs(c["lat"]) > 90))
    radius = F.coalesce(number(F.col("radius_m")) & (F.col("radius_m") > 0), F.lit(False))
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "no id")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("undefined"))))
        .when(F.col("coordinates").isNull(), "no coordinates")
        .when((n < least) | (n > most), F.concat(F.lit("a "), "kind", F.lit(" cannot have "), n.cast("string"), F.lit(" vertices")))
        .when(not_pair, "a vertex is not a pair of numbers")
        .when(far, "a vertex is outside the world")
        .when((F.col("kind") == "circle") & ~radius, "a circle needs a radius above zero")
    )


def repaired(raw: DataFrame) -> DataFrame:
    """Features as loaded, missing properties filled in; those that are not usable are left out."""
    colour = F.when(F.col("color").rlike(r"(?i)^#[0-9a-f]{6}$"), F.col("color")).otherwise(F.lit(DEFAULT_COLOUR))
    filled = raw.withColumns(
        {
            "label": F.coalesce("label", F.lit("")), "notes": F.coalesce("notes", F.lit("")), "color": colour,
            "created_at": F.coalesce("created_at", F.lit(EPOCH)),
        }
    )
    return filled.where(problem().isNull())


def circle_ring(cx: Column, cy: Column, radius_ft: Column, segments: int = CIRCLE_SEGMENTS) -> Column:
    """Vertices of a circle on the grid; the first is due east and is not repeated."""
    steps = F.array(*[F.struct(F.lit(math.cos(2 * math.pi * i / segments)).alias("c"), F.lit(math.sin(2 * math.pi * i / segments)).alias("s")) for i in range(segments)])
    hub = F.array_repeat(F.struct(cx.alias("x"), cy.alias("y"), radius_ft.alias("r")), segments)
    return F.zip_with(hub, steps, lambda h, a: rings.point(h["x"] + h["r"] * a["c"], h["y"] + h["r"] * a["s"]))


def _to_grid(p: Column) -> Column:
    return rings.point(*lonlat_to_grid(p["lon"], p["lat"]))


def _to_lonlat(p: Column) -> Column:
    return lonlat_struct(*grid_to_lonlat(p["x"], p["y"]))


def on_grid(features: DataFrame) -> DataFrame:
    """Add `ground`, the vertices on the grid, and `outline`: the ring of a circle, otherwise the vertices."""
    df = rings.settle(features.withColumn("ground", F.transform("coordinates", _to_grid)), "ground")
    hub = F.col("ground")[0]
    ring = F.when(F.col("kind") == "circle", circle_ring(hub["x"], hub["y"], F.col("radius_m") / METRES_PER_FOOT)).otherwise(F.col("ground"))
    return rings.settle(df.withColumn("outline", ring), "outline")


def geometry_type() -> Column:
    return F.when(F.col("kind").isin("point", "text"), "Point").when(F.col("kind") == "line", "LineString").otherwise("Polygon")


def with_geometry(located: DataFrame, crs: str = "wgs84") -> DataFrame:
    """Add the geometry a feature is exported as: `type` and `path` (closed for polygons) in degrees or on the grid.

    A circle is its ring of 64 points; text is a point.
    """
    circle = F.col("kind") == "circle"
    if crs == "wgs84":
        base = F.when(circle, F.transform("outline", _to_lonlat)).otherwise(F.col("coordinates"))
    else:
        base = F.transform("outline", lambda p: lonlat_struct(p["x"], p["y"]))
    df = rings.settle(located.withColumns({"type": geometry_type(), "__base": base}), "__base")
    closed = F.when(F.col("type") == "Polygon", F.concat("__base", F.slice("__base", 1, 1))).otherwise(F.col("__base"))
    return df.withColumn("path", closed).drop("__base")


def sizes() -> dict[str, Column]:
    """Length of a line, perimeter and area of a shape (exactly pi r squared for a circle), radius in feet."""
    ring, r = F.col("ground"), F.col("radius_m") / METRES_PER_FOOT
    shape, circle = F.col("kind").isin("polygon", "rectangle"), F.col("kind") == "circle"
    return {
        "length_ft": F.when(F.col("kind") == "line", rings.path_length(ring)),
        "perimeter_ft": F.when(shape, rings.perimeter(ring)).when(circle, 2 * math.pi * r),
        "area_sqft": F.when(shape, rings.area(ring)).when(circle, math.pi * r * r),
        "radius_ft": F.when(circle, r),
    }


def attribute_columns() -> list[Column]:
    """The ten columns every export carries."""
    size, radius = sizes(), F.when(F.col("kind") == "circle", F.col("radius_m"))
    measures = [size[n].alias(n) for n in ("length_ft", "perimeter_ft", "area_sqft")]
    return [*[F.col(n) for n in ("id", "kind", "label", "notes", "color")], radius.alias("radius_m"), *measures, F.col("created_at").alias("created")]


def attributes(located: DataFrame) -> DataFrame:
    return located.select(*attribute_columns())


def _roomiest(ring: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in ring:
        out = []
        for value in batch:
            pts = np.array([(p["x"], p["y"]) for p in value], float)
            a, b = pts, np.roll(pts, -1, axis=0)
            lo, hi = pts.min(axis=0), pts.max(axis=0)
            best, best_d = None, -1.0
            for _ in range(6):
                steps = np.arange(25) / 24
                gx, gy = np.meshgrid(lo[0] + (hi[0] - lo[0]) * steps, lo[1] + (hi[1] - lo[1]) * steps, indexing="ij")
                p = np.stack([gx.ravel(), gy.ravel()], axis=1)[:, None, :]
                d = b - a
                with np.errstate(invalid="ignore", divide="ignore"):
                    cut = d[:, 0] * (p[..., 1] - a[:, 1]) / d[:, 1] + a[:, 0]
                odd = (((a[:, 1] > p[..., 1]) != (b[:, 1] > p[..., 1])) & (p[..., 0] < cut)).sum(axis=1) % 2 == 1
                size = (d * d).sum(axis=1)
                t = np.clip(((p - a) * d).sum(axis=2) / np.where(size == 0, 1, size), 0, 1)
                away = np.sqrt(((p - (a + t[..., None] * d)) ** 2).sum(axis=2)).min(axis=1)
                away = np.where(odd, away, -1.0)
                k = int(away.argmax())
                if away[k] > best_d:
                    best, best_d = p[k, 0], away[k]
                if best is None:
                    break
                half = (hi - lo) / 6
                lo, hi = best - half, best + half
            out.append((np.nan, np.nan) if best is None else tuple(best))
        yield pd.DataFrame(out, columns=["x", "y"])


def label_points(located: DataFrame) -> DataFrame:
    """Where each label goes: the point or centre, half way along a line, the centroid of a shape or its roomiest place.

    Only shapes whose centroid falls outside go through the search for the roomiest place.
    """
    half = rings.path_length(F.col("ground")) / 2
    shape = F.col("kind").isin("polygon", "rectangle")
    cx, cy = rings.centroid(F.col("ground"))
    df = located.withColumns({"__half": half, "__cx": F.when(shape, cx), "__cy": F.when(shape, cy)})
    df = rings.settle(df, "__half", "__cx", "__cy")
    start = F.struct(F.lit(0.0).alias("walked"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("__half").alias("half"))

    def walk(acc: Column, e: Column) -> Column:
        step = distance(e["ax"], e["ay"], e["bx"], e["by"])
        here = acc["x"].isNull() & (acc["walked"] + step >= acc["half"]) & (step > 0)
        t = (acc["half"] - acc["walked"]) / F.nullif(step, F.lit(0.0))
        return F.struct(
            (acc["walked"] + step).alias("walked"), F.when(here, e["ax"] + (e["bx"] - e["ax"]) * t).otherwise(acc["x"]).alias("x"),
            F.when(here, e["ay"] + (e["by"] - e["ay"]) * t).otherwise(acc["y"]).alias("y"), acc["half"].alias("half"),
        )

    along = F.when(F.col("kind") == "line", F.aggregate(rings.legs(F.col("ground")), start, walk))
    df = df.withColumns({"__along": along, "__in": F.coalesce(rings.inside(F.col("ground"), F.col("__cx"), F.col("__cy")), F.lit(False))})
    df = df.withColumns({"__x": F.when(shape & F.col("__in"), F.col("__cx")).otherwise(F.col("__along.x")), "__y": F.when(shape & F.col("__in"), F.col("__cy")).otherwise(F.col("__along.y"))})
    settled = df.where(~shape | F.col("__in"))
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    search = F.pandas_udf(_roomiest, schema)
    searched = df.where(shape & ~F.col("__in")).withColumn("__s", search("ground"))
    known = lambda c: F.when(~F.isnan(c), c)
    searched = searched.withColumns({"__x": known(F.col("__s.x")), "__y": known(F.col("__s.y"))}).drop("__s")
    both = settled.unionByName(searched)
    lon, lat = grid_to_lonlat(F.col("__x"), F.col("__y"))
    first = F.col("coordinates")[0]
    return both.select("id", "kind", F.coalesce(lon, first["lon"]).alias("lon"), F.coalesce(lat, first["lat"]).alias("lat"))


def bounds(located: DataFrame) -> DataFrame:
    """West, south, east and north of each feature in degrees."""
    ring = F.when(F.col("kind") == "circle", F.transform("outline", _to_lonlat)).otherwise(F.col("coordinates"))
    df = rings.settle(located.withColumn("__r", ring), "__r")
    lon, lat = F.transform("__r", lambda p: p["lon"]), F.transform("__r", lambda p: p["lat"])
    return df.select("id", "kind", F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def ground_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return distance(*lonlat_to_grid(lon1, lat1), *lonlat_to_grid(lon2, lat2)) * METRES_PER_FOOT


def layer_extents(with_geom: DataFrame) -> DataFrame:
    """Features and extent of each geometry layer."""
    lon, lat = F.transform("path", lambda p: p["lon"]), F.transform("path", lambda p: p["lat"])
    layer = F.when(F.col("type") == "Point", "points").when(F.col("type") == "LineString", "lines").otherwise("polygons")
    df = with_geom.select(layer.alias("layer"), F.array_min(lon).alias("a"), F.array_min(lat).alias("b"), F.array_max(lon).alias("c"), F.array_max(lat).alias("d"))
    return df.groupBy("layer").agg(F.count("*").alias("n"), F.min("a").alias("min_x"), F.min("b").alias("min_y"), F.max("c").alias("max_x"), F.max("d").alias("max_y"))


#: Bands of a shape's height; a click meets the edges of its own band alone.
BANDS = 16
#: Cells in which clicks meet edges, a few times the reach of a click, and the finest ones in which they meet boxes.
NEAR_CELL, BOX_CELL = 96.0, 300.0


def hits(clicks: DataFrame, shapes: DataFrame, tolerance: float = HIT_TOLERANCE, cell: float = NEAR_CELL) -> DataFrame:
    """The feature under each click (click_id, cx, cy): (click_id, id), in the units both are projected to.

    `shapes` has id, seq, kind, label and `outline` in those units. Point or text, then line, then edge, then inside; ties
    by distance, or the smaller area inside, then drawing order. What is near is found through single edges in cells; a shape's
    inside is told from its box and the crossings of the edges at the click's own height. No outline is copied whole. As being
    inside ranks last, it is asked only for clicks that nothing is near to: where shapes lie densely these are few.
    """
    own = shapes.select("id", "seq", "kind", F.length("label").alias("n"), "outline").withColumn("key", F.monotonically_increasing_id())
    x0, y0, x1, y1 = rings.box(F.col("outline"))
    own = staged(own.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1, "area": F.when(F.size("outline") > 2, rings.area(F.col("outline")))}))
    best = lambda df: df.groupBy("click_id").agg(F.min(F.struct("rank", "tie", "seq", "id")).alias("b")).select("click_id", "b.id", "b.rank")
    near = staged(best(_near(clicks, own, tolerance, cell)))
    # Clicks may share a number; one that is NULL is a click like any other, so it counts as found in the same way.
    left = clicks.join(near.select(F.col("click_id").alias("__near")).hint("merge"), F.col("click_id").eqNullSafe(F.col("__near")), "left_anti")
    inside = _around(left, own, BOX_CELL)
    return near.unionByName(best(inside.select("click_id", F.lit(3).alias("rank"), F.col("area").alias("tie"), "seq", "id")))


def _edges_of(shapes: DataFrame) -> DataFrame:
    """Single edges of features; a point or a text has one of no length, a line no edge back to its beginning."""
    ring, open_ended = F.col("outline"), F.col("kind") == "line"
    each = F.when(open_ended, rings.legs(ring)).otherwise(rings.edges(ring))
    return shapes.select(*[c for c in shapes.columns if c != "outline"], F.posexplode(each).alias("after", "e")).select("*", "e.*").drop("e")


def _near(clicks: DataFrame, own: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(click_id, id, seq, rank, tie) of the points, texts, lines and edges within reach of a click."""
    reach = tolerance + POINT_EXTRA
    kind = F.col("kind")
    half = F.when(kind == "text", F.greatest(F.lit(reach), F.coalesce("n", F.lit(0)) * TEXT_HALF_CHAR + 4)).otherwise(F.lit(0.0))
    # The writing of a text is a level edge through its place.
    edges = _edges_of(own.select("id", "seq", "kind", "n", "outline")).withColumn("half", half)
    edges = edges.withColumns({"ax": F.col("ax") - F.col("half"), "bx": F.col("bx") + F.col("half")})
    pairs = points_near_edges(clicks.select("click_id", "cx", "cy"), edges, max(TEXT_HALF_HEIGHT, reach), ("cx", "cy"), cell)
    d = F.sqrt(quads.segment_distance_sq(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("cx"), F.col("cy")))
    hub = distance((F.col("ax") + F.col("bx")) / 2, F.col("ay"), F.col("cx"), F.col("cy"))
    in_text = (F.abs((F.col("ax") + F.col("bx")) / 2 - F.col("cx")) <= F.col("half")) & (F.abs(F.col("ay") - F.col("cy")) <= TEXT_HALF_HEIGHT)
    spot = lambda rank, tie: F.struct(F.lit(rank).alias("rank"), tie.alias("tie"))
    found = (
        F.when((kind == "point") & (hub <= reach), spot(0, hub)).when((kind == "text") & in_text, spot(0, hub))
        .when((kind == "line") & (d <= tolerance), spot(1, d)).when(~kind.isin("point", "text", "line") & (d <= tolerance), spot(2, d))
    )
    # Settled, so that the formulas stay out of the join's own loop, which is compiled only while it is short.
    return rings.settle(pairs.withColumn("k", found), "k").where(F.col("k").isNotNull()).select("click_id", "id", "seq", "k.*")


def _around(clicks: DataFrame, own: DataFrame, cell: float) -> DataFrame:
    """(click_id, id, seq, area) of the shapes that a click lies inside: an odd number of edges to its right."""
    closed = own.where(~F.col("kind").isin("point", "text", "line") & F.col("area").isNotNull())
    closed = closed.withColumn("pitch", F.greatest((F.col("ymax") - F.col("ymin")) / BANDS, F.lit(1e-9)))
    band = lambda y: F.floor((y - F.col("ymin")) / F.col("pitch"))
    boxed = points_in_shapes(clicks.select("click_id", "cx", "cy"), closed.select("key", "id", "seq", "area", "xmin", "ymin", "xmax", "ymax", "pitch"), ["click_id"], ["key"], F.lit(True), at=("cx", "cy"), cell=cell, levels=(0, 2, 4, 6, 8, 10))
    boxed = boxed.withColumn("band", band(F.col("cy")))
    edges = _edges_of(closed.select("key", "kind", "ymin", "pitch", "outline")).where("ay <> by")
    edges = edges.withColumn("band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by"))))).select("key", "band", "ax", "ay", "bx", "by")
    turn = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    met = ((F.col("ay") <= F.col("cy")) & (F.col("by") > F.col("cy")) & (turn > 0)) | ((F.col("ay") > F.col("cy")) & (F.col("by") <= F.col("cy")) & (turn < 0))
    crossed = boxed.join(edges, ["key", "band"]).where(met).groupBy("click_id", "key").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "seq", "area")])
    return crossed.where("n % 2 = 1").select("click_id", "id", "seq", "area")


def nearest_edges(clicks: DataFrame, shapes: DataFrame, tolerance: float = HIT_TOLERANCE, cell: float = NEAR_CELL) -> DataFrame:
    """Per click (click_id, cx, cy) the nearest place on an edge of any feature within reach: (click_id, id, after, x, y, d).

    Of equally near edges the first drawn feature's counts, and of one feature's the last one.
    """
    edges = _edges_of(shapes.where(F.size("outline") > 1).select("id", "seq", "kind", "outline"))
    pairs = points_near_edges(clicks.select("click_id", "cx", "cy"), edges, tolerance, ("cx", "cy"), cell)
    # Settled, so that the formulas stay out of the join's own loop, which is compiled only while it is short.
    pairs = rings.settle(pairs.withColumn("p", rings.nearest_on_leg(F.struct("ax", "ay", "bx", "by"), F.col("cx"), F.col("cy"))), "p").where(F.col("p.d") <= tolerance)
    best = F.min(F.struct(F.col("p.d").alias("d"), "seq", (-F.col("after")).alias("o"), "id", F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    return pairs.groupBy("click_id").agg(best.alias("b")).select("click_id", "b.id", (-F.col("b.o")).alias("after"), "b.x", "b.y", "b.d")


def nearest_handles(clicks: DataFrame, located: DataFrame, tolerance: float = HANDLE_TOLERANCE, cell: float = NEAR_CELL) -> DataFrame:
    """Per click the nearest handle of any feature within reach, the first of equally near ones by drawing order and number."""
    own = handles(located, keep=("seq",)).select("id", "seq", "index", "role", *[F.col(h).alias(c) for h, c in (("hx", "ax"), ("hy", "ay"), ("hx", "bx"), ("hy", "by"))])
    pairs = points_near_edges(clicks.select("click_id", "cx", "cy"), own, tolerance, ("cx", "cy"), cell)
    pairs = pairs.withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("cx"), F.col("cy"))).where(F.col("d") <= tolerance)
    return pairs.groupBy("click_id").agg(F.min(F.struct("d", "seq", "index", "id", "role")).alias("b")).select("click_id", "b.id", "b.index", "b.role", "b.d")


def handles(located: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Places of a feature that can be grabbed: each vertex, or a circle's centre and its easternmost ring point."""
    circle = F.col("kind") == "circle"
    at = F.when(circle, F.array(F.col("ground")[0], F.col("outline")[0])).otherwise(F.col("ground"))
    df = located.select("id", *keep, "kind", F.posexplode(at).alias("index", "p"))
    role = F.when(F.col("kind") != "circle", "vertex").when(F.col("index") == 0, "centre").otherwise("radius")
    return df.select("id", *keep, "index", role.alias("role"), F.col("p.x").alias("hx"), F.col("p.y").alias("hy"))


def nearest_handle(near: DataFrame, tolerance: float = HANDLE_TOLERANCE) -> DataFrame:
    """Per click the nearest handle within reach, the first of equally near ones. Rows are (click, handle) pairs."""
    d = distance(F.col("cx"), F.col("cy"), F.col("hx"), F.col("hy"))
    best = near.withColumn("d", d).where(F.col("d") <= tolerance).groupBy("click_id").agg(F.min(F.struct("d", "index", "role")).alias("b"))
    return best.select("click_id", "b.index", "b.role", "b.d")


def nearest_edge(near: DataFrame, closed: Column, tolerance: float = HIT_TOLERANCE) -> DataFrame:
    """Per click the nearest place on an edge of its feature within reach, the last of equally near ones."""
    df = near.select("click_id", "cx", "cy", F.posexplode(F.when(closed, rings.edges(F.col("outline"))).otherwise(rings.legs(F.col("outline")))).alias("after", "e"))
    df = df.withColumn("p", rings.nearest_on_leg(F.col("e"), F.col("cx"), F.col("cy"))).where(F.col("p.d") <= tolerance)
    best = df.groupBy("click_id").agg(F.min(F.struct(F.col("p.d").alias("d"), (-F.col("after")).alias("o"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))).alias("b"))
    return best.select("click_id", (-F.col("b.o")).alias("after"), "b.x", "b.y", "b.d")


def measured(vertices: DataFrame) -> DataFrame:
    """Measurement rows with their ordered vertices as one array; a measurement is a handful of picked points."""
    one = F.struct("seq", "x", "y", "z", "approximate")
    df = vertices.groupBy("meas_id", "tool").agg(F.array_sort(F.collect_list(one)).alias("v"), F.max("rise").alias("rise"), F.max("off_px").alias("off_px"))
    return df


def side_lengths(vertices: DataFrame, closed: Column, mode3d: bool = False) -> DataFrame:
    """Each side of a measurement with its ends' order and length; closed outlines of three or more wrap round."""
    w = Window.partitionBy("meas_id").orderBy("seq")
    whole = Window.partitionBy("meas_id")
    at = F.struct("seq", "x", "y", "z")
    df = vertices.withColumns({"n": F.count("*").over(whole), "nxt": F.lead(at).over(w), "one": F.min(at).over(whole)})
    other = F.coalesce("nxt", F.when(closed & (F.col("n") >= 3), F.col("one")))
    df = df.withColumn("b", other).where(F.col("b").isNotNull())
    dx, dy, dz = F.col("b.x") - F.col("x"), F.col("b.y") - F.col("y"), F.col("b.z") - F.col("z")
    feet = F.sqrt(dx * dx + dy * dy + (dz * dz if mode3d else F.lit(0.0)))
    return df.select("meas_id", F.col("seq").alias("a"), F.col("b.seq").alias("b"), feet.alias("feet"))


#: Grid points of an outline that are worked on at once.
POINTS_AT_ONCE = 1 << 18


def _inside_grid(rx: np.ndarray, ry: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a grid that lie inside an outline, by the test of `rings.inside`."""
    odd = np.zeros((len(ys), len(xs)), bool)
    for ax, ay, bx, by in zip(rx, ry, np.roll(rx, -1), np.roll(ry, -1)):
        rows = np.flatnonzero((ay <= ys) != (by <= ys))
        turn = (bx - ax) * (ys[rows, None] - ay) - (xs[None, :] - ax) * (by - ay)
        odd[rows] ^= np.where((ay <= ys[rows])[:, None], turn > 0, turn < 0)
    j, i = np.nonzero(odd)
    return xs[i], ys[j]


def _slope_factors(row: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Sum and number of the slope factors at places of one outline, those that have a height on all four sides."""
    d, h = row["d"], []
    for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        px, py = x + a * d, y + b * d
        z = heights_within(px, py, row)
        if row.get("base") is not None:
            z = np.where(np.isnan(z), row["base"] + row["east"] * (px - row["bx0"]) + row["north"] * (py - row["by0"]), z)
        h.append(z)
    gx, gy = (h[0] - h[1]) / (2 * d), (h[2] - h[3]) / (2 * d)
    factor = np.sqrt(1 + gx * gx + gy * gy)
    factor = factor[~np.isnan(factor)]
    return float(factor.sum()), len(factor)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            rx, ry, sp = np.array(row["rx"], float), np.array(row["ry"], float), row["sp"]
            steps = [np.arange(max(0, math.ceil((row[hi] - row[lo]) / sp - 0.5) - 1) + 1) for lo, hi in (("bx0", "bx1"), ("by0", "by1"))]
            xs, ys = row["bx0"] + sp * (steps[0] + 0.5), row["by0"] + sp * (steps[1] + 0.5)
            total, n = 0.0, 0
            each = max(1, POINTS_AT_ONCE // len(xs))
            for at in range(0, len(ys), each):
                part = _slope_factors(row, *_inside_grid(rx, ry, xs, ys[at : at + each]))
                total, n = total + part[0], n + part[1]
            out.append((row["shape_id"], total, n, *_slope_factors(row, np.array([row["mx"]]), np.array([row["my"]]))))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, [batch.schema.field("shape_id"), *SUMS])], ["shape_id", *(f.name for f in SUMS)])


#: Sums and numbers of the factors of the samples inside an outline and of the one that stands in for them.
SUMS = [pa.field("total", pa.float64()), pa.field("n", pa.int64()), pa.field("spare", pa.float64()), pa.field("n_spare", pa.int64())]


def surface_areas(outlines: DataFrame, patches: DataFrame, samples: int = SURFACE_SAMPLES) -> DataFrame:
    """Area of the terrain surface under each outline (shape_id, patch_id, ring): flat area times the mean slope factor.

    Samples on a grid are kept inside the outline, and the heights of their four neighbours looked up; a sliver between the
    samples is judged at the mean of its vertices. Where the patch has no height, or there is none, the plane through the photo's
    footprint stands in for it, if the outlines carry its corners (x0 to z3). An outline meets the part of its patch under
    it once, and all its samples are worked out there: none is a row of a table.
    """
    x0, y0, x1, y1 = rings.box(F.col("ring"))
    df = outlines.withColumns({"flat": rings.area(F.col("ring")), "bx0": x0, "by0": y0, "bx1": x1, "by1": y1}).where((F.size("ring") >= 3) & (F.col("flat") > 0))
    spacing = F.greatest(F.lit(1.0), F.sqrt((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) / samples))
    df = rings.settle(df.withColumns({"sp": spacing, "mx": rings.total(rings.x_of(F.col("ring")), lambda v: v) / F.size("ring"), "my": rings.total(rings.y_of(F.col("ring")), lambda v: v) / F.size("ring")}), "flat", "sp", "bx0", "by0", "bx1", "by1", "mx", "my")
    df = df.withColumn("d", F.greatest(F.lit(2.0), F.col("sp") / 2))
    near = {"__x0": F.col("bx0") - F.col("d"), "__y0": F.col("by0") - F.col("d"), "__x1": F.col("bx1") + F.col("d"), "__y1": F.col("by1") + F.col("d")}
    own = {"rx": rings.x_of(F.col("ring")), "ry": rings.y_of(F.col("ring"))}
    if "z3" in outlines.columns:
        plane = lambda x, y: quads.plane_height(quads.corners(), quads.heights(), x, y)
        base = plane(F.col("bx0"), F.col("by0"))
        own |= {"base": base, "east": (plane(F.col("bx0") + 1024, F.col("by0")) - base) / 1024, "north": (plane(F.col("bx0"), F.col("by0") + 1024) - base) / 1024}
    slim = df.where(F.col("shape_id").isNotNull()).select("shape_id", "patch_id", "d", "sp", "bx0", "by0", "bx1", "by1", "mx", "my", *[c.alias(n) for n, c in (own | near).items()])
    cut = cut_out(slim, patches, tuple(near)).drop("patch_id", *near)
    # Rows are few and small for the work in them.
    dealt = cut.repartition(math.ceil(math.sqrt(outlines.count() + 1)))
    schema = T.StructType([cut.schema["shape_id"], *[T.StructField(f.name, T.LongType() if f.type == pa.int64() else T.DoubleType()) for f in SUMS]])
    sums = dealt.mapInArrow(_sampled, schema).groupBy("shape_id").agg(*[F.sum(f.name).alias(f.name) for f in SUMS])
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    means = sums.select("shape_id", mean("total", "n").alias("m"), mean("spare", "n_spare").alias("s"))
    return df.select("shape_id", "flat").join(means.hint("merge"), "shape_id").select("shape_id", "flat", (F.col("flat") * F.coalesce("m", "s")).alias("surface"))


def readings(measures: DataFrame) -> DataFrame:
    """What each measurement reads: its rows as text, and its warnings. `surface` is the terrain area of the area3d tool."""
    v, n, tool, rise = F.col("v"), F.size("v"), F.col("tool"), F.col("rise")
    first, last = v[0], F.element_at("v", -1)
    numbers = {
        "flat": rings.path_length(v), "slope": rings.path_length3(v), "area": rings.area(v), "round": rings.perimeter(v),
        "crossed": rings.crosses_itself(v), "change": last["z"] - first["z"], "fx": first["x"], "fy": first["y"], "fz": first["z"],
    }
    df = rings.settle(measures.withColumns(numbers), *numbers)
    lon, lat = grid_to_lonlat(F.col("fx"), F.col("fy"))
    place = F.concat(F.format_string("%.6f", lat), F.lit(", "), F.format_string("%.6f", lon))
    plane = F.concat(F.format_number(js_round(F.col("fx")), 0), F.lit(" E, "), F.format_number(js_round(F.col("fy")), 0), F.lit(" N ft"))
    row = lambda label, value: F.concat(F.lit(label + ": "), value)
    length, path = text.length_text, tool.isin("distance", "distance3d") & (n >= 2)
    flat, slope, change = F.col("flat"), F.col("slope"), F.col("change")
    plain = tool == "distance"
    surface = F.coalesce("surface", "area")
    topped = tool.isin("height", "location3d") & rise.isNotNull()
    top = F.col("fz") + rise
    cases = [
        (path & plain, [row("Distance", length(flat)), row("Along the slope", length(slope))]),
        (path & ~plain, [row("Distance 3D", length(slope)), row("Level distance", length(flat))]),
        (path, [row("Elevation change", F.concat(text.rise_text(change), F.lit(" from first to last point")))]),
        (path & (n == 2) & (flat > 0), [row("Slope", text.percent_text(F.abs(change) / F.nullif(flat, F.lit(0.0))))]),
        ((tool == "area") & (n >= 3), [row("Area", text.area_text(F.col("area"))), row("Perimeter", length(F.col("round")))]),
        ((tool == "area3d") & (n >= 3), [row("Surface area", text.area_text(surface)), row("Flat area", text.area_text(F.col("area"))),
                                         row("Steeper by", text.percent_text(F.coalesce(surface / F.nullif(F.col("area"), F.lit(0.0)) - 1, F.lit(0.0))))]),
        (tool == "surface", [row("Latitude, longitude", place), row("Ground elevation", length(F.col("fz"))), row("State Plane (EPSG:3089)", plane)]),
        (topped & (tool == "height"), [row("Height", length(rise)), row("Ground elevation", length(F.col("fz"))), row("Top elevation", length(top))]),
        (topped & (tool == "location3d"), [row("Latitude, longitude", place), row("Elevation", length(top)), row("Height above ground", length(rise)), row("State Plane (EPSG:3089)", plane)]),
    ]
    rows = F.array_compact(F.array(*[F.when(cond, value) for cond, values in cases for value in values]))
    off = F.concat(F.lit("The top was "), js_round(F.col("off_px")).cast("string"),
                   F.lit(" px to the side of the line straight up from the first point. Click straight above it for a truer height."))
    warnings = F.array_compact(
        F.array(
            F.when(F.exists("v", lambda p: F.coalesce(p["approximate"], F.lit(False))), APPROXIMATE),
            F.when(tool.isin("area", "area3d") & (n >= 3) & F.col("crossed"), CROSSED),
            F.when(topped & (F.col("off_px") > OFF_LINE_PX), off),
            F.when(topped & (rise < 0), BELOW),
        )
    )
    return df.select("meas_id", "tool", rows.alias("rows"), warnings.alias("warnings"))
