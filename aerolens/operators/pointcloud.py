"""Point clouds: areas, tiles, octree nodes, points."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from aerolens.functions import quads, rings
from aerolens.functions.crs import (
    CONE, FALSE_EASTING_M, FALSE_NORTHING_M, FEET_PER_METRE, INVERSE_FLATTENING, ORIGIN_LON, ORIGIN_RADIUS, RADIUS_SCALE,
    grid_to_lonlat, lonlat_to_grid, lonlat_to_world,
)
from aerolens.functions.quads import distance
from aerolens.operators.gridjoin import boxes_meet, points_in_shapes
from aerolens.operators.skew import exact_quantiles, spread_join
from aerolens.session import staged


def lattice_world(points: DataFrame, x: str, y: str, cell: float = 250.0) -> DataFrame:
    """Unit-square position of grid points by blending the exact positions of a lattice's nodes.

    Every batch works out the nodes its own points touch, once each, so there is no table of nodes to build or ship.
    """
    schema = T.StructType([*points.schema.fields, T.StructField("wx", T.DoubleType()), T.StructField("wy", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) / cell
            v = batch.column(batch.schema.get_field_index(y)).to_numpy(zero_copy_only=False) / cell
            i, j = np.floor(u), np.floor(v)
            fu, fv = u - i, v - j
            wx, wy = np.zeros(len(u)), np.zeros(len(u))
            for di, dj, w in ((0, 0, (1 - fu) * (1 - fv)), (1, 0, fu * (1 - fv)), (0, 1, (1 - fu) * fv), (1, 1, fu * fv)):
                nodes, back = np.unique(np.stack([i + di, j + dj]), axis=1, return_inverse=True)
                nx, ny = _world(nodes[0] * cell, nodes[1] * cell)
                back = back.reshape(-1)
                wx += nx[back] * w
                wy += ny[back] * w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wx), pa.array(wy)], names=[*batch.schema.names, "wx", "wy"])

    return points.mapInArrow(place, schema)


def _world(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid feet to the unit square for arrays."""
    ecc = np.sqrt(2 / INVERSE_FLATTENING - 1 / INVERSE_FLATTENING**2)
    east = x / FEET_PER_METRE - FALSE_EASTING_M
    south = ORIGIN_RADIUS + FALSE_NORTHING_M - y / FEET_PER_METRE
    iso = (np.hypot(east, south) / RADIUS_SCALE) ** (1 / CONE)
    phi = np.pi / 2 - 2 * np.arctan(iso)
    for _ in range(6):
        phi = np.pi / 2 - 2 * np.arctan(iso * np.exp(-ecc * np.arctanh(ecc * np.sin(phi))))
    lon = np.degrees(np.arctan2(east, south) / CONE) + ORIGIN_LON
    return (lon + 180) / 360, 0.5 - np.arctanh(np.sin(phi)) / (2 * np.pi)


# Limits of one load, and how a view is refined.
SQ_FT_PER_SQ_MI = 5280.0**2
MAX_AREA_SQ_MI, MAX_TILES, SAMPLES = 4.0, 24, 24
MAX_POINTS, MAX_BYTES = 4_000_000, 32 * 1024 * 1024
MAX_HELD, MIN_ROOM = 12_000_000, 50_000
TARGET_PX, SCREEN_MARGIN = 3.0, 0.15
RAMP = [[68, 1, 84], [59, 82, 139], [33, 145, 140], [94, 201, 98], [253, 231, 37]]
BOX = ("xmin", "ymin", "xmax", "ymax")
AREA_BOX = ("ax0", "ay0", "ax1", "ay1")


def grid_areas(areas: DataFrame) -> DataFrame:
    """Areas of interest (area_id, ring in degrees) with their outline on the grid, its box and size."""

    def place(p: Column) -> Column:
        x, y = lonlat_to_grid(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    df = rings.settle(areas.withColumn("grid", F.transform("ring", place)), "grid")
    x0, y0, x1, y1 = rings.box(F.col("grid"))
    return df.withColumns({"ax0": x0, "ay0": y0, "ax1": x1, "ay1": y1, "sq_mi": rings.area(F.col("grid")) / SQ_FT_PER_SQ_MI})


def within_limit(areas: DataFrame, max_sq_mi: float = MAX_AREA_SQ_MI) -> DataFrame:
    """Areas above the limit shrunk about the mean of their vertices to exactly the limit; `limited` tells which."""
    df = grid_areas(areas)
    n = F.size("grid")
    df = df.withColumns(
        {
            "__mx": rings.total(rings.x_of(F.col("grid")), lambda v: v) / n,
            "__my": rings.total(rings.y_of(F.col("grid")), lambda v: v) / n,
            "limited": F.col("sq_mi") > max_sq_mi,
            "__f": F.sqrt(F.lit(max_sq_mi) / F.col("sq_mi")),
        }
    )
    df = rings.settle(df, "__mx", "__my", "__f")

    def shrink(p: Column) -> Column:
        lon, lat = grid_to_lonlat(F.col("__mx") + (p["x"] - F.col("__mx")) * F.col("__f"), F.col("__my") + (p["y"] - F.col("__my")) * F.col("__f"))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    ring = F.when(F.col("limited"), F.transform("grid", shrink)).otherwise(F.col("ring"))
    return df.select("area_id", ring.alias("ring"), "limited")


def area_geojson(ring: Column) -> Column:
    """The area as GeoJSON polygon text, ring closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")))


def area_samples(areas: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Cell centres of an n by n grid over each area's box that lie inside the area."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    df = areas.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    at = lambda k, lo, hi: F.col(lo) + (F.col(k) + 0.5) / n * (F.col(hi) - F.col(lo))
    df = rings.settle(df.withColumns({"sx": at("i", "ax0", "ax1"), "sy": at("j", "ay0", "ay1")}), "sx", "sy")
    return df.where(rings.inside(F.col("grid"), F.col("sx"), F.col("sy"))).select("area_id", "i", "j", "sx", "sy")


def over_areas(boxes: DataFrame, areas: DataFrame, box_id: list[str], cell: float = 6000.0) -> DataFrame:
    """Pairs of a box and an area of interest that share ground."""
    meet = boxes_meet(boxes, areas.select("area_id", "grid", *AREA_BOX), box_id, ["area_id"], BOX, AREA_BOX, cell=cell)
    return meet.where(rings.box_touches(F.col("grid"), *[F.col(c) for c in BOX])).drop("grid")


def tiles_for_areas(tiles: DataFrame, areas: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Tiles to load per area: the newest phase that touches it, and older ones only where they cover what that leaves open.

    `tiles` has tile_id, phase and a box. `refused` marks areas that need more tiles than one load may read.
    """
    touching = over_areas(tiles, areas, ["tile_id", "phase"]).select("area_id", "tile_id", "phase", *BOX)
    touching = staged(touching)
    samples = area_samples(areas, n)
    # An area has hundreds of samples, which Spark's sizes leave out: none of these tables may be gathered in the driver.
    hits = samples.join(touching.hint("merge"), "area_id").where(
        F.col("sx").between(F.col("xmin"), F.col("xmax")) & F.col("sy").between(F.col("ymin"), F.col("ymax"))
    )
    newest = F.lit(3)
    place = ["area_id", "i", "j"]
    covered = hits.where(F.col("phase") == newest).select(*place).distinct()
    filling = hits.where(F.col("phase") < newest).join(covered.hint("merge"), place, "left_anti").select("area_id", "tile_id", "phase").distinct()
    chosen = touching.where(F.col("phase") == newest).select("area_id", "tile_id", "phase").unionByName(filling)
    count = chosen.groupBy("area_id").agg(F.count("*").alias("__n"))
    return chosen.join(count.hint("merge"), "area_id").select("area_id", "tile_id", "phase", (F.col("__n") > MAX_TILES).alias("refused"))


def with_node_boxes(nodes: DataFrame) -> DataFrame:
    """Footprint and point spacing of octree nodes from their key and their file's cube."""
    part = lambda i: F.split_part("key", F.lit("-"), F.lit(i)).cast("int")
    size = F.col("cube_size") / F.pow(F.lit(2.0), part(1))
    return nodes.withColumns(
        {
            "xmin": F.col("cube_xmin") + part(2) * size, "ymin": F.col("cube_ymin") + part(3) * size,
            "xmax": F.col("cube_xmin") + (part(2) + 1) * size, "ymax": F.col("cube_ymin") + (part(3) + 1) * size,
            "spacing_ft": F.col("spacing") / F.pow(F.lit(2.0), part(1)),
        }
    )


NODE = ["file", "key"]


def nodes_over_areas(nodes: DataFrame, areas: DataFrame) -> DataFrame:
    """Nodes that hold points and share ground with an area, one row per pair, with the share its box covers."""
    slim = nodes.where(F.col("count") > 0).select("file", "key", "depth", "count", "length", "spacing_ft", *BOX)
    pairs = over_areas(slim, areas, NODE)
    share = rings.covered_share(tuple(F.col(c) for c in BOX), tuple(F.col(c) for c in AREA_BOX))
    return pairs.withColumn("share", share).drop(*AREA_BOX)


def depth_under_budget(pairs: DataFrame, max_points: float = MAX_POINTS, max_bytes: float = MAX_BYTES) -> DataFrame:
    """Per area the deepest level whose total from the top fits the budget; level 0 always, `over` when it does not fit.

    A level without nodes costs nothing, so the answer is one above the first level that does not fit.
    """
    cost = F.col("count") * F.col("share")
    per = pairs.groupBy("area_id", "depth").agg(F.sum(cost).alias("p"), F.sum("length").alias("b"))
    w = Window.partitionBy("area_id").orderBy("depth")
    upto = per.withColumns({"pp": F.sum("p").over(w), "bb": F.sum("b").over(w)})
    bad = (F.col("pp") > max_points) | (F.col("bb") > max_bytes)
    ends = upto.groupBy("area_id").agg(
        F.max("depth").alias("deepest"),
        F.min(F.when(bad & (F.col("depth") > 0), F.col("depth"))).alias("__stop"),
        F.coalesce(F.bool_or(F.when(F.col("depth") == 0, bad)), F.lit(False)).alias("over"),
    )
    ends = ends.select("area_id", "deepest", "over", F.when(F.col("over"), F.lit(0)).otherwise(F.coalesce(F.col("__stop") - 1, F.col("deepest"))).alias("chosen"))
    inside = F.col("depth") <= F.col("chosen")
    return upto.join(ends, "area_id").groupBy("area_id", F.col("chosen"), "deepest", "over").agg(
        F.floor(F.coalesce(F.sum(F.when(inside, F.col("p"))), F.lit(0.0)) + 0.5).alias("points"),
        F.coalesce(F.sum(F.when(inside, F.col("b"))), F.lit(0)).alias("bytes"),
    )


def selected_nodes(pairs: DataFrame, plan: DataFrame) -> DataFrame:
    """The nodes the plan reads."""
    return pairs.join(plan.select("area_id", "chosen"), "area_id").where(F.col("depth") <= F.col("chosen")).drop("chosen")


def placed_on_screen(nodes: DataFrame) -> DataFrame:
    """Screen size, middle and visibility of node boxes under a view's map sx = (a x + b y + c) / w, w = 1 + g y.

    Rows carry the map (pa, pb, pc, qa, qb, qc, pg) and the screen (sw, sh). Nodes beyond the horizon are left out.
    """

    def project(x: Column, y: Column) -> tuple[Column, Column]:
        w = 1 + F.col("pg") * y
        w = F.when(w > 0, w)
        return (F.col("pa") * x + F.col("pb") * y + F.col("pc")) / w, (F.col("qa") * x + F.col("qb") * y + F.col("qc")) / w

    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    names = {}
    for n, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]):
        sx, sy = project(x, y)
        names.update({f"__x{n}": sx, f"__y{n}": sy})
    df = nodes.withColumns(names).where(" AND ".join(f"__x{n} IS NOT NULL" for n in range(4)))
    at = [(F.col(f"__x{n}"), F.col(f"__y{n}")) for n in range(4)]
    xs, ys = [a[0] for a in at], [a[1] for a in at]
    side = F.greatest(*[distance(*at[n], *at[(n + 1) % 4]) for n in range(4)])
    mx, my = F.col("sw") * SCREEN_MARGIN, F.col("sh") * SCREEN_MARGIN
    on = rings.overlap_strict((F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)), (-mx, -my, F.col("sw") + mx, F.col("sh") + my))
    return df.withColumns(
        {
            "side": side, "centre_x": (F.least(*xs) + F.greatest(*xs)) / 2, "centre_y": (F.least(*ys) + F.greatest(*ys)) / 2, "on_screen": on,
        }
    ).drop(*names)


def fine_enough(target_px: float = TARGET_PX) -> Column:
    """Whether the level above a node would have its points further apart on the screen than the target."""
    return F.col("side") * 2 * (F.col("spacing_ft") / (F.col("xmax") - F.col("xmin"))) > target_px


def from_middle() -> Column:
    return distance(F.col("centre_x"), F.col("centre_y"), F.col("sw") / 2, F.col("sh") / 2)


def nodes_for_views(placed: DataFrame, read: DataFrame, max_points: float = MAX_POINTS, max_bytes: float = MAX_BYTES, band_px: float = 64.0) -> DataFrame:
    """The nodes to add for each view: visible, fine enough, not read; coarse first, then nearest the middle; as many as fit.

    Totals are first taken per level and band of distance, so only bands of a view are put in one order, and nodes only
    within their band.
    """
    want = placed.where(F.col("on_screen") & fine_enough()).join(read, ["view_id", *NODE], "left_anti")
    want = want.withColumns({"distance": from_middle(), "__p": F.col("count") * F.col("share")})
    want = want.withColumn("__band", F.floor(F.col("distance") / band_px))
    bands = want.groupBy("view_id", "depth", "__band").agg(F.sum("__p").alias("p"), F.sum("length").alias("b"), F.count("*").alias("n"))
    before = Window.partitionBy("view_id").orderBy("depth", "__band").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bands = bands.select("view_id", "depth", "__band", prior("p").alias("__p0"), prior("b").alias("__b0"), prior("n").alias("__n0"))
    w = Window.partitionBy("view_id", "depth", "__band").orderBy("distance", *NODE).rowsBetween(Window.unboundedPreceding, 0)
    rows = want.join(bands, ["view_id", "depth", "__band"])
    rows = rows.withColumns(
        {"points_upto": F.col("__p0") + F.sum("__p").over(w), "bytes_upto": F.col("__b0") + F.sum("length").over(w), "place": F.col("__n0") + F.count("*").over(w)}
    )
    fits = (F.col("points_upto") <= max_points) & (F.col("bytes_upto") <= max_bytes)
    return rows.where((F.col("place") == 1) | fits).select("view_id", "place", *NODE, "depth", "distance", "points_upto", "bytes_upto")


def clipped_points(points: DataFrame, areas: DataFrame, cell: float = 6000.0) -> DataFrame:
    """The points (file, key, x, y, z) inside each area, placed in the unit square relative to the area's middle."""
    inside = rings.inside(F.col("grid"), F.col("x"), F.col("y"))
    shapes = areas.select("area_id", "grid", *AREA_BOX)
    kept = points_in_shapes(points, shapes, ["file", "key", "x", "y", "z"], ["area_id"], inside, at=("x", "y"), box=AREA_BOX, cell=cell, levels=(0, 2, 4))
    wx, wy = lonlat_to_world(*grid_to_lonlat(F.col("x"), F.col("y")))
    ox, oy = lonlat_to_world(*grid_to_lonlat((F.col("ax0") + F.col("ax1")) / 2, (F.col("ay0") + F.col("ay1")) / 2))
    return kept.select("area_id", "file", "key", "x", "y", "z", (wx - ox).alias("east"), (wy - oy).alias("south"))


def chunk_sizes(clipped: DataFrame) -> DataFrame:
    """Points and height range of each clipped node."""
    return clipped.groupBy("area_id", *NODE).agg(F.count("*").alias("count"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def _finest(points: DataFrame, cell: float, each: int, deepest: int = 12) -> int:
    """How often a cell is halved until it holds about `each` points where they lie evenly."""
    n, x0, y0, x1, y1 = points.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n or x1 <= x0 or y1 <= y0:
        return 0
    side = math.sqrt(each * (x1 - x0) * (y1 - y0) / n)
    return max(0, min(deepest, round(math.log2(cell / side))))


def _cells_of(x: np.ndarray, y: np.ndarray, cell: float, finest: int) -> list[np.ndarray]:
    """Level, column, row and whether it is whole of the cells under one outline; cells that an edge comes into are quartered."""
    ax, ay, bx, by = x, y, np.roll(x, -1), np.roll(y, -1)
    cols, rows = (np.arange(np.floor(v.min() / cell), np.floor(v.max() / cell) + 1) for v in (x, y))
    cx, cy = (v.ravel() for v in np.meshgrid(cols, rows))
    found = []
    for lv in range(finest + 1):
        size = cell / 2**lv
        mx, my = (cx + 0.5) * size, (cy + 0.5) * size
        half = size / 2 + 1e-6  # a little wider, so that rounding never misses an edge
        cut, odd = np.zeros(len(cx), bool), np.zeros(len(cx), bool)
        for x0, y0, x1, y1 in zip(ax, ay, bx, by):
            turn = (x1 - x0) * (my - y0) - (mx - x0) * (y1 - y0)
            near = (min(x0, x1) <= mx + half) & (max(x0, x1) >= mx - half) & (min(y0, y1) <= my + half) & (max(y0, y1) >= my - half)
            cut |= near & (np.abs(turn) <= half * (abs(x1 - x0) + abs(y1 - y0)))
            odd ^= ((y0 <= my) & (y1 > my) & (turn > 0)) | ((y0 > my) & (y1 <= my) & (turn < 0))
        whole = odd & ~cut
        done = whole | cut if lv == finest else whole
        found.append(np.stack([np.full(done.sum(), lv), cx[done], cy[done], whole[done]]))
        cx, cy = (np.repeat(v[cut] * 2, 4) + np.tile(step, cut.sum()) for v, step in ((cx, [0, 1, 0, 1]), (cy, [0, 0, 1, 1])))
    return list(np.concatenate(found, axis=1).astype(np.int64))


def area_cells(areas: DataFrame, cell: float, finest: int) -> DataFrame:
    """Square cells under each area (lv, cx, cy): large ones wholly inside it, and those of the finest level on its outline.

    A cell that an edge comes into is quartered, down to the finest level; one without edges is inside or outside as its
    middle is. So an area has about as many cells as its outline is long, whatever its ground.
    """
    known = areas.select("area_id", "grid", *AREA_BOX).where(" AND ".join(f"{c} IS NOT NULL" for c in AREA_BOX))
    fields = ["lv", "cx", "cy", "whole"]
    schema = T.StructType([*known.schema.fields, T.StructField("cells", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in fields])))])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                cells = []
                for ring in some.column(some.schema.get_field_index("grid")):
                    corners = ring.values
                    cells.append(_cells_of(*(corners.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y")), cell, finest))
                ends = np.cumsum([0, *[len(c[0]) for c in cells]]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(v)) for v in zip(*cells)], fields)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(pa.array(ends), rows)], names=schema.names)

    # An area becomes up to some thousands of rows, of which the size of the table says little.
    dealt = known.repartition(max(1, math.ceil(known.count() / 500)))
    out = dealt.mapInArrow(cover, schema).select(*known.columns, F.inline("cells"))
    return out.withColumn("whole", F.col("whole") == 1)


def clipped_parts(points: DataFrame, areas: DataFrame, cell: float = 6000.0, each: int = 8) -> DataFrame:
    """What of the points (file, key, x, y, z) lies inside each area, in parts: (area_id, file, key, count, z_min, z_max).

    The points of a cell wholly inside an area are one part for each node, counted once for all areas; only those of cells on
    its outline meet it one by one. Every pair that `clipped_points` names is counted in exactly one part.
    """
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    points = points.where(finite("x") & finite("y"))
    finest = _finest(points, cell, each)
    size = cell / 2**finest
    points = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    cells = staged(area_cells(areas, cell, finest))
    held = staged(points.groupBy("file", "key", "cx", "cy").agg(F.count("*").alias("count"), F.min("z").alias("z_min"), F.max("z").alias("z_max")))
    up = F.explode(F.sequence(F.lit(0), F.lit(finest)))
    coarser = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(finest) - F.col("lv"))).alias(c)
    sums = held.select("*", up.alias("lv")).groupBy("file", "key", "lv", coarser("cx"), coarser("cy")).agg(
        F.sum("count").alias("count"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max")
    )
    place = ["cx", "cy"]
    whole = spread_join(cells.where("whole").select("area_id", "lv", *place), sums, ["lv", *place], ["area_id"], NODE)
    x, y = F.col("x"), F.col("y")
    hit = x.between(F.col("ax0"), F.col("ax1")) & y.between(F.col("ay0"), F.col("ay1")) & rings.inside(F.col("grid"), x, y)
    part = spread_join(cells.where("NOT whole").drop("lv", "whole"), points, place, ["area_id"], [*NODE, "x", "y", "z"], hit)
    names = ["area_id", *NODE, "count", "z_min", "z_max"]
    return whole.select(*names).unionByName(part.select("area_id", *NODE, F.lit(1).cast("long").alias("count"), F.col("z").alias("z_min"), F.col("z").alias("z_max")))


def clipped_chunks(points: DataFrame, areas: DataFrame, cell: float = 6000.0, each: int = 8) -> DataFrame:
    """`chunk_sizes` of the clipped points without a row for every point and area."""
    parts = clipped_parts(points, areas, cell, each)
    return parts.groupBy("area_id", *NODE).agg(F.sum("count").alias("count"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"))


def height_ranges(points: DataFrame, keys: Sequence[str], clip: float = 0.02) -> DataFrame:
    """Heights a colour ramp should span: the lower-index quantiles clip and 1 - clip, widened by a foot when equal."""
    q = exact_quantiles(points, keys, "z", {"lo": clip, "hi": 1 - clip}, interpolate=False)
    return q.select(*keys, "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))


def stride_sample(numbered: DataFrame, count: str = "count", index: str = "index", about: int = 400) -> DataFrame:
    """About 400 evenly spaced points of each block: those whose index in the block is a multiple of its stride."""
    stride = F.greatest(F.lit(1), F.floor(F.col(count) / about))
    return numbered.where(F.col(index) % stride == 0)


def ramp_colour(t: Column) -> list[Column]:
    """Red, green and blue of a height fraction on the five-stop ramp; out of range is clamped, not-a-number is lowest."""
    x = F.least(F.greatest(F.when(~F.isnan(t) & (F.abs(t) < float("inf")), t).otherwise(0.0), F.lit(0.0)), F.lit(1.0)) * (len(RAMP) - 1)
    i = F.least(F.floor(x), F.lit(len(RAMP) - 2)).cast("int")
    out = []
    for band in range(3):
        stops = F.array(*[F.lit(float(c[band])) for c in RAMP])
        a, b = F.element_at(stops, i + 1), F.element_at(stops, i + 2)
        out.append(a + (b - a) * (x - i))
    return out


def evictions(held: DataFrame, need: DataFrame) -> DataFrame:
    """Blocks to drop so that each view's new block fits, off-screen ones farthest first: (view, block, feasible).

    `held` has view_id, block, count, distance (NULL beyond the horizon, dropped first), on_screen, keep; it never holds
    more than the map's own cap. `need` has view_id and the points to free.
    """
    free = held.where(~F.col("on_screen") & ~F.col("keep")).join(need, "view_id").where(F.col("need") > 0)
    w = Window.partitionBy("view_id").orderBy(F.desc_nulls_first("distance"), "block")
    total = F.sum("count").over(Window.partitionBy("view_id"))
    before = F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = free.withColumns({"__before": before, "feasible": total >= F.col("need")})
    return rows.where(F.col("__before") < F.col("need")).select("view_id", "block", "feasible")


def room_budget(held: Column, max_points: float = MAX_POINTS, cap: float = MAX_HELD) -> tuple[Column, Column]:
    """(points a load may add, whether there is room for one)."""
    room = F.lit(cap) - held
    return F.least(room, F.lit(max_points)), room >= MIN_ROOM


def load_summary(plan: DataFrame, tiles: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per area: tiles by phase, depth, points and bytes of its load."""
    t = tiles.groupBy("area_id").agg(F.count_if(F.col("phase") == 3).alias("phase3"), F.count_if(F.col("phase") == 2).alias("phase2"))
    c = chunks.groupBy("area_id").agg(F.sum("count").alias("loaded"))
    out = plan.join(t, "area_id", "left").join(c, "area_id", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return out.select("area_id", zero("phase3"), zero("phase2"), F.col("chosen").alias("depth"), "deepest", zero("loaded"), "bytes", "over")
