"""Which level and tiles of a photo to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
TILE_BUDGET, LEAST_TILES, VIEW_STEP = 40, 6, 0.002


def tile_range(offsets: Column, byte_counts: Column) -> tuple[Column, Column]:
    """First byte and end of a level's tiles."""
    return F.array_min(offsets), F.array_max(F.zip_with(offsets, byte_counts, lambda o, n: o + n))


def with_span(levels: DataFrame) -> DataFrame:
    start, end = tile_range(F.col("offsets"), F.col("byte_counts"))
    return levels.withColumns({"start": start, "end": end})


def picked_level(levels: DataFrame, box_w: float, box_h: float, ratio: float, max_bytes: int) -> DataFrame:
    """Per photo the smallest affordable level with enough pixels, else the largest affordable one, else the smallest."""
    shown = F.least(F.lit(float(box_w)), F.lit(float(box_h)) * (F.col("width") / F.col("height")))
    df = with_span(levels).withColumn("__ok", F.col("end") - F.col("start") <= max_bytes)
    enough = F.col("width") >= shown * ratio
    pick = lambda fn, cond: fn("level", F.when(cond, F.col("width")))
    out = df.groupBy("photo").agg(
        pick(F.min_by, F.col("__ok") & enough).alias("a"), pick(F.max_by, F.col("__ok")).alias("b"), F.min_by("level", "width").alias("c"),
        F.bool_or(F.col("__ok") & enough).alias("ha"), F.bool_or("__ok").alias("hb"), F.bool_or(enough & F.col("__ok")).alias("hc"),
    )
    return out.select("photo", F.when(F.col("ha"), F.col("a")).when(F.col("hb"), F.col("b")).otherwise(F.col("c")).alias("level"))


def level_by_long_side(levels: DataFrame, least: int = 1200, max_bytes: int = 12_000_000) -> DataFrame:
    """Per photo the smallest affordable level with a long enough side, else the largest affordable; none when none is."""
    df = with_span(levels).where(F.col("end") - F.col("start") <= max_bytes).withColumn("__long", F.greatest("width", "height"))
    out = df.groupBy("photo").agg(
        F.min_by("level", F.when(F.col("__long") >= least, F.col("__long"))).alias("a"), F.max_by("level", "__long").alias("b"),
        F.bool_or(F.col("__long") >= least).alias("h"),
    )
    return out.select("photo", F.when(F.col("h"), F.col("a")).otherwise(F.col("b")).alias("level"))


def ladder(levels: DataFrame) -> DataFrame:
    """A photo's handful of levels as one array, smallest first."""
    one = F.struct("width", "height", "tile_width", "tile_height", "level")
    return levels.groupBy("photo").agg(F.array_sort(F.collect_list(one)).alias("ladder"))


def planned_regions(regions: DataFrame, levels: DataFrame, max_tiles: Column | int = 30, max_side: int = 4096, tolerance: float = 0.9) -> DataFrame:
    """Level and tile rectangle to read for each region (photo, x0, y0, x1, y1 in full-size pixels, need).

    The smallest level with enough of the needed pixels, stepping down while that takes too many tiles or too wide a
    canvas; the smallest level always does. Empty regions have no row.
    """
    most = max_tiles if isinstance(max_tiles, Column) else F.lit(max_tiles)
    # A region takes far longer to plan than its bytes tell, so the tasks are a number that Spark does not put together by size.
    tasks = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda side: side.repartition(tasks, "photo")
    df = dealt(regions).join(ladder(dealt(levels)).hint("merge"), "photo")
    full = F.element_at("ladder", -1)
    df = df.withColumns({"fw": full["width"], "fh": full["height"]})
    zero = F.lit(0.0)
    df = df.withColumns(
        {"cx0": F.greatest(zero, "x0"), "cy0": F.greatest(zero, "y0"), "cx1": F.least("fw", "x1"), "cy1": F.least("fh", "y1")}
    ).where("cx1 > cx0 AND cy1 > cy0")
    enough = F.filter("ladder", lambda o: o["width"] / F.col("fw") >= F.col("need") * tolerance)
    start = F.coalesce(F.try_element_at(enough, F.lit(1))["width"], F.col("fw"))
    # Columns that the steps below read once for each level.
    df = df.withColumns({"__start": start, "__most": most, "__smallest": F.element_at("ladder", 1)["width"]})

    def scaled(lv: Column) -> Column:
        return F.struct(
            lv["width"].alias("width"), lv["level"].alias("level"), lv["height"].alias("height"), lv["tile_width"].alias("tw"), lv["tile_height"].alias("th"),
            (lv["width"] / F.col("fw")).alias("sx"), (lv["height"] / F.col("fh")).alias("sy"),
            F.ceil(lv["width"] / lv["tile_width"]).alias("across"), F.ceil(lv["height"] / lv["tile_height"]).alias("down"),
        )

    first = lambda v, s, t, n: F.least(n - 1, F.floor(F.col(v) * s / t))
    last = lambda v, s, t, n, a: F.least(n - 1, F.greatest(a, F.ceil(F.col(v) * s / t) - 1))
    starts = lambda o: o.withField("col0", first("cx0", o["sx"], o["tw"], o["across"])).withField("row0", first("cy0", o["sy"], o["th"], o["down"]))
    ends = lambda o: o.withField("col1", last("cx1", o["sx"], o["tw"], o["across"], o["col0"])).withField("row1", last("cy1", o["sy"], o["th"], o["down"], o["row0"]))

    def planned(o: Column) -> Column:
        x, y = o["col0"] * o["tw"], o["row0"] * o["th"]
        return F.struct(
            o["width"].alias("width"), o["level"].alias("level"), o["across"].alias("across"), *[o[c].alias(c) for c in ("col0", "col1", "row0", "row1")],
            x.alias("rect_x"), y.alias("rect_y"),
            (F.least((o["col1"] + 1) * o["tw"], o["width"]) - x).alias("rect_w"), (F.least((o["row1"] + 1) * o["th"], o["height"]) - y).alias("rect_h"),
            ((o["col1"] - o["col0"] + 1) * (o["row1"] - o["row0"] + 1)).alias("tiles"), o["sx"].alias("sx"), o["sy"].alias("sy"),
        )

    steps = "ladder"
    for step in (scaled, starts, ends, planned):
        steps = F.transform(steps, step)
    fits = lambda o: (o["tiles"] <= F.col("__most")) & (o["rect_w"] <= max_side) & (o["rect_h"] <= max_side)
    good = F.filter(steps, lambda o: (o["width"] <= F.col("__start")) & (fits(o) | (o["width"] == F.col("__smallest"))))
    # A struct led by the width: the greatest is the widest level that serves.
    df = df.withColumn("__p", F.array_max(good)).where("__p IS NOT NULL")
    names = ["level", "width", "across", "col0", "col1", "row0", "row1", "rect_x", "rect_y", "rect_w", "rect_h", "tiles", "sx", "sy"]
    return df.select(*regions.columns, *[F.col(f"__p.{c}").alias(c) for c in names])


def plan_tiles(plans: DataFrame, key: list[str]) -> DataFrame:
    """The tiles of each plan with their index in the level."""
    df = plans.withColumn("row", F.explode(F.sequence("row0", "row1"))).withColumn("col", F.explode(F.sequence("col0", "col1")))
    return df.select(*key, "level", "col", "row", (F.col("row") * F.col("across") + F.col("col")).alias("index"))


def byte_chunks(ranges: DataFrame, size: int, key: list[str]) -> DataFrame:
    """Ranges [start, end) cut into consecutive pieces of at most `size` bytes."""
    # A condition of the sequence, not a filter: Spark would move a filter below the ends and make what they come from twice.
    starts = F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1, F.lit(size).cast("long")))
    at = ranges.withColumn("__at", F.explode(starts))
    return at.select(*key, F.col("__at").alias("start"), F.least(F.col("__at") + size, F.col("end")).alias("end"))


def tile_shares(photos: DataFrame, view: list[str]) -> DataFrame:
    """Tiles each photo of a view may take of the shared budget."""
    return photos.groupBy(*view).agg(F.greatest(F.lit(LEAST_TILES), F.floor(F.lit(TILE_BUDGET) / F.greatest(F.lit(1), F.count("*")))).alias("per_frame"))


def shared_boxes(views: DataFrame, step: float = VIEW_STEP) -> DataFrame:
    """View boxes rounded outward so that nearby views share one."""
    down, up = (lambda c: F.floor(F.col(c) / step) * step), (lambda c: F.ceil(F.col(c) / step) * step)
    return views.withColumns({"west": down("west"), "south": down("south"), "east": up("east"), "north": up("north")})


def fit_inside(w: Column, h: Column, max_w: Column, max_h: Column) -> tuple[Column, Column]:
    """Size scaled down into a box, shape kept, never enlarged, at least one pixel."""
    scale = F.least(F.lit(1.0), max_w / w, max_h / h)
    size = lambda v: F.greatest(F.lit(1), F.floor(v * scale + 0.5))
    return size(w), size(h)
