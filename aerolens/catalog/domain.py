"""Survey tables as deterministic projections of the driver's parquet tables.

All positions are whole feet and all outlines whole offsets, so both engines hold exactly the same geometry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.functions.angles import full_turn, half_turn
from aerolens.functions.camera import with_rotation
from aerolens.operators.select import with_outline_terms
from aerolens.session import stored

CAMERAS = ["Color", "Fwd", "Bwd", "Left", "Right"]
IMAGE_BASE = "https://images.example/frames/"
FOLDER_PREFIX, FOLDER_SUFFIX = "SURVEY_", "_3IN"


#: Rows of a source table that one task makes derived rows from. Source files are small for what is derived from a row of
#: them, so that the size of a split says little about the work in it.
ROWS_EACH = 50_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str, *columns: str, each: int = ROWS_EACH) -> DataFrame:
    """Columns of a source table, dealt to so many tasks that each has at most about `each` rows."""
    rows = table(spark, sf, name).select(*columns)
    tasks = math.ceil(rows.count() / each)
    return rows.repartition(tasks) if tasks > 1 else rows


def pick(index: Column, *values) -> Column:
    """The value at a small zero-based index."""
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(index == i, F.lit(values[i])).otherwise(out)
    return out


def idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def _clock(seconds: Column) -> Column:
    part = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", part(idiv(seconds, 3600)), part(idiv(seconds, 60) % 60), part(seconds % 60))


def exposures(spark: SparkSession, sf: str) -> DataFrame:
    """One row per frame key with everything its columns are made of."""
    df = spread(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    df = df.withColumns({"e": idiv(k, 5), "cam": (k % 5).cast("int")})
    df = df.withColumns({"i": idiv(F.col("e"), 60), "j": F.col("e") % 60})
    i, j, cam = F.col("i"), F.col("j"), F.col("cam")
    reflight = (i % 10 == 3) & (j >= 30)
    df = df.withColumns(
        {
            "reflown": reflight,
            "heading": F.when(i % 2 == 0, 180).otherwise(0),
            "x": (4905000 + (i % 50) * 1200).cast("double"),
            "y": (3950000 + idiv(i, 50) * 43000 + F.when(i % 2 == 0, 59 - j).otherwise(j) * 700).cast("double"),
            "z": (5500 + (k * 37) % 31 - 15 + F.when(F.col("e") % 7 == 0, 9000).otherwise(0)).cast("double"),
            "shot": 40000 + j + F.when(j >= 20, 7).otherwise(0) + F.when(j >= 21, 7).otherwise(0)
            + F.when(reflight, 100000).otherwise(0),
            "fl": (7001 + i).cast("string"),
            "season": (1 + idiv(i, 10) % 2).cast("int"),
            "camera": pick(cam, *CAMERAS),
        }
    )
    df = df.withColumns(
        {
            "season_key": F.concat(F.lit("2024_Season"), F.col("season").cast("string")),
            "base_look": F.when(cam != 0, (F.col("heading") + pick(cam, 0, 0, 180, 270, 90)) % 360),
            "seconds": (43200 + (i % 20) * 1200 + idiv(j * 7, 2)).cast("long"),
            "flight_date": F.when(F.col("reflown"), F.lit("2024-03-26")).otherwise(F.lit("2024-03-19")).cast("date"),
        }
    )
    look = F.col("base_look")
    wobble = ((k * 17) % 9 - 4).cast("double") / 10 + F.when(k % 997 == 0, 40.0).otherwise(0.0)
    small = lambda v: v.cast("double") / 10
    shot_id = F.concat_ws(
        "_", F.col("camera"), F.when(i % 4 == 1, F.lit("20240319")), F.col("fl"), F.col("shot").cast("string")
    )
    return df.withColumns(
        {
            "kappa": F.when(cam == 0, ((k * 13) % 7 - 3).cast("double") / 2).otherwise(half_turn(-(look + wobble))),
            "omega": F.when(cam == 0, small(k % 3 - 1)).otherwise(
                F.when(look == 0, 45.0).when(look == 180, -45.0).otherwise(0.0) + small(k % 7 - 3)
            ),
            "phi": F.when(cam == 0, small((k * 7) % 3 - 1)).otherwise(
                F.when(look == 90, -45.0).when(look == 270, 45.0).otherwise(0.0) + small((k * 3) % 7 - 3)
            ),
            "shot_id": shot_id,
            "filename": F.concat(
                F.lit(FOLDER_PREFIX), F.col("season_key"), F.lit(FOLDER_SUFFIX + "/"), shot_id, F.lit(".tif")
            ),
        }
    )


def _lens(cam: Column) -> dict[str, Column]:
    side = cam >= 3
    return {
        "cam_name": F.concat(F.lit("Lens_"), pick(cam, *CAMERAS)),
        "cam_width_px": F.when(cam == 0, 20544).when(side, 10560).otherwise(14144),
        "cam_height_px": F.when(cam == 0, 14016).when(side, 14144).otherwise(10560),
        "cam_focal_mm": F.when(cam == 0, 79.6).otherwise(123.38),
        "cam_ccd_res_u": F.lit(3.76),
        "cam_ppx_mm": F.lit(0.0),
        "cam_ppy_mm": F.when(side, 6.68).otherwise(0.0),
        "cam_omega_dg": F.lit(0.0),
        "cam_phi_dg": F.lit(0.0),
        "cam_kappa_dg": F.lit(0.0),
    }


def _outline() -> dict[str, Column]:
    """Corner columns in photo order: far left, far right, near right, near left."""
    look, k = F.col("base_look"), F.col("k")
    ux = F.when(look == 90, 1).when(look == 270, -1).otherwise(0)
    uy = F.when(look == 0, 1).when(look == 180, -1).otherwise(0)
    nadir = F.col("cam") == 0
    out = {}
    for n, (ahead, right) in enumerate([(7500, -2600), (7500, 2600), (3000, 1500), (3000, -1500)]):
        dx = F.when(nadir, 2000 if n in (1, 2) else -2000).otherwise(ux * ahead + uy * right)
        dy = F.when(nadir, 2000 if n in (0, 1) else -2000).otherwise(uy * ahead - ux * right)
        out[f"x{n}"] = F.col("x") + dx.cast("double")
        out[f"y{n}"] = F.col("y") + dy.cast("double")
        out[f"z{n}"] = (500 + (k * 7 + n * 13) % 41).cast("double")
    return out


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frame table as ingest leaves it: with outline terms and rotation, written once and read back."""
    make = lambda: with_rotation(with_outline_terms(stored(spark, f"frame_rows|{sf}", lambda: frame_rows(spark, sf))))
    return stored(spark, f"frames|{sf}", make)


def frame_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of the frame table."""
    df = exposures(spark, sf)
    prefix = idiv(F.col("shot"), 100000)
    heading = F.when(F.col("j") != 20, F.col("heading").cast("double"))
    look = F.when(F.col("cam") != 0, full_turn(-F.col("kappa")))
    offset = pick(F.col("cam"), 0.0, 0.0, 180.0, -90.0, 90.0)
    err = F.when(F.col("cam") != 0, half_turn(look - (heading + offset)))
    midnight = F.col("flight_date").cast("timestamp_ntz")
    df = df.withColumns(
        {
            "year": F.lit(2024),
            "exposure_id": F.concat_ws("/", "season_key", "fl", F.col("shot").cast("string")),
            "pass_id": F.concat_ws("/", "season_key", "fl", F.col("flight_date").cast("string"), prefix.cast("string")),
            "shot_prefix": prefix,
            "is_reflight": F.col("reflown"),
            "flight_time_local": _clock(F.col("seconds")),
            "tz_label": F.lit("EDT (-4)"),
            "ts_utc": midnight + F.make_dt_interval(F.lit(0), F.lit(4), F.lit(0), F.col("seconds").cast("decimal(18,6)")),
            "look_azimuth_deg": look,
            "track_heading_deg": heading,
            "kappa_err_deg": err,
            "kappa_flag": F.abs(err) > 10,
            "dup_count": F.when(F.col("k") % 611 == 0, 2).otherwise(1),
            **_lens(F.col("cam")),
            **_outline(),
        }
    )
    return df.select(*FRAME_COLUMNS, "k", "cam", "i", "j")


FRAME_COLUMNS = (
    "filename season_key year season fl shot camera exposure_id pass_id shot_prefix is_reflight flight_date "
    "flight_time_local tz_label ts_utc x y z omega phi kappa look_azimuth_deg track_heading_deg kappa_err_deg kappa_flag "
    "dup_count cam_name cam_width_px cam_height_px cam_focal_mm cam_ccd_res_u cam_ppx_mm cam_ppy_mm cam_omega_dg "
    "cam_phi_dg cam_kappa_dg x0 y0 z0 x1 y1 z1 x2 y2 z2 x3 y3 z3"
).split()


def _with_copies(df: DataFrame) -> DataFrame:
    """Every frame, and a second solution of every 611th one with its own fid."""
    copies = df.where(F.col("k") % 611 == 0).withColumns({"fid": F.col("k") + 1000000000, "shift": F.lit(0.4)})
    return df.withColumns({"fid": F.col("k"), "shift": F.lit(0.0)}).unionByName(copies)


def raw_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor frame rows. The outline is already decoded into corner columns."""
    df = _with_copies(exposures(spark, sf)).withColumns(_outline())
    return df.select(
        "season_key",
        F.col("fid").alias("rn"),
        F.col("filename").alias("Filename"),
        F.col("flight_date").alias("FlightDate"),
        _clock(F.col("seconds")).alias("FlightTime"),
        F.lit("EDT (-4)").alias("TimeZone"),
        F.col("fl").alias("FL"),
        F.col("shot_id").alias("ShotID"),
        F.col("camera").alias("CameraID"),
        F.lit(2024).alias("Year"),
        F.col("season").alias("Season"),
        F.concat(F.lit(IMAGE_BASE), F.col("filename")).alias("S3URL"),
        *[f"{a}{n}" for n in range(4) for a in "xyz"],
    )


def raw_eo(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor orientation rows, paired with frame rows by fid."""
    df = _with_copies(exposures(spark, sf))
    lens = _lens(F.col("cam"))
    return df.select(
        "season_key",
        "fid",
        F.regexp_replace("filename", r"\.tif$", "").alias("ID"),
        (F.col("x") + F.col("shift")).alias("X"),
        F.col("y").alias("Y"),
        F.col("z").alias("Z"),
        F.col("omega").alias("Omega"),
        F.col("phi").alias("Phi"),
        F.col("kappa").alias("Kappa"),
        F.col("flight_date").alias("eo_date"),
        _clock(F.col("seconds") + 14400).alias("eo_time"),
        lens["cam_name"].alias("CamName"),
        lens["cam_width_px"].alias("CamWidthPx"),
        lens["cam_height_px"].alias("CamHeighPx"),
        lens["cam_focal_mm"].alias("CamFocalMm"),
        lens["cam_ccd_res_u"].alias("CamCCDResU"),
        lens["cam_ppx_mm"].alias("CamPpxMm"),
        lens["cam_ppy_mm"].alias("CamPpyMm"),
        lens["cam_omega_dg"].alias("CamOmegaDg"),
        lens["cam_phi_dg"].alias("CamPhiDg"),
        lens["cam_kappa_dg"].alias("CamKappaDg"),
    )


def raw_frames_faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor frame rows with faults of every kind the rules look for."""
    rn = F.col("rn")
    hit = lambda m: rn % m == m - 1
    return (
        raw_frames(spark, sf)
        .where(~hit(601))
        .withColumns(
            {
                "S3URL": F.when(hit(211), F.concat("S3URL", F.lit("?v=1"))).when(hit(223), None).otherwise(F.col("S3URL")),
                "Filename": F.when(hit(307), F.concat(F.lit("x"), "Filename")).otherwise(F.col("Filename")),
                "CameraID": F.when(hit(401), "Top").when(hit(409), None).otherwise(F.col("CameraID")),
                "ShotID": F.when(hit(503), F.concat("ShotID", F.lit("b"))).otherwise(F.col("ShotID")),
                "TimeZone": F.when(hit(433), "EDT").otherwise(F.col("TimeZone")),
                "FlightTime": F.when(hit(439), "25:61:00").when(hit(443), None).otherwise(F.col("FlightTime")),
                "FlightDate": F.when(hit(449), None).otherwise(F.col("FlightDate")),
                "season_key": F.when(hit(1201), "2023_Season9").otherwise(F.col("season_key")),
            }
        )
    )


def raw_eo_faulty(spark: SparkSession, sf: str) -> DataFrame:
    fid = F.col("fid")
    return (
        raw_eo(spark, sf)
        .where(fid % 607 != 606)
        .withColumns(
            {
                "ID": F.when(fid % 613 == 612, F.concat("ID", F.lit("_x"))).when(fid % 617 == 616, None).otherwise(F.col("ID")),
                "eo_time": F.when(fid % 619 == 618, "00:00:01").otherwise(F.col("eo_time")),
            }
        )
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Places to look up, with the direction wanted (NULL looks straight down)."""
    c = F.col("c_custkey")
    return spread(spark, sf, "customer", "c_custkey").select(
        c.alias("point_id"),
        (4905000 + (c * 7919) % 59000).cast("double").alias("px"),
        (3950000 + idiv(c, 1500) * 43000 + (c * 104729) % 42000).cast("double").alias("py"),
        F.when(c % 5 != 4, ((c % 4) * 90).cast("double")).alias("want_azimuth"),
    )


def places(spark: SparkSession, sf: str) -> DataFrame:
    """The same idea in degrees."""
    c = F.col("c_custkey")
    return spread(spark, sf, "customer", "c_custkey").select(
        c.alias("point_id"),
        (F.lit(-85.8065) + ((c * 7919) % 20000).cast("double") / 100000).alias("lon"),
        (F.lit(38.171) + idiv(c, 1500).cast("double") * 0.118 + ((c * 104729) % 11500).cast("double") / 100000).alias("lat"),
        F.when(c % 5 != 4, ((c % 4) * 90).cast("double")).alias("want_azimuth"),
    )


def views(spark: SparkSession, sf: str) -> DataFrame:
    """Map views, one per supplier."""
    s = F.col("s_suppkey")
    lon = F.lit(-85.79) + ((s * 7919) % 17000).cast("double") / 100000
    lat = F.lit(38.18) + idiv(s, 100).cast("double") * 0.118 + ((s * 104729) % 9000).cast("double") / 100000
    return spread(spark, sf, "supplier", "s_suppkey", each=5_000).select(
        s.alias("view_id"),
        (lon - 0.0009).alias("west"),
        (lat - 0.0009).alias("south"),
        (lon + 0.0009).alias("east"),
        (lat + 0.0009).alias("north"),
        ((s % 4) * 90).cast("double").alias("want_azimuth"),
    )


def terrain_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation patches as stored: one row per patch, rows of heights from the south."""
    s = F.col("s_suppkey")
    cols, rows = 20 + (s % 3).cast("int"), 18 + (s % 2).cast("int")
    height = lambda i, j: F.when((i * 7 + j * 11 + s) % 53 == 0, F.lit(-9999.0)).otherwise(
        (500 + (i * 3 + j * 5 + s) % 37 + i * 2 + j).cast("double")
    )
    grid = F.transform(
        F.sequence(F.lit(0), rows - 1), lambda j: F.transform(F.sequence(F.lit(0), cols - 1), lambda i: height(i, j))
    )
    return spread(spark, sf, "supplier", "s_suppkey", each=5_000).select(
        s.alias("patch_id"),
        F.lit(50.0).alias("cellSize"),
        (4905000 + (s % 100) * 400).cast("double").alias("lowerLeftX"),
        (3950000 + idiv(s, 100) * 1200).cast("double").alias("lowerLeftY"),
        F.lit(-9999.0).alias("noDataValue"),
        grid.alias("value"),
    )


def terrain_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Places whose ground height is asked, on and off the patches."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return (
        table(spark, sf, "lineitem")
        .select("l_suppkey", "l_partkey")
        .distinct()
        .select(
            s.alias("patch_id"),
            p.alias("q"),
            (4905000 + (s % 100) * 400 + (p * 37) % 1140 - 45).cast("double").alias("x"),
            (3950000 + idiv(s, 100) * 1200 + (p * 53) % 1010 - 45).cast("double").alias("y"),
        )
    )


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn features as saved, some of them unusable: id, kind, coordinates, radius, properties, time."""
    p = F.col("p_partkey")
    n = idiv(p, 6)
    kind = pick((p % 6).cast("int"), "point", "text", "line", "polygon", "rectangle", "circle")
    lon = F.lit(-85.8) + ((p * 7919) % 20000).cast("double") / 100000
    lat = F.lit(38.17) + ((p * 104729) % 11000).cast("double") / 100000
    at = lambda dx, dy: F.struct(
        (lon + F.lit(dx / 100000)).alias("lon"), (lat + F.lit(dy / 100000)).alias("lat")
    )
    bend = F.struct((lon + (100 + n % 40).cast("double") / 100000).alias("lon"), (lat + 0.0007).alias("lat"))
    shape = (
        F.when(p % 6 == 2, F.array(at(0, 0), bend, at(240, 30)))
        .when(
            p % 6 == 3,
            F.when(n % 3 == 0, F.array(at(0, 0), at(200, 10), bend, at(-20, 150)))
            .when(n % 3 == 1, F.array(at(0, 0), at(300, 0), at(300, 50), at(50, 50), at(50, 300), at(0, 300)))
            .otherwise(F.array(at(0, 0), at(200, 200), at(200, 0), at(0, 150))),
        )
        .when(p % 6 == 4, F.array(at(0, 0), at(150, 0), at(150, 90), at(0, 90)))
        .otherwise(F.array(at(0, 0)))
    )
    bad = lambda m: n % m == m - 1
    return spread(spark, sf, "part", "p_partkey", "p_name", "p_brand", each=10_000).select(
        p.alias("seq"),
        F.when(bad(61), "").otherwise(F.concat(F.lit("f"), p.cast("string"))).alias("id"),
        F.when(bad(67), "blob").otherwise(kind).alias("kind"),
        F.when(bad(59), F.array(at(0, 0), at(20000000, 0))).when(bad(71), F.slice(shape, 1, 0)).otherwise(shape).alias("coordinates"),
        F.when(p % 6 == 5, F.when(bad(73), -1.0).otherwise((20 + n % 50).cast("double"))).alias("radius_m"),
        F.when(n % 11 != 0, F.concat(F.col("p_name"), F.lit(' "q"'))).alias("label"),
        F.when(n % 13 != 0, F.col("p_brand")).alias("notes"),
        F.when(n % 7 == 0, "#12345").when(n % 7 == 1, "#1E88e5").otherwise("#fb8c00").alias("color"),
        F.when(n % 17 != 0, F.lit("2024-05-01T10:00:00.000Z")).alias("created_at"),
    )


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Point-cloud points: 25 tiles of 5,000 ft, octree depth by parity of the lattice position."""
    o, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    a = (o * 31 + line * 7) % 100
    b = (part * 17 + line * 3) % 100
    depth = F.when((a % 4 == 0) & (b % 4 == 0), 0).when((a % 2 == 0) & (b % 2 == 0), 1).otherwise(2)
    side = F.pow(F.lit(2), depth).cast("long")
    return table(spark, sf, "lineitem").select(
        (o % 25).alias("file"),
        F.concat_ws("-", depth.cast("string"), idiv(a * side, 100).cast("string"), idiv(b * side, 100).cast("string"), F.lit("0")).alias("key"),
        depth.alias("depth"),
        (4905000 + (o % 5) * 5000 + a * 50 + 25).cast("double").alias("x"),
        (3950000 + idiv(o % 25, 5) * 5000 + b * 50 + 25).cast("double").alias("y"),
        (F.lit(400.0) + F.col("l_quantity")).alias("z"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Octree nodes of the point tiles, with their size in the file."""
    d = F.col("depth")
    return (
        cloud(spark, sf)
        .groupBy("file", "key", "depth")
        .agg(F.count("*").alias("count"))
        .withColumns(
            {
                "offset": F.col("file") * 100000 + d * 1000,
                "length": idiv(F.col("count") * 53, 10),
                "cube_xmin": (4905000 + (F.col("file") % 5) * 5000).cast("double"),
                "cube_ymin": (3950000 + idiv(F.col("file"), 5) * 5000).cast("double"),
                "cube_size": F.lit(5000.0),
                "spacing": F.lit(200.0),
            }
        )
    )


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of interest in degrees, one per supplier: a slanted quadrilateral, some above the size limit."""
    s = F.col("s_suppkey")
    lon = F.lit(-85.79) + ((s * 7919) % 6000).cast("double") / 100000
    lat = F.lit(38.175) + ((s * 104729) % 4000).cast("double") / 100000
    w = F.when(s % 7 == 0, 0.06).otherwise((600 + (s % 5) * 100).cast("double") / 100000)
    at = lambda fx, fy: F.struct((lon + w * fx).alias("lon"), (lat + w * fy).alias("lat"))
    return spread(spark, sf, "supplier", "s_suppkey", each=2_000).select(
        s.alias("area_id"), F.array(at(0.0, 0.1), at(1.0, 0.0), at(0.9, 0.8), at(0.1, 1.0)).alias("ring")
    )


def levels(spark: SparkSession, sf: str) -> DataFrame:
    """Picture levels of photos, one photo per part: each level half the size of the last, tiles of 512."""
    p = F.col("p_partkey")
    tall = p % 2 == 1
    base = spread(spark, sf, "part", "p_partkey", each=5_000).select(
        p.alias("photo"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"), tall.alias("tall")
    )
    half = F.pow(F.lit(2), F.col("level")).cast("long")
    w = idiv(F.when(F.col("tall"), 10560).otherwise(14144), 1) / half
    h = idiv(F.when(F.col("tall"), 14144).otherwise(10560), 1) / half
    base = base.withColumns({"width": F.floor(w).cast("int"), "height": F.floor(h).cast("int")})
    tiles = (F.ceil(F.col("width") / 512) * F.ceil(F.col("height") / 512)).cast("int")
    size = lambda i: 90000 + ((i * 37 + F.col("photo") * 11) % 50) * 1000
    return base.select(
        "photo",
        "level",
        "width",
        "height",
        F.lit(512).alias("tile_width"),
        F.lit(512).alias("tile_height"),
        F.lit(7).alias("compression"),
        F.transform(F.sequence(F.lit(0), tiles - 1), lambda i: (i.cast("long") * 140000 + (5 - F.col("level")) * 400000000)).alias("offsets"),
        F.transform(F.sequence(F.lit(0), tiles - 1), lambda i: size(i.cast("long"))).alias("byte_counts"),
    )


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Picked ground vertices, one row each: two to six per measurement, seven tools."""
    p = F.col("p_partkey")
    tools = ["distance", "distance3d", "area", "area3d", "height", "surface", "location3d"]
    n = F.when(p % 7 >= 4, 1).otherwise(2 + (p % 5)).cast("int")
    df = spread(spark, sf, "part", "p_partkey", each=10_000).select(
        p.alias("meas_id"), pick((p % 7).cast("int"), *tools).alias("tool"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")
    )
    m, s = F.col("meas_id"), F.col("seq")
    return df.select(
        "meas_id",
        "tool",
        "seq",
        (4906000 + (m * 31) % 5000 + (s * (m % 9 + 3) * 211) % 1700).cast("double").alias("x"),
        (3951000 + (m * 17) % 4000 + (s * s * 97 + s * (m % 4) * 300) % 1500).cast("double").alias("y"),
        (500 + (m * 7 + s * 13) % 90).cast("double").alias("z"),
        ((m % 8 == 3) & (s == 0)).alias("approximate"),
        F.when((m % 7).isin(4, 6) & (m % 3 != 0), ((m * 11) % 400 - 60).cast("double")).alias("rise"),
        F.when((m % 7).isin(4, 6) & (m % 3 != 0), ((m * 5) % 30).cast("double")).alias("off_px"),
    )
