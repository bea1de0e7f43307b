"""From vendor rows to the frame table: pairing, keys, UTC, copies, passes, ground track, azimuth checks, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.functions.angles import full_turn, half_turn, look_offset
from aerolens.functions import quads, shapes
from aerolens.operators.expect import clock_of, zone_hours
from aerolens.operators.skew import exact_quantiles, with_neighbours, with_rank

# A neighbour counts when its shot number and distance are in range; a bigger error is flagged.
TRACK_SHOTS, TRACK_FT = 5, (300.0, 3000.0)
KAPPA_FLAG_DEG = 10.0
PASS_SIZE = 100000

EO_COLUMNS = {
    "X": "x", "Y": "y", "Z": "z", "Omega": "omega", "Phi": "phi", "Kappa": "kappa", "CamName": "cam_name",
    "CamWidthPx": "cam_width_px", "CamHeighPx": "cam_height_px", "CamFocalMm": "cam_focal_mm", "CamCCDResU": "cam_ccd_res_u",
    "CamPpxMm": "cam_ppx_mm", "CamPpyMm": "cam_ppy_mm", "CamOmegaDg": "cam_omega_dg", "CamPhiDg": "cam_phi_dg", "CamKappaDg": "cam_kappa_dg",
}
FRAME_NAMES = {
    "Year": "year", "Season": "season", "Filename": "filename", "CameraID": "camera", "FL": "fl",
    "FlightDate": "flight_date", "FlightTime": "flight_time_local", "TimeZone": "tz_label",
}


def shot_number(shot_id: Column) -> Column:
    return F.regexp_extract(shot_id, r"_(\d+)$", 1).try_cast("bigint")


def at_clock(date: Column, seconds: Column) -> Column:
    """A zoneless timestamp from a date and seconds since midnight."""
    zero = F.lit(0)
    return date.cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def paired(raw_frames: DataFrame, raw_eo: DataFrame) -> DataFrame:
    """Frame rows with the orientation row of the same season and fid; keys parsed, times as UTC."""
    r, e = raw_frames.alias("r"), raw_eo.alias("e")
    extra = [c for c in raw_frames.columns if c not in (*FRAME_NAMES, "season_key", "rn", "ShotID", "S3URL")]
    df = r.join(e, (F.col("r.season_key") == F.col("e.season_key")) & (F.col("r.rn") == F.col("e.fid"))).select(
        "r.season_key", "e.fid", shot_number(F.col("r.ShotID")).alias("shot"), *[F.col(f"r.{c}").alias(n) for c, n in FRAME_NAMES.items()],
        zone_hours(F.col("r.TimeZone")).alias("tz_offset_h"),
        at_clock(F.col("e.eo_date"), clock_of(F.col("e.eo_time"))).alias("eo_ts"),
        *[F.col(f"e.{c}").alias(n) for c, n in EO_COLUMNS.items()], *[F.col(f"r.{c}") for c in extra],
    )
    return df.withColumns(
        {
            "ts_utc": at_clock(F.col("flight_date"), clock_of(F.col("flight_time_local")) - F.col("tz_offset_h") * 3600),
            "exposure_id": F.concat_ws("/", "season_key", "fl", F.col("shot").cast("string")),
        }
    )


def ranked_copies(rows: DataFrame, bucket: int = 65536) -> DataFrame:
    """Add dup_rank and dup_count within each filename, lowest fid first."""
    return with_rank(rows, ["filename"], "fid", ["season_key"], "dup_rank", "dup_count", bucket)


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dup_rank") == 1)


def set_aside(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dup_rank") > 1)


def shot_prefix() -> Column:
    return F.floor(F.col("shot") / F.lit(PASS_SIZE))


def own_pass() -> Column:
    return F.concat_ws("/", "season_key", "fl", F.col("flight_date").cast("string"), shot_prefix().cast("string"))


def ground_track(frames: DataFrame) -> DataFrame:
    """(exposure_id, pass_id, track_heading_deg) of each Color frame.

    The direction to the next Color frame of the pass, else from the previous one; NULL where neither is within the
    shot and distance limits.
    """
    color = frames.where(F.col("camera") == "Color").select("exposure_id", own_pass().alias("pass_id"), "shot", "x", "y")
    near = with_neighbours(color, ["pass_id"], "shot", TRACK_SHOTS, ["x", "y"])

    def heading(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        usable = quads.distance(x0, y0, x1, y1).between(*TRACK_FT)
        return F.when(usable, full_turn(F.degrees(F.atan2(x1 - x0, y1 - y0))))

    here = F.col("x"), F.col("y")
    onward = heading(*here, F.col("nxt.x"), F.col("nxt.y"))
    behind = heading(F.col("prv.x"), F.col("prv.y"), *here)
    return near.select("exposure_id", "pass_id", F.coalesce(onward, behind).alias("track_heading_deg"))


def with_passes(frames: DataFrame) -> DataFrame:
    """Every camera takes the pass and track of its exposure's Color frame, or its own pass without one."""
    out = frames.join(ground_track(frames), "exposure_id", "left")
    return out.withColumns({"pass_id": F.coalesce("pass_id", own_pass()), "shot_prefix": shot_prefix()})


def with_reflight(frames: DataFrame) -> DataFrame:
    """is_reflight: the shot prefix is above the smallest one of the season and line.

    The minimum is a map-side aggregate joined back, so a line that holds most of the table is not gathered.
    """
    lowest = frames.groupBy("season_key", "fl").agg(F.min("shot_prefix").alias("__min"))
    out = frames.join(lowest, ["season_key", "fl"], "left")
    return out.withColumn("is_reflight", F.col("shot_prefix") > F.col("__min")).drop("__min")


def with_azimuth(frames: DataFrame) -> DataFrame:
    """Look azimuth of the obliques, its error against track and camera offset, and the flag (NULL stays NULL)."""
    look = F.when(F.col("camera") != "Color", full_turn(-F.col("kappa")))
    df = frames.withColumn("look_azimuth_deg", look)
    err = half_turn(F.col("look_azimuth_deg") - (F.col("track_heading_deg") + look_offset(F.col("camera"))))
    return df.withColumn("kappa_err_deg", err).withColumn("kappa_flag", F.abs("kappa_err_deg") > KAPPA_FLAG_DEG)


def normalised(kept_rows: DataFrame) -> DataFrame:
    """The frame table from the kept rows."""
    out = with_azimuth(with_reflight(with_passes(kept_rows)))
    box = quads.bbox(quads.corners())
    if "ring" in out.columns:
        box = [F.coalesce(a, b) for a, b in zip(box, shapes.box(shapes.of_frame(out.columns)))]
    return out.withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), box))).drop("eo_ts", "tz_offset_h", "dup_rank", "fid")


def season_report(frames: DataFrame) -> DataFrame:
    return frames.groupBy("season_key").agg(
        F.count("*").alias("frames"),
        F.countDistinct("exposure_id").alias("exposures"),
        F.countDistinct("pass_id").alias("passes"),
        F.count_if("is_reflight").alias("reflight_frames"),
        F.count_if(F.col("dup_count") > 1).alias("frames_with_duplicate"),
    )


def totals_report(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("dup_rank") == 1).alias("kept_frames"),
        F.count_if(F.col("dup_rank") > 1).alias("duplicate_copies_set_aside"),
        F.count("*").alias("source_rows"),
    )


def azimuth_report(frames: DataFrame) -> DataFrame:
    """Per camera: rows with a track, exact median and 99th percentile of the absolute error, flagged rows."""
    rows = frames.where(F.col("kappa_err_deg").isNotNull()).select("camera", F.abs("kappa_err_deg").alias("err"), "kappa_flag")
    counts = rows.groupBy("camera").agg(F.count("*").alias("with_track"), F.count_if("kappa_flag").alias("flagged_over_10deg"))
    q = exact_quantiles(rows, ["camera"], "err", {"m": 0.5, "p": 0.99})
    return counts.join(q, "camera").select(
        "camera", "with_track", F.round("m", 2).alias("median_abs_err"), F.round("p", 2).alias("p99_abs_err"), "flagged_over_10deg"
    )


def trackless_report(frames: DataFrame) -> DataFrame:
    return frames.agg(
        F.count_if((F.col("camera") == "Color") & F.col("track_heading_deg").isNull()).alias("color_frames_without_track")
    )
