"""Choosing frames: for a table of points, for a table of map views, and along flight passes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aerolens.functions import quads, rings, shapes
from aerolens.functions.angles import bearing_gap, compass_name, full_turn, js_round, round_to
from aerolens.functions.crs import grid_to_lonlat, lonlat_to_grid
from aerolens.functions.rings import overlap_inclusive
from aerolens.functions.text import fixed, iso_utc, sidecar
from aerolens.operators.gridjoin import points_in_single_shapes
from aerolens.operators.skew import with_neighbours

# The selection limits and the limits of a request.
AZ_TOLERANCE, MIN_EDGE_FRAC, MAX_GSD_FT, TOP = 30.0, 0.10, 0.40, 5
MAX_SHOT_GAP, MAX_NEIGHBOUR_FT = 5, 3000.0
MAX_LIMIT, MAX_VIEW_LIMIT, MAX_VIEW_DEG = 20, 12, 0.08
LOOK_NAMES = {"north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}
NEAR_EDGE_NOTE = "The point is near the edge of this photo, or the resolution is coarse there."
REFLIGHT_NOTE = "From a later re-flight of the line."

OUTLINE = [f"{a}{n}" for n in range(4) for a in "xyz"]
PICK_COLUMNS = (
    "pick filename camera look_azimuth_deg az_off_deg az_ok eligible is_reflight ts_utc pass_id shot center_dist_ft "
    "edge_frac est_gsd_ft"
).split()


def with_outline_terms(frames: DataFrame) -> DataFrame:
    """Once per frame: box, centroid, square root of the area, middle height and convexity of its footprint.

    Frames that carry a `ring` and have no corner columns, because they are not four-cornered, get them from the ring, or from
    all their `parts` and holes.
    """
    q, zs = quads.corners(), quads.heights()
    xmin, ymin, xmax, ymax = quads.bbox(q)
    cx, cy = quads.centroid(q)
    terms = {
        "xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax, "cen_x": cx, "cen_y": cy,
        "sqrt_area": F.sqrt(quads.area(q)), "z_mid": quads.z_middle(zs), "turning": quads.turning(q),
    }
    if "ring" not in frames.columns:
        return frames.withColumns(terms)
    shape = F.when(_by_ring(), shapes.of_frame(frames.columns))
    frames = rings.settle(frames.withColumn("__outline", shape), "__outline")
    frames = rings.settle(frames.withColumn("__moments", shapes.moments(F.col("__outline"))), "__moments")
    shape, m = F.col("__outline"), F.col("__moments")
    z = F.transform(shapes.vertices(shape), lambda p: p["z"])
    other = dict(zip(("xmin", "ymin", "xmax", "ymax", "cen_x", "cen_y"), (*shapes.box(shape), *shapes.centroid_of(m))))
    other |= {"sqrt_area": F.sqrt(shapes.area_of(m)), "z_mid": (F.array_min(z) + F.array_max(z)) / 2, "turning": F.lit(0)}
    return frames.withColumns({n: F.when(_by_ring(), other[n]).otherwise(v) for n, v in terms.items()}).drop("__outline", "__moments")


def _by_ring() -> Column:
    """Frames whose outline is no quad."""
    return F.col("x0").isNull() & (F.size("ring") > 2)


def _slim(frames: DataFrame) -> DataFrame:
    """Only what selection needs of a frame, renamed so that it cannot clash with the points.

    Corners of a convex footprint come counter-clockwise. The numbers the pair test reads are made non-nullable, which
    keeps the generated join condition small enough for the JVM to compile.
    """
    if "turning" not in frames.columns:
        frames = with_outline_terms(frames)
    four = reduce(and_, [F.col(f"{a}{n}").isNotNull() for n in range(4) for a in "xy"])
    frames = frames.where(four | _by_ring() if "ring" in frames.columns else four)
    # Edges are made once for a frame, before it is shuffled, not for each pair of it.
    edges = F.when(_by_ring(), shapes.edges(shapes.of_frame(frames.columns))) if "ring" in frames.columns else F.lit(None)
    quad = ~_by_ring() if "ring" in frames.columns else F.lit(True)
    sure = lambda c: F.coalesce(c, F.lit(0.0))
    turned = F.col("turning") < 0
    swap = {0: 0, 1: 3, 2: 2, 3: 1}
    xy = [sure(F.when(turned, F.col(f"{a}{swap[n]}")).otherwise(F.col(f"{a}{n}")) if n % 2 else F.col(f"{a}{n}")).alias(f"{a}{n}")
          for n in range(4) for a in "xy"]
    box = [sure(F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return frames.select(
        "filename", "camera", "look_azimuth_deg", "is_reflight", "ts_utc", "pass_id", "shot", *xy, *box,
        "cen_x", "cen_y", "sqrt_area", "z_mid", (F.col("turning") != 0).alias("__convex"),
        F.col("x").alias("cam_x"), F.col("y").alias("cam_y"), F.col("z").alias("cam_z"),
        (F.col("cam_ccd_res_u") * F.lit(1e-3) / F.col("cam_focal_mm")).alias("ft_per_ft"),
        (F.col("camera") == "Color").alias("__nadir"), edges.alias("__edges"), F.coalesce(quad, F.lit(True)).alias("__quad"),
    )


def covering_pairs(points: DataFrame, frames: DataFrame, point_id: Sequence[str], fits: Column | None = None, also_on: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point (px, py) and a frame whose footprint covers it, with the terms the ranking needs.

    Convex footprints, which real ones are, take a test of four products; the rest (a vendor outline may be concave or
    cross itself) go through the general one, and outlines of more corners, with holes or of several parts through that of shapes. `fits` is a further
    condition on the pair.
    """
    px, py = F.coalesce("px", F.lit(0.0)), F.coalesce("py", F.lit(0.0))
    located = points.where(F.col("px").isNotNull() & F.col("py").isNotNull()).withColumns({"px": px, "py": py})
    slim, (px, py) = _slim(frames), (F.col("px"), F.col("py"))
    quad, edges = F.col("__quad"), F.col("__edges")
    q = quads.corners()
    turns, lengths = quads.left_turns(q, px, py), quads.edge_lengths(q)
    cases = [
        (F.col("__convex"), F.least(*turns) >= 0, F.least(*[t / n for t, n in zip(turns, [F.col(f"__len{i}") for i in range(4)])])),
        (~F.col("__convex") & quad, quads.covers(q, px, py), quads.edge_distance(q, px, py)),
    ]
    if "ring" in frames.columns:
        cases.append((~quad, rings.covered_by(edges, px, py), rings.nearest_edge_distance(edges, px, py)))
    out = None
    for which, inside, to_edge in cases:
        side = slim.where(which)
        side = (side if which is cases[-1][0] and len(cases) == 3 else side.drop("__edges")).withColumns({f"__len{i}": n for i, n in enumerate(lengths)})
        cond = inside if fits is None else inside & fits
        pairs = points_in_single_shapes(located, side, point_id, ["filename"], cond, also_on=also_on).withColumn("__to_edge", to_edge).drop("__edges", "__quad")
        out = pairs if out is None else out.unionByName(pairs)
    slant = quads.distance3(px, py, F.col("z_mid"), F.col("cam_x"), F.col("cam_y"), F.col("cam_z"))
    return out.withColumns(
        {
            "center_dist_ft": quads.distance(px, py, F.col("cen_x"), F.col("cen_y")),
            "edge_frac": F.col("__to_edge") / F.nullif(F.col("sqrt_area"), F.lit(0.0)),
            "est_gsd_ft": slant * F.col("ft_per_ft"),
        }
    )


def candidates(points: DataFrame, frames: DataFrame, point_id: Sequence[str] = ("point_id",)) -> DataFrame:
    """Every frame that covers a point and looks the right way up, with its ranking terms.

    `points` has px, py (grid feet) and want_azimuth (NULL asks for the nadir camera, a bearing for the obliques).
    """
    asked = points.withColumn("__nadir", F.col("want_azimuth").isNull())
    pairs = covering_pairs(asked, frames, point_id, also_on=["__nadir"])
    off = F.when(F.col("want_azimuth").isNull(), F.lit(0.0)).otherwise(
        bearing_gap(F.col("look_azimuth_deg"), F.col("want_azimuth"))
    )
    return pairs.withColumn("az_off_deg", off).select(
        *points.columns, *[c for c in PICK_COLUMNS if c not in ("pick", "az_ok", "eligible")]
    )


def graded(cands: DataFrame, az_tolerance=AZ_TOLERANCE, min_edge_frac=MIN_EDGE_FRAC, max_gsd_ft=MAX_GSD_FT) -> DataFrame:
    """Add az_ok and eligible. The limits may be numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    fine = (F.col("edge_frac") >= lit(min_edge_frac)) & (F.col("est_gsd_ft") <= lit(max_gsd_ft))
    return cands.withColumns({"az_ok": F.col("az_off_deg") <= lit(az_tolerance), "eligible": F.coalesce(fine, F.lit(False))})


def ranking() -> list[Column]:
    """Order of preference; NULLs where a relational database with NULLs last would put them."""
    return [
        F.desc_nulls_first("az_ok"),
        F.when(F.col("az_ok"), F.lit(0.0)).otherwise(F.col("az_off_deg")).asc_nulls_last(),
        F.desc_nulls_first("eligible"),
        F.desc_nulls_first("is_reflight"),
        F.asc_nulls_last("center_dist_ft"),
        F.desc_nulls_first("ts_utc"),
        F.asc_nulls_last("filename"),
    ]


def ranked(graded_cands: DataFrame, point_id: Sequence[str], lim: int | None, first: int = 1) -> DataFrame:
    """Number the candidates of each point. With `lim` only that many (from `first` on) are kept.

    The cut is a comparison of row_number with a literal, which Spark also applies before the shuffle: a point covered
    by any number of frames sends at most the cut from each task.
    """
    out = graded_cands.withColumn("pick", F.row_number().over(Window.partitionBy(*point_id).orderBy(*ranking())))
    if lim is not None:
        out = out.where(F.col("pick") <= first + lim - 1)
    return out.where(F.col("pick") >= first) if first > 1 else out


def frames_at_points(
    points: DataFrame,
    frames: DataFrame,
    az_tolerance: float = AZ_TOLERANCE,
    min_edge_frac: float = MIN_EDGE_FRAC,
    max_gsd_ft: float = MAX_GSD_FT,
    lim: int | None = TOP,
    point_id: Sequence[str] = ("point_id",),
) -> DataFrame:
    """The frames that cover each point, best first."""
    cands = graded(candidates(points, frames, point_id), az_tolerance, min_edge_frac, max_gsd_ft)
    return ranked(cands, point_id, lim).select(*points.columns, *PICK_COLUMNS)


def frames_at_lonlat(places: DataFrame, frames: DataFrame, lim: int | None = TOP) -> DataFrame:
    """The same for places in degrees (point_id, lon, lat, want_azimuth), with the standard limits."""
    px, py = lonlat_to_grid(F.col("lon"), F.col("lat"))
    return frames_at_points(places.withColumns({"px": px, "py": py}), frames, lim=lim)


def page(picks: DataFrame, point_id: Sequence[str], start: int, size: int) -> DataFrame:
    """A page of graded candidates: picks start .. start + size - 1 of each point."""
    return ranked(picks, point_id, size, start)


def view_samples(views: DataFrame, n: int = 5) -> DataFrame:
    """n by n places over each view, on the grid, with the view's own box."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    grid = views.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    lon = F.col("west") + (F.col("east") - F.col("west")) * F.col("i") / F.lit(n - 1.0)
    lat = F.col("south") + (F.col("north") - F.col("south")) * F.col("j") / F.lit(n - 1.0)
    px, py = lonlat_to_grid(lon, lat)
    ends = [lonlat_to_grid(F.col(a), F.col(b)) for a in ("west", "east") for b in ("south", "north")]
    xs, ys = [e[0] for e in ends], [e[1] for e in ends]
    return grid.withColumns(
        {"px": px, "py": py, "vx0": F.least(*xs), "vy0": F.least(*ys), "vx1": F.greatest(*xs), "vy1": F.greatest(*ys)}
    )


def frames_in_views(views: DataFrame, frames: DataFrame, lim: int = 6, n: int = 5) -> DataFrame:
    """The distinct winners over each view's sample places and how many places each won, most first.

    Only obliques that look within the tolerance of the view's direction take part.
    """
    samples = view_samples(views, n).select("view_id", "i", "j", "px", "py", "want_azimuth", "vx0", "vy0", "vx1", "vy1")
    obliques = frames.where(F.col("camera") != "Color")
    view_box = tuple(F.col(c) for c in ("vx0", "vy0", "vx1", "vy1"))
    frame_box = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    fits = (bearing_gap(F.col("look_azimuth_deg"), F.col("want_azimuth")) <= AZ_TOLERANCE) & overlap_inclusive(view_box, frame_box)
    place = ["view_id", "i", "j"]
    hits = covering_pairs(samples, obliques, place, fits)
    hits = graded(hits.withColumn("az_off_deg", F.lit(0.0)))
    best = hits.withColumn("pick", F.row_number().over(Window.partitionBy(*place).orderBy(*ranking()))).where("pick = 1")
    wins = best.groupBy("view_id", "filename").agg(F.count("*").cast("int").alias("wins"))
    order = Window.partitionBy("view_id").orderBy(F.desc("wins"), "filename")
    return wins.withColumn("place", F.row_number().over(order)).where(F.col("place") <= lim)


def frame_neighbours(
    frames: DataFrame, max_shot_gap: int = MAX_SHOT_GAP, max_dist_ft: float = MAX_NEIGHBOUR_FT, names: DataFrame | None = None
) -> DataFrame:
    """Each frame's next and previous one along its pass, same camera, within the shot gap and the distance.

    `names` (a table with `filename`) limits whose neighbours are reported.
    """
    slim = frames.select("filename", "pass_id", "camera", "shot", "x", "y")
    both = with_neighbours(slim, ["pass_id", "camera"], "shot", max_shot_gap, ["filename", "x", "y"])
    if names is not None:
        both = both.join(names.select("filename").distinct(), "filename", "left_semi")
    sides = both.select(
        F.col("filename").alias("of"),
        "x",
        "y",
        F.explode(F.array(F.struct(F.lit("next").alias("direction"), F.col("nxt").alias("n")),
                          F.struct(F.lit("prev").alias("direction"), F.col("prv").alias("n")))).alias("s"),
    )
    dist = quads.distance(F.col("x"), F.col("y"), F.col("s.n.x"), F.col("s.n.y"))
    return sides.select(
        "of", F.col("s.direction").alias("direction"), F.col("s.n.filename").alias("filename"), F.col("s.n.shot").alias("shot"),
        dist.alias("dist_ft"),
    ).where(F.col("dist_ft") <= max_dist_ft)


def corner_array(n: int = 4) -> Column:
    return F.array(*[F.array(F.col(f"x{i % 4}"), F.col(f"y{i % 4}"), F.col(f"z{i % 4}")) for i in range(n)])


def frame_detail(frames: DataFrame, names: DataFrame, image_base: str) -> DataFrame:
    """Frames by name with address, position in degrees and outlines, as one nested row each."""
    # Names may be as many as frames, and compress so well on disk that Spark would take them for few.
    f = frames.join(names.select("filename").distinct().hint("merge"), "filename", "left_semi")
    url = F.concat(F.lit(image_base), F.col("filename"))
    lon, lat = grid_to_lonlat(F.col("x"), F.col("y"))
    ring = F.array(*[F.array(*[round_to(v, 6) for v in grid_to_lonlat(F.col(f"x{i % 4}"), F.col(f"y{i % 4}"))]) for i in range(5)])
    return f.select(
        "filename",
        url.alias("url"),
        sidecar(url).alias("sidecarUrl"),
        F.col("season_key").alias("seasonKey"),
        "fl",
        "shot",
        "camera",
        F.col("exposure_id").alias("exposureId"),
        F.col("pass_id").alias("passId"),
        F.col("shot_prefix").alias("shotPrefix"),
        F.col("is_reflight").alias("isReflight"),
        F.struct(
            F.col("flight_date").cast("string").alias("localDate"), F.col("flight_time_local").alias("localTime"),
            F.col("tz_label").alias("timeZone"), iso_utc(F.col("ts_utc")).alias("utc"),
        ).alias("flown"),
        F.struct("x", "y", "z", "omega", "phi", "kappa", round_to(lon, 6).alias("lon"), round_to(lat, 6).alias("lat")).alias("eo"),
        round_to(F.col("look_azimuth_deg"), 2).alias("lookAzimuth"),
        round_to(F.col("track_heading_deg"), 2).alias("trackHeading"),
        round_to(F.col("kappa_err_deg"), 2).alias("kappaErr"),
        F.col("kappa_flag").alias("kappaFlag"),
        sensor().alias("sensor"),
        ring.alias("footprintLonLat"),
        corner_array(5).alias("footprint3089"),
    )


def sensor() -> Column:
    names = {
        "cam_name": "name", "cam_width_px": "widthPx", "cam_height_px": "heightPx", "cam_focal_mm": "focalMm",
        "cam_ccd_res_u": "ccdResUm", "cam_ppx_mm": "ppxMm", "cam_ppy_mm": "ppyMm", "cam_omega_dg": "omegaDg",
        "cam_phi_dg": "phiDg", "cam_kappa_dg": "kappaDg",
    }
    return F.struct(*[F.col(c).alias(a) for c, a in names.items()])


def existing(names: DataFrame, frames: DataFrame) -> DataFrame:
    """Each asked name with whether there is such a frame."""
    known = frames.select("filename").distinct().withColumn("found", F.lit(True))
    return names.join(known, "filename", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scene_frames(wins: DataFrame, frames: DataFrame, image_base: str) -> DataFrame:
    """The winners of views joined back to what is needed to lay them on the ground."""
    url = F.concat(F.lit(image_base), F.col("filename")).alias("url")
    return wins.join(frames, "filename").select(
        "view_id", "place", "filename", url, "camera", round_to(F.col("look_azimuth_deg"), 2).alias("lookAzimuth"),
        F.col("is_reflight").alias("isReflight"), iso_utc(F.col("ts_utc")).alias("flownUtc"), "wins",
        F.struct("x", "y", "z", "omega", "phi", "kappa").alias("eo"), sensor().dropFields("name").alias("sensor"),
        corner_array(4).alias("footprint3089"),
    )


def parse_look(raw: Column) -> Column:
    """STRUCT<ok, label, azimuth> of a look text: a direction name, `down` (azimuth NULL) or a bearing of up to four digits."""
    key = F.lower(F.regexp_replace(raw, r"^\s+|\s+\z", ""))
    number = key.rlike(r"^-?\d{1,4}(\.\d+)?\z")
    azimuth = full_turn(key.try_cast("double"))
    known = key.isin(*LOOK_NAMES, "down")
    for name, value in LOOK_NAMES.items():
        azimuth = F.when(key == name, F.lit(value)).otherwise(azimuth)
    ok = F.coalesce(known | number, F.lit(False))
    return F.struct(
        ok.alias("ok"),
        F.when(ok, key).alias("label"),
        F.when(ok & (key != "down"), azimuth).alias("azimuth"),
    )


def point_request_problem() -> Column:
    """Why a request (lon, lat, look, lim) is refused; NULL when it is fine."""
    return (
        F.when(~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "lon must be between -180 and 180")
        .when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "lat must be between -90 and 90")
        .when(~F.coalesce(F.col("lim").between(1, MAX_LIMIT), F.lit(False)), f"limit must be between 1 and {MAX_LIMIT}")
        .when(F.length("look") > 12, "look is too long")
        .when(~parse_look(F.col("look"))["ok"], "look must be north, east, south, west, down, or a bearing in degrees")
    )


def view_request_problem() -> Column:
    """Why a view request (west, south, east, north, look, lim) is refused; NULL when it is fine."""
    look = parse_look(F.col("look"))
    shape = (
        (F.col("east") > F.col("west")) & (F.col("north") > F.col("south"))
        & (F.col("east") - F.col("west") <= MAX_VIEW_DEG) & (F.col("north") - F.col("south") <= MAX_VIEW_DEG)
    )
    inside = F.col("west").between(-180, 180) & F.col("east").between(-180, 180) & F.col("south").between(-90, 90) & F.col("north").between(-90, 90)
    return (
        F.when(~F.coalesce(inside, F.lit(False)), "the view is outside the world")
        .when(~F.coalesce(F.col("lim").between(1, MAX_VIEW_LIMIT), F.lit(False)), f"limit must be between 1 and {MAX_VIEW_LIMIT}")
        .when(F.length("look") > 12, "look is too long")
        .when(~look["ok"] | look["azimuth"].isNull(), "look must be north, east, south, west, or a bearing in degrees")
        .when(~F.coalesce(shape, F.lit(False)), "the view must have west < east and south < north, and be no more than 0.08 degrees across")
    )


def name_request_ok(filename: Column, prefix: str, suffix: str) -> Column:
    """Whether a name has the form of a frame name of the survey whose folders are <prefix><season key><suffix>."""
    quoted = lambda text: re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)
    pattern = rf"^{quoted(prefix)}\d{{4}}_Season\d{quoted(suffix)}/(Color|Fwd|Bwd|Left|Right)_[0-9_]{{1,40}}\.tif\z"
    return F.coalesce(filename.rlike(pattern), F.lit(False))


def shaped_picks(picks: DataFrame, image_base: str) -> DataFrame:
    """Picks as they are handed out: rounded, with address and ISO time."""
    keep = [c for c in picks.columns if c not in PICK_COLUMNS]
    return picks.select(
        *keep, "pick", "filename", F.concat(F.lit(image_base), F.col("filename")).alias("url"), "camera",
        round_to(F.col("look_azimuth_deg"), 1).alias("lookAzimuth"), round_to(F.col("az_off_deg"), 1).alias("azOff"),
        F.col("az_ok").alias("azOk"), "eligible", F.col("is_reflight").alias("isReflight"), iso_utc(F.col("ts_utc")).alias("flownUtc"),
        F.col("pass_id").alias("passId"), "shot", js_round(F.col("center_dist_ft")).alias("centerDistFt"),
        round_to(F.col("edge_frac"), 2).alias("edgeFrac"), round_to(F.col("est_gsd_ft"), 3).alias("estGsdFt"),
    )


def described_picks(shaped: DataFrame, want: Column, point_id: Sequence[str] = ("point_id",)) -> DataFrame:
    """Title, facts and caveats of each shaped pick, and whether its point's list should show the edge caveat once."""
    w = Window.partitionBy(*point_id)
    any_ok = F.max(F.coalesce("azOk", F.lit(False))).over(w)
    shared = F.sum((~F.col("eligible")).cast("int")).over(w) >= 2
    df = shaped.withColumns({"__any": any_ok, "sharesEdgeNote": shared, "__want": want})
    away = js_round(F.coalesce("azOff", F.lit(0.0))).cast("string")
    off = F.when(
        F.col("__any"), F.concat(F.lit("Looks "), away, F.lit("° away from "), "__want", F.lit("."))
    ).otherwise(F.concat(F.lit("No photo here looks "), "__want", F.lit(". This is the closest, "), away, F.lit("° away.")))
    title = F.when(F.col("lookAzimuth").isNull(), "Straight down").otherwise(F.concat(F.lit("Looking "), compass_name(F.col("lookAzimuth"))))
    facts = F.array_compact(
        F.array(
            F.concat("camera", F.lit(" camera")),
            F.concat(F.lit("flown "), F.substring("flownUtc", 1, 10)),
            F.when(F.col("estGsdFt").isNotNull(), F.concat(F.lit("about "), fixed(F.col("estGsdFt"), 2), F.lit(" ft per pixel here"))),
        )
    )
    notes = F.array_compact(
        F.array(
            F.when(~F.coalesce("azOk", F.lit(False)) & (F.col("__want") != "down"), off),
            F.when(~F.col("eligible"), NEAR_EDGE_NOTE),
            F.when(F.col("isReflight"), REFLIGHT_NOTE),
        )
    )
    return df.select(
        *point_id, "pick", "filename", title.alias("title"), facts.alias("facts"), notes.alias("notes"),
        (~F.col("eligible")).alias("nearEdge"), "sharesEdgeNote",
    )


def register_sql(spark: SparkSession) -> None:
    """The bearing difference as a SQL function."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION angle_diff(a DOUBLE, b DOUBLE) RETURNS DOUBLE "
        "RETURN abs(((a - b + 540) - 360 * floor((a - b + 540) / 360)) - 180)"
    )


def register_neighbours(spark: SparkSession) -> None:
    """The neighbours of one frame as a SQL table function over a view named `frames`."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION frame_neighbors(fname STRING, max_shot_gap INT DEFAULT 5, max_dist_ft DOUBLE DEFAULT 3000) "
        "RETURNS TABLE (direction STRING, filename STRING, shot BIGINT, dist_ft DOUBLE) RETURN "
        "SELECT s.direction, s.n.filename, s.n.shot, s.d FROM ("
        " SELECT 'next' AS direction, min(struct(f.shot, f.filename, f.x, f.y)) AS n, any_value(c.shot) AS at,"
        "  sqrt(pow(min(struct(f.shot, f.filename, f.x, f.y)).x - any_value(c.x), 2) + pow(min(struct(f.shot, f.filename, f.x, f.y)).y - any_value(c.y), 2)) AS d"
        "  FROM frames c JOIN frames f ON f.pass_id = c.pass_id AND f.camera = c.camera AND f.shot > c.shot WHERE c.filename = fname"
        " UNION ALL"
        " SELECT 'prev', max(struct(f.shot, f.filename, f.x, f.y)), any_value(c.shot),"
        "  sqrt(pow(max(struct(f.shot, f.filename, f.x, f.y)).x - any_value(c.x), 2) + pow(max(struct(f.shot, f.filename, f.x, f.y)).y - any_value(c.y), 2))"
        "  FROM frames c JOIN frames f ON f.pass_id = c.pass_id AND f.camera = c.camera AND f.shot < c.shot WHERE c.filename = fname"
        ") s WHERE abs(s.n.shot - s.at) <= max_shot_gap AND s.d <= max_dist_ft"
    )
