"""Judging the selection rule: sampled places, outcome tables, review sets and consistency rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.functions import quads, shapes
from aerolens.functions.crs import grid_to_lonlat
from aerolens.functions.angles import round_to
from aerolens.functions.rings import settle
from aerolens.operators import select
from aerolens.operators.expect import rule
from aerolens.operators.skew import exact_quantiles
from aerolens.session import staged

DIRECTIONS = (0.0, 90.0, 180.0, 270.0)
EDGE_FRACTIONS = (0.0, 0.05, 0.10, 0.20)
#: Places of 400 at which two forms of the selection may differ (a fixed value).
ALLOWED_MISSES = 2


def interior_points(frames: DataFrame) -> DataFrame:
    """An interior point of every footprint: by the corners of a quad, else by all rings of the outline."""
    px, py = quads.interior_point(quads.corners())
    keep = ["filename", "camera", "is_reflight"]
    if "ring" not in frames.columns:
        return settle(frames.select(*keep, px.alias("px"), py.alias("py")), "px", "py")
    other = F.when(F.col("x0").isNull(), shapes.of_frame(frames.columns)).alias("__shape")
    both = settle(frames.select(*keep, px.alias("__qx"), py.alias("__qy"), other), "__qx", "__qy", "__shape")
    both = shapes.with_interior_point(both, F.col("__shape"))
    return both.select(*keep, F.coalesce("__qx", "px").alias("px"), F.coalesce("__qy", "py").alias("py"))


def seeded(df: DataFrame, seed: str, n: int) -> DataFrame:
    """A repeatable sample: the n rows whose name and seed hash lowest, whatever the partitioning."""
    return df.withColumn("__h", F.md5(F.concat("filename", F.lit(seed)))).orderBy("__h", "filename").limit(n).drop("__h")


def sample_points(frames: DataFrame, n: int = 2000, seed: str = "42", camera: str = "Color") -> DataFrame:
    """Interior points of a seeded sample of one camera's footprints, keyed by the frame's name."""
    chosen = seeded(frames.where(F.col("camera") == camera), seed, n)
    return interior_points(chosen).select(F.col("filename").alias("point_id"), "px", "py")


def in_directions(points: DataFrame, directions: Sequence[float] = DIRECTIONS) -> DataFrame:
    """Each point asked for each direction: a fixed handful of rows per point."""
    return points.withColumn("want_azimuth", F.explode(F.array(*[F.lit(float(d)) for d in directions])))


ASKED = ["point_id", "want_azimuth"]


def top_picks(points: DataFrame, frames: DataFrame, directions: Sequence[float] = DIRECTIONS) -> DataFrame:
    """The first pick of every point and direction; rows without any frame are kept with NULLs."""
    asked = in_directions(points, directions)
    picks = select.frames_at_points(asked, frames, lim=1, point_id=ASKED).drop("px", "py")
    return asked.join(picks, ASKED, "left")


def _good() -> Column:
    return F.coalesce(F.col("az_ok") & F.col("eligible"), F.lit(False))


def _share(count: Column) -> Column:
    return F.round(F.lit(100.0) * count / F.count("*"), 1)


def outcomes(picks: DataFrame) -> DataFrame:
    """Per direction: places without a frame, with a fallback, with an ineligible pick, and with a good one."""
    good = F.count_if(_good())
    return picks.groupBy(F.col("want_azimuth").alias("look_az")).agg(
        F.count_if(F.col("filename").isNull()).alias("no_frame"),
        F.count_if(F.col("filename").isNotNull() & ~F.col("az_ok")).alias("az_fallback"),
        F.count_if(F.col("az_ok") & ~F.col("eligible")).alias("in_tolerance_but_ineligible"),
        good.alias("good"),
        _share(good).alias("pct_good"),
    )


def good_profile(picks: DataFrame) -> DataFrame:
    """What good picks look like, per camera."""
    good = picks.where(_good())
    base = good.groupBy("camera").agg(
        F.count("*").alias("n"),
        F.round(F.avg("az_off_deg"), 2).alias("mean_az_off"),
        F.round(F.max("az_off_deg"), 1).alias("max_az_off"),
        F.count_if(F.col("is_reflight")).alias("reflight_picks"),
    )
    center = exact_quantiles(good, ["camera"], "center_dist_ft", {"c50": 0.5})
    gsd = exact_quantiles(good, ["camera"], "est_gsd_ft", {"g50": 0.5, "g95": 0.95})
    return base.join(center, "camera").join(gsd, "camera").select(
        "camera", "n", "mean_az_off", "max_az_off", F.round("c50", 0).alias("median_center_ft"),
        F.round("g50", 3).alias("median_gsd_ft"), F.round("g95", 3).alias("p95_gsd_ft"), "reflight_picks",
    )


def competition(points: DataFrame, frames: DataFrame, direction: float = 0.0) -> DataFrame:
    """How many frames compete for a place and how many of them are good; places that no frame covers do not count."""
    cands = select.graded(select.candidates(in_directions(points, [direction]), frames, ASKED))
    per_point = cands.groupBy("point_id").agg(F.count("*").alias("n_cand"), F.count_if(_good()).alias("n_ok"))
    return per_point.agg(
        F.count("*").alias("points"),
        F.round(F.avg("n_cand"), 1).alias("mean_candidates"),
        F.max("n_cand").alias("max_candidates"),
        F.round(F.avg("n_ok"), 1).alias("mean_in_tolerance_and_eligible"),
        F.count_if(F.col("n_ok") == 0).alias("points_with_none"),
    )


def edge_sweep(points: DataFrame, frames: DataFrame, direction: float = 0.0, fractions: Sequence[float] = EDGE_FRACTIONS) -> DataFrame:
    """Share of places with a good pick for several edge margins. Candidates are joined once and ranked per margin."""
    asked = in_directions(points, [direction])
    cands = select.candidates(asked, frames, ASKED)
    margins = F.explode(F.array(*[F.lit(float(m)) for m in fractions]))
    graded = select.graded(cands.withColumn("min_edge_frac", margins), min_edge_frac=F.col("min_edge_frac"))
    key = ["point_id", "min_edge_frac"]
    top = select.ranked(graded, key, 1).select(*key, "az_ok", "eligible")
    every = asked.select("point_id").withColumn("min_edge_frac", margins)
    return every.join(top, key, "left").groupBy("min_edge_frac").agg(_share(F.count_if(_good())).alias("pct_good"))


def review_random(frames: DataFrame, n: int, seed: str) -> DataFrame:
    """Sampled places; the direction asked cycles through the four in sample order."""
    chosen = seeded(frames.where(F.col("camera") == "Color"), seed, n)
    order = F.row_number().over(Window.orderBy(F.md5(F.concat("filename", F.lit(seed))), "filename"))
    pts = interior_points(chosen).withColumn("__k", order)
    az = F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), 1 + F.col("__k") % 4)
    return pts.select(F.lit("random").alias("category"), F.col("filename").alias("point_id"), "px", "py", az.alias("want_azimuth"))


def review_reflight(frames: DataFrame, n: int, seed: str, depth: int = 20) -> DataFrame:
    """Places looking north where the pick is a good re-flight although a good original is among the first picks."""
    chosen = seeded(frames.where((F.col("camera") == "Color") & F.col("is_reflight")), seed, n)
    # Written once: the joins below read the sample several times, and each would choose it anew from all frames.
    pts = staged(interior_points(chosen).select(F.col("filename").alias("point_id"), "px", "py", F.lit(0.0).alias("want_azimuth")))
    picks = select.frames_at_points(pts, frames, lim=depth, point_id=ASKED)
    first = (F.col("pick") == 1) & F.col("is_reflight") & _good()
    original = ~F.col("is_reflight") & _good()
    found = picks.groupBy(*ASKED, "px", "py").agg(F.bool_or(first).alias("a"), F.bool_or(original).alias("b"))
    return found.where("a AND b").select(F.lit("reflight").alias("category"), "point_id", "px", "py", "want_azimuth")


def review_fallback(frames: DataFrame, n: int, seed: str) -> DataFrame:
    """Places and directions whose first pick looks another way."""
    picks = top_picks(staged(sample_points(frames, n, seed)), frames)
    return picks.where(~F.col("az_ok")).select(F.lit("fallback").alias("category"), "point_id", "px", "py", "want_azimuth")


def review_payload(sets: DataFrame, frames: DataFrame, n_cand: int = 6) -> DataFrame:
    """One row per place: where it is, and its first picks in order as a JSON array."""
    picks = select.frames_at_points(sets, frames, lim=n_cand, point_id=["category", *ASKED])
    cams = frames.select(
        "filename", F.col("x").alias("cam_x"), F.col("y").alias("cam_y"),
        F.array(*[F.array(round_to(F.col(f"x{i % 4}"), 1), round_to(F.col(f"y{i % 4}"), 1)) for i in range(5)]).alias("footprint"),
    )
    fields = ["pick", "filename", "camera", F.col("look_azimuth_deg").alias("look_az"), F.col("az_off_deg").alias("az_off"), "az_ok",
              "eligible", "is_reflight", "ts_utc", "pass_id", "shot", "center_dist_ft", "edge_frac", "est_gsd_ft", "cam_x", "cam_y", "footprint"]
    key = ["category", *ASKED]
    # Frames compress so well on disk that Spark would take them for few and gather them in the driver; places may be many too.
    ordered = picks.join(cams.hint("merge"), "filename").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cands"))
    lon, lat = grid_to_lonlat(F.col("px"), F.col("py"))
    return sets.join(ordered.hint("merge"), key, "left").select(*key, "px", "py", lon.alias("lon"), lat.alias("lat"), "cands", F.to_json("cands").alias("json"))


def outside_shown(payload: DataFrame) -> DataFrame:
    """Picks whose footprint, as written out, does not hold the place."""
    c = payload.select("category", *ASKED, "px", "py", F.explode("cands").alias("c"))
    quad = [(F.col("c.footprint")[i][0], F.col("c.footprint")[i][1]) for i in range(4)]
    return c.where(~quads.inside(quad, F.col("px"), F.col("py"))).select("category", *ASKED, F.col("c.pick").alias("pick"), F.col("c.filename").alias("filename"))


def uncovered(points: DataFrame, cands: DataFrame) -> DataFrame:
    """The rule that a frame covers each place; `cands` are the candidates of these places (or of some directions of them)."""
    return rule("a frame covers the place", points.join(cands.select("point_id").distinct(), "point_id", "left_anti"))


def agreement(pairs: DataFrame, allowed: int = ALLOWED_MISSES) -> DataFrame:
    """From `formulations`: (rule, n_places, n_apart, n_bad), where the two forms may differ at a few places near an outline."""
    apart = (~F.col("by_point").eqNullSafe(F.col("by_view"))).cast("long")
    counted = pairs.agg(F.count("*").alias("n_places"), F.coalesce(F.sum(apart), F.lit(0)).alias("n_apart"))
    bad = F.when(F.col("n_apart") > allowed, F.col("n_apart")).otherwise(F.lit(0)).cast("long")
    return counted.select(F.lit("the point form and the view form agree").alias("rule"), "n_places", "n_apart", bad.alias("n_bad"))


def selection_rules(points: DataFrame, frames: DataFrame) -> DataFrame:
    """The invariants of the selection as (rule, n_bad), over all the given points in every direction and straight down."""
    down = points.withColumn("want_azimuth", F.lit(None).cast("double"))
    asked = in_directions(points).unionByName(down)
    key = ["point_id", "want_azimuth"]
    # Written once: eight of the rules read the candidates.
    cands = staged(select.graded(select.candidates(asked, frames, key)))
    first = select.ranked(cands, key, 1).select(
        "point_id", F.coalesce("want_azimuth", F.lit(-1.0)).alias("w"), "az_ok", "eligible", F.col("filename").alias("first")
    )
    tiers = cands.groupBy("point_id", F.coalesce("want_azimuth", F.lit(-1.0)).alias("w")).agg(
        F.bool_or("az_ok").alias("any_ok"), F.bool_or(F.col("az_ok") & F.col("eligible")).alias("any_good")
    )
    both = tiers.join(first, ["point_id", "w"], "full")
    lon, lat = grid_to_lonlat(F.col("px"), F.col("py"))
    places = points.select("point_id", lon.alias("lon"), lat.alias("lat"), F.lit(0.0).alias("want_azimuth"))
    by_place = select.frames_at_lonlat(places, frames, lim=1).select("point_id", "filename")
    by_point = select.ranked(cands.where(F.col("want_azimuth") == 0.0), key, 3).select("point_id", "filename")
    sides = select.frame_neighbours(frames).join(frames.select(F.col("filename").alias("of"), F.col("shot").alias("at"), "pass_id", "camera"), "of")
    heads = frames.groupBy("pass_id", "camera").agg(F.min("shot").alias("head"))
    ordered = sides.join(heads, ["pass_id", "camera"])
    rules = [
        uncovered(points, cands.where(F.col("want_azimuth").isNull())),
        rule("looking down returns only the nadir camera", cands.where(F.col("want_azimuth").isNull() & (F.col("camera") != "Color"))),
        rule("a compass request returns only obliques", cands.where(F.col("want_azimuth").isNotNull() & (F.col("camera") == "Color"))),
        rule("pick 1 exists where a frame covers", both.where(F.col("first").isNull() | F.col("any_ok").isNull())),
        rule("pick 1 is in tolerance when any is", both.where(F.col("any_ok") & ~F.col("az_ok"))),
        rule("pick 1 is eligible when any in tolerance is", both.where(F.col("any_good") & F.col("az_ok") & ~F.col("eligible"))),
        rule("degrees agree with the grid", by_place.join(by_point, ["point_id", "filename"], "left_anti")),
        rule("the first frame of a pass has no previous one", ordered.where((F.col("at") == F.col("head")) & (F.col("direction") == "prev"))),
        rule("neighbours are in shot order", ordered.where(
            ((F.col("direction") == "next") & (F.col("shot") <= F.col("at"))) | ((F.col("direction") == "prev") & (F.col("shot") >= F.col("at")))
        )),
        rule("shots are distinct along a pass", frames.groupBy("pass_id", "camera", "shot").count().where("count > 1")),
    ]
    out = rules[0]
    for other in rules[1:]:
        out = out.unionByName(other)
    return out


def hash_chosen(frames: DataFrame, n: int = 400, seed: str = "") -> DataFrame:
    """Interior points of hash-chosen obliques; the direction cycles through the four in hash order."""
    chosen = seeded(frames.where(F.col("camera").isin("Fwd", "Left")), seed, n)
    k = F.row_number().over(Window.orderBy(F.md5(F.concat("filename", F.lit(seed))), "filename")) - 1
    pts = interior_points(chosen).withColumn("__k", k)
    az = F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), 1 + F.col("__k") % 4)
    return pts.select(F.col("filename").alias("point_id"), "px", "py", az.alias("want_azimuth"))


def formulations(points: DataFrame, frames: DataFrame) -> DataFrame:
    """The top pick of each place in the point form beside the winner of a view of 1e-6 degrees about it."""
    lon, lat = grid_to_lonlat(F.col("px"), F.col("py"))
    places = points.select("point_id", lon.alias("lon"), lat.alias("lat"), "want_azimuth")
    a = select.frames_at_lonlat(places, frames, lim=1).where("az_ok").select("point_id", F.col("filename").alias("by_point"))
    views = places.select(
        F.col("point_id").alias("view_id"), (F.col("lon") - 1e-6).alias("west"), (F.col("lat") - 1e-6).alias("south"),
        (F.col("lon") + 1e-6).alias("east"), (F.col("lat") + 1e-6).alias("north"), "want_azimuth",
    )
    b = select.frames_in_views(views, frames, lim=1).select(F.col("view_id").alias("point_id"), F.col("filename").alias("by_view"))
    return places.select("point_id", "want_azimuth").join(a, "point_id", "left").join(b, "point_id", "left")
