"""The scene job: for map views, which photos to draw and which of their tiles to read."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.functions import quads, shapes
from aerolens.functions.crs import lonlat_to_grid
from aerolens.operators import imagery, photo, select
from aerolens.session import staged

SPOTS, OUTLINE_SPOTS = 9, 3
BOX = ("west", "south", "east", "north", "want_azimuth")


def _spread(views: DataFrame, n: int) -> DataFrame:
    """n by n ground places over each view, edges included."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    grid = views.withColumn("pi", F.explode(steps)).withColumn("pj", F.explode(steps))
    lon = F.col("west") + (F.col("east") - F.col("west")) * F.col("pi") / (n - 1.0)
    lat = F.col("south") + (F.col("north") - F.col("south")) * F.col("pj") / (n - 1.0)
    gx, gy = lonlat_to_grid(lon, lat)
    return grid.select("view_id", "pi", "pj", gx.alias("gx"), gy.alias("gy"))


def with_places(rows: DataFrame, views: DataFrame, n: int) -> DataFrame:
    """Rows of views with each of a view's places, always merged: exploded places are left out of Spark's sizes."""
    return rows.join(_spread(views, n).hint("merge"), "view_id")


def read_plan(views: DataFrame, frames: DataFrame, levels: DataFrame, screen_px: float = 1000.0, lim: int = 6) -> DataFrame:
    """One row per photo a view needs: level and tile rectangle, within the tile budget the view's photos share.

    `frames` has the rotation columns; `levels` describes each photo under its filename as `photo`. Views that share a rounded
    box and a direction are planned once.
    """
    rounded = imagery.shared_boxes(views)
    shared = rounded.groupBy(*BOX).agg(F.min("view_id").alias("shared_id"))
    same = reduce(and_, [rounded[c].eqNullSafe(shared[c]) for c in BOX])
    members = rounded.join(shared.hint("merge"), same).select("view_id", "shared_id")
    plan = _plan(shared.withColumnRenamed("shared_id", "view_id"), frames, levels, screen_px, lim)
    return members.join(plan.withColumnRenamed("view_id", "shared_id").hint("merge"), "shared_id").drop("shared_id")


def _ground(columns) -> Column:
    """The height of flat ground under a photo: the mean of a quad's corners, or of another outline's vertices."""
    corners = quads.mean_height(quads.heights())
    return F.coalesce(corners, shapes.mean_height(shapes.of_frame(columns))) if "ring" in columns else corners


def _plan(boxes: DataFrame, frames: DataFrame, levels: DataFrame, screen_px: float, lim: int) -> DataFrame:
    # Frames and picks compress well on disk: Spark would take them for small tables and gather them, so all joins are merged.
    wins = staged(select.frames_in_views(boxes, frames, lim))
    rig = frames.select("filename", *photo.RIG_COLUMNS, _ground(frames.columns).alias("gz"))
    stack = wins.select("view_id", "filename", F.col("place").alias("priority")).join(rig.hint("merge"), "filename")
    fine = photo.photo_weights(with_places(stack, boxes, SPOTS))
    needed = photo.needed_frames(fine, ["view_id"], ["pi", "pj"]).where("needed").select("view_id", "priority")
    kept = stack.join(needed.hint("merge"), ["view_id", "priority"])
    region = photo.regions_under(with_places(kept, boxes, OUTLINE_SPOTS), ["view_id", "filename"])
    region = region.select("view_id", "filename", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    x0, _ = lonlat_to_grid(F.col("west"), F.col("south"))
    x1, _ = lonlat_to_grid(F.col("east"), F.col("south"))
    scale = F.lit(screen_px) / (x1 - x0)
    flat = boxes.select("view_id", scale.alias("ax"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("ay"), (-scale).alias("by"))
    sized = photo.max_screen_scales(region.join(rig.hint("merge"), "filename").join(flat.hint("merge"), "view_id"), ["view_id", "filename"])
    ask = region.join(sized.hint("merge"), ["view_id", "filename"]).join(imagery.tile_shares(kept, ["view_id"]).hint("merge"), "view_id")
    ask = ask.select(
        "view_id", F.col("filename").alias("photo"), F.col("rx0").alias("x0"), F.col("ry0").alias("y0"), F.col("rx1").alias("x1"),
        F.col("ry1").alias("y1"), F.col("scale").alias("need"), "per_frame",
    )
    return imagery.planned_regions(ask, levels, F.col("per_frame"))
