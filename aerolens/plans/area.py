"""The area job: what to read of the point clouds under areas of interest, and the points themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aerolens.operators import pointcloud
from aerolens.session import staged


def load(areas: DataFrame, tiles: DataFrame, nodes: DataFrame, points: DataFrame, max_points: float = pointcloud.MAX_POINTS, max_bytes: float = pointcloud.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(points inside the areas down to the planned depth, one summary row per area).

    The plan comes first and the point table is joined with it on (file, key), so only planned nodes are clipped. An area
    reads the nodes of its own tiles alone, whatever other areas are asked with it; one that needs more tiles than a load
    may read has none.
    """
    grid = staged(pointcloud.grid_areas(pointcloud.within_limit(areas).select("area_id", "ring")))
    chosen = staged(pointcloud.tiles_for_areas(tiles, grid))
    loaded = chosen.where("NOT refused")
    own = loaded.select("area_id", F.col("tile_id").alias("file")).distinct()
    read = nodes.join(own.select("file").distinct(), "file", "left_semi")
    pairs = pointcloud.nodes_over_areas(pointcloud.with_node_boxes(read), grid)
    pairs = staged(pairs.join(own, ["area_id", "file"], "left_semi"))
    plan = pointcloud.depth_under_budget(pairs, max_points, max_bytes)
    wanted = pointcloud.selected_nodes(pairs, plan).select("area_id", "file", "key")
    asked = points.join(wanted.select("file", "key").distinct(), ["file", "key"], "left_semi")
    planned = lambda df: df.join(wanted, ["area_id", "file", "key"], "left_semi")
    # The summary counts whole cells at once: a row for every point and area would grow with the product of both.
    chunks = planned(pointcloud.clipped_chunks(asked, grid))
    return planned(pointcloud.clipped_points(asked, grid)), pointcloud.load_summary(plan, loaded, chunks)
