"""Frames and copies of points are never gathered in the driver, however small their files look."""

from pyspark.sql import functions as F

from aerolens.catalog import domain
from aerolens.operators import evaluate, select


def _gathered(df):
    """Keys of the joins whose one side is sent through the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_review_payload_gathers_neither_frames_nor_points(spark, sf):
    frames = domain.frames(spark, sf)
    sets = frames.where("k % 20 = 1").select(
        F.lit("a").alias("category"), F.col("filename").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(0.0).alias("want_azimuth")
    )
    out = evaluate.review_payload(sets, frames)
    kinds = [line for line in _gathered(out) if "[filename#" in line or "__l#" in line]
    assert kinds == []
    assert out.where(F.size("cands") > 0).count() > 0


def test_candidates_gather_neither_frames_nor_points(spark, sf):
    out = select.candidates(domain.points(spark, sf), domain.frames(spark, sf))
    assert [line for line in _gathered(out) if "__l#" in line] == []
