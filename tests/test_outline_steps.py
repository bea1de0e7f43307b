"""What a pair of a place and an outline costs: edges made once for an outline, sums and distances in single steps."""

from pyspark.sql import functions as F

from aerolens.functions import quads, rings, shapes
from aerolens.operators import select


def _outline(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_edges_of_outlines_are_not_made_for_each_pair(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(0.0).alias("z")) for x, y in [(0, 0), (100, 0), (100, 50), (50, 50), (50, 100), (0, 100)]])
    none = {f"{a}{n}": F.lit(None).cast("double") for n in range(4) for a in "xyz"}
    lens = {"x": 50.0, "y": 50.0, "z": 900.0, "cam_ccd_res_u": 3.76, "cam_focal_mm": 80.0}
    frames = spark.range(1).select(F.lit("f").alias("filename"), F.lit("Color").alias("camera"), F.lit(None).cast("double").alias("look_azimuth_deg"), F.lit(False).alias("is_reflight"),
                                   F.lit(None).cast("timestamp_ntz").alias("ts_utc"), F.lit("p").alias("pass_id"), F.lit(1).alias("shot"), ring.alias("ring"), *[c.alias(n) for n, c in none.items()], *[F.lit(v).alias(n) for n, v in lens.items()])
    points = spark.createDataFrame([(1, 25.0, 75.0), (2, 75.0, 75.0), (3, 50.0, 75.0), (4, 20.0, 20.0)], "point_id int, px double, py double")
    pairs = select.covering_pairs(points, select.with_outline_terms(frames), ["point_id"])
    assert sorted((r["point_id"], round(r["__to_edge"], 6)) for r in pairs.collect()) == [(1, 25.0), (3, 0.0), (4, 20.0)]
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not any("zip_with" in line for line in joins)


def test_sums_and_distances_in_steps_are_those_of_the_formulas(spark):
    ring = _outline((3, 1), (907, 15), (640, 333), (650, 700), (12, 801))
    df = spark.createDataFrame([(ring, 77.0, 500.0), (ring, 3.0, 1.0), (ring, -9.0, None)], "ring array<struct<x: double, y: double>>, px double, py double")
    ring, px, py = F.col("ring"), F.col("px"), F.col("py")
    plain = F.sqrt(F.array_min(F.transform(rings.edges(ring), lambda e: quads.segment_distance_sq(e["ax"], e["ay"], e["bx"], e["by"], px, py))))
    mx, my = rings.moments_twice(ring)
    t = rings.sums_twice(ring)
    for a, b, c, d, e, f, g, h in df.select(plain, rings.edge_distance(ring, px, py), rings.signed_area_twice(ring), t["a"], mx, t["mx"], my, t["my"]).collect():
        assert (a, c, e, g) == (b, d, f, h)
    assert df.select(shapes.covers(F.array(F.array(ring)), px, py).alias("c")).collect()[1]["c"] is True
