"""Golden values and round trips of the column formulas."""

import math

from pyspark.sql import functions as F

from aerolens.functions import angles, crs, quads, rings, text
from aerolens.functions.camera import Rig, with_rotation
from aerolens.operators import features


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_projection_golden_and_round_trip(spark):
    x, y = crs.lonlat_to_grid(F.lit(-85.7), F.lit(38.2))
    row = one(spark, x.alias("x"), y.alias("y"))
    assert abs(row.x - 4935617.826942463) < 1e-4 and abs(row.y - 3960523.040211461) < 1e-4
    pts = spark.range(400).select((F.col("id") % 20 * 70000.0 + 4200000).alias("x"), (F.floor(F.col("id") / 20) * 50000.0 + 3400000).alias("y"))
    lon, lat = crs.grid_to_lonlat(F.col("x"), F.col("y"))
    back = pts.withColumns({"lon": lon, "lat": lat})
    bx, by = crs.lonlat_to_grid(F.col("lon"), F.col("lat"))
    assert back.select(F.max(quads.distance(bx, by, F.col("x"), F.col("y")))).first()[0] < 1e-6


def test_world_square_round_trip(spark):
    wx, wy = crs.lonlat_to_world(F.lit(-85.7), F.lit(38.2))
    lon, lat = crs.world_to_lonlat(wx, wy)
    row = one(spark, lon.alias("lon"), lat.alias("lat"))
    assert abs(row.lon + 85.7) < 1e-12 and abs(row.lat - 38.2) < 1e-12


def test_angles(spark):
    row = one(
        spark, angles.half_turn(F.lit(-540.0)).alias("a"), angles.bearing_gap(F.lit(350.0), F.lit(20.0)).alias("b"),
        angles.compass_name(F.lit(-22.0)).alias("c"), angles.round_to(F.lit(-0.5), 0).alias("d"), text.fixed(F.lit(0.215), 2).alias("e"),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == (-180.0, 30.0, "north", 0.0, "0.21")


def test_vendor_corners_of_a_real_frame(spark):
    frame = spark.createDataFrame(
        [(5495535.866, 4039722.785, 4553.665, 44.93210699, 1.26580376, 1.35489962, 10300, 7700, 123.0, 5.2, 0.0, 0.0)],
        "x double, y double, z double, omega double, phi double, kappa double, cam_width_px int, cam_height_px int, cam_focal_mm double, "
        "cam_ccd_res_u double, cam_ppx_mm double, cam_ppy_mm double",
    )
    corners = [(5494016.043707391, 4044803.6170909354, 853.0166666666668, 0, 0), (5496718.039555418, 4044831.3313932843, 898.9483333333334, 10300, 0),
               (5496431.960695019, 4042410.624324153, 856.6647769158379, 10300, 7700), (5494483.7763753515, 4042327.5305453422, 882.4917822931307, 0, 7700)]
    rig = with_rotation(frame)
    for gx, gy, gz, col, row in corners:
        c, r = Rig().to_pixel(F.lit(gx), F.lit(gy), F.lit(gz))
        bx, by = Rig().to_ground(F.lit(float(col)), F.lit(float(row)), F.lit(gz))
        got = rig.select(c.alias("c"), r.alias("r"), bx.alias("x"), by.alias("y")).first()
        assert abs(got.c - col) < 0.5 and abs(got.r - row) < 0.5
        assert math.hypot(got.x - gx, got.y - gy) < 0.3
    behind = rig.select(Rig().to_pixel(F.col("x"), F.col("y"), F.col("z") + 100)[0]).first()[0]
    assert behind is None


def test_concave_and_crossing_outlines(spark):
    arrow = [(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0))]
    row = one(
        spark, quads.turning(arrow).alias("t"), quads.covers(arrow, F.lit(2.0), F.lit(2.0)).alias("out"), quads.covers(arrow, F.lit(0.5), F.lit(0.5)).alias("inn"),
        quads.covers(arrow, F.lit(2.0), F.lit(0.0)).alias("edge"), quads.area(arrow).alias("area"),
    )
    assert (row.t, row.out, row.inn, row.edge, row.area) == (0, False, True, True, 4.0)
    ring = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 2D, 'y', 0D), named_struct('x', 0D, 'y', 2D)) AS r")
    assert ring.select(rings.crosses_itself(F.col("r"))).first()[0] is True


def test_unit_text(spark):
    row = one(spark, text.length_text(F.lit(6000.0)).alias("a"), text.rise_text(F.lit(-12.34)).alias("b"), text.short_area_text(F.lit(87120.0)).alias("c"))
    assert row.a == "6,000 ft (1,829 m · 1.14 mi)" and row.b == "−12.3 ft (−3.8 m)" and row.c == "2.00 acres"


def test_label_of_a_crescent_is_inside(spark):
    at = lambda x, y: f"named_struct('lon', -85.7 + {x} * 0.001D, 'lat', 38.2 + {y} * 0.001D)"
    shape = ", ".join(at(*p) for p in ((0, 0), (3, 0), (3, 0.5), (0.5, 0.5), (0.5, 3), (0, 3)))
    df = spark.sql(f"SELECT 'a' AS id, 'polygon' AS kind, array({shape}) AS coordinates, CAST(NULL AS DOUBLE) AS radius_m")
    located = features.on_grid(df)
    lab = features.label_points(located).first()
    gx, gy = crs.lonlat_to_grid(F.lit(lab.lon), F.lit(lab.lat))
    assert located.select(rings.inside(F.col("outline"), gx, gy)).first()[0]
