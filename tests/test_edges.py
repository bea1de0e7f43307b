"""Rows that the synthetic survey does not have."""

import struct

import pytest
from pyspark.sql import functions as F

from aerolens.catalog import domain
from aerolens.operators import expect, imagery, pointcloud, select
from aerolens.operators.features import on_grid, repaired
from aerolens.operators.select import candidates, with_outline_terms
from aerolens.sources import geoparquet, tables, wkb


def test_equal_region_requests_keep_their_rows(spark):
    levels = spark.createDataFrame([("a", 0, 4000, 3000, 256, 256), ("a", 1, 2000, 1500, 256, 256), ("a", 2, 500, 375, 256, 256)], "photo string, level int, width int, height int, tile_width int, tile_height int")
    asked = spark.createDataFrame([("a", 10.0, 10.0, 900.0, 900.0, 0.4)] * 2 + [("a", 5000.0, 1.0, 6000.0, 2.0, 1.0)], "photo string, x0 double, y0 double, x1 double, y1 double, need double")
    rows = imagery.planned_regions(asked, levels).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert (rows[0].level, rows[0].col0, rows[0].col1, rows[0].tiles) == (1, 0, 1, 4)


def test_first_level_over_budget_stops_there(spark):
    pairs = spark.createDataFrame([(1, 0, 100, 10, 1.0), (1, 2, 5, 1, 1.0), (2, 0, 10, 1, 1.0), (2, 1, 95, 1, 1.0), (2, 2, 1, 1, 1.0)], "area_id int, depth int, count long, length long, share double")
    got = {r.area_id: (r.chosen, r.over) for r in pointcloud.depth_under_budget(pairs, 50, 1000).collect()}
    assert got == {1: (0, True), 2: (0, False)}


@pytest.mark.parametrize(
    "text, seconds",
    [("09:05:01", 32701), ("9:05:01", 32701), ("12:00:00.5", 43200.5), ("9:5:1", 32701), ("12:00", 43200), (" 23:59:59 ", 86399), ("12:00:60", None), ("24:10:00", None), ("x", None), (None, None), ("12:00:00.1234567", 43200.123456)],
)
def test_times_of_day(spark, text, seconds):
    got = spark.createDataFrame([(text,)], "t string").select(expect.clock_of(F.col("t")).alias("s")).first().s
    assert (got is None) == (seconds is None) and (got is None or float(got) == seconds)


def test_look_texts_and_names(spark):
    looks = spark.createDataFrame([("\tnorth\n",), ("45\n",), ("45\n6",), ("down",)], "t string").select(select.parse_look(F.col("t")).alias("p")).collect()
    assert [(r.p.ok, r.p.label) for r in looks] == [(True, "north"), (True, "45"), (False, None), (True, "down")]
    names = spark.createDataFrame([("A.B_2020_Season1_3IN/Fwd_1_2.tif",), ("AxB_2020_Season1_3IN/Fwd_1_2.tif",), ("A.B_2020_Season1_3IN/Fwd_1_2.tif\n",)], "f string")
    assert [r.ok for r in names.select(select.name_request_ok(F.col("f"), "A.B_", "_3IN").alias("ok")).collect()] == [True, False, False]


def test_features_with_one_id_stay_one_row_each(spark, sf):
    one = on_grid(repaired(domain.drawn(spark, sf))).limit(1)
    three = one.unionByName(one).unionByName(one)
    assert tables.geojson_features(three).count() == 3
    assert geoparquet.prepared(three).count() == 3


def test_outlines_of_any_shape_are_kept_whole(spark, sf):
    def polygon(points):
        return struct.pack("<BIII", 1, 1003, 1, len(points)) + b"".join(struct.pack("<3d", *p) for p in points)

    # An L of six corners around the same place as a square, with the notch in the north-east.
    ell = [(0, 0, 5), (10, 0, 5), (10, 10, 5), (5, 10, 7), (5, 20, 7), (0, 20, 5), (0, 0, 5)]
    square = [(0, 0, 5), (10, 0, 5), (10, 20, 5), (0, 20, 5), (0, 0, 5)]
    frame = domain.frames(spark, sf).where("camera = 'Color'").limit(1).drop(*[f"{a}{n}" for a in "xyz" for n in range(4)], "xmin", "ymin", "xmax", "ymax", "cen_x", "cen_y", "sqrt_area", "z_mid", "turning")
    extra = spark.createDataFrame([("ell", polygon(ell)), ("square", polygon(square)), ("point", struct.pack("<BI2d", 1, 1, 1.0, 2.0)), ("none", None)], "filename string, footprint_wkb binary")
    frames = with_outline_terms(wkb.with_outlines(frame.drop("filename").crossJoin(extra)))
    found = {r.filename: r for r in frames.collect()}
    assert found["ell"].sqrt_area ** 2 == pytest.approx(150) and found["square"].sqrt_area ** 2 == pytest.approx(200)
    assert found["ell"].x0 is None and found["square"].x2 == 10.0 and found["point"].ring is None and found["ell"].z_mid == 6.0
    asked = spark.createDataFrame([(1, 2.0, 15.0, None), (2, 7.0, 15.0, None), (3, 7.0, 10.0, None), (4, 11.0, 5.0, None)], "point_id int, px double, py double, want_azimuth double")
    got = candidates(asked, frames.where("filename IN ('ell', 'square')")).collect()
    assert {(r.point_id, r.filename) for r in got} == {(1, "ell"), (1, "square"), (2, "square"), (3, "ell"), (3, "square")}
    assert next(r for r in got if (r.point_id, r.filename) == (1, "ell")).edge_frac == pytest.approx(2 / 150**0.5)


def _polygon(rings, dims="z", order="<", kind=3, ewkb=False):
    """WKB of one polygon; `dims` is any of "", "z", "m", "zm"."""
    iso = {"": 0, "z": 1000, "m": 2000, "zm": 3000}[dims]
    code = kind | (0x80000000 * ("z" in dims)) | (0x40000000 * ("m" in dims)) | 0x20000000 if ewkb else kind + iso
    out = struct.pack(order + "BI", order == "<", code) + (struct.pack(order + "I", 3089) if ewkb else b"") + struct.pack(order + "I", len(rings))
    for ring in rings:
        out += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + f"{2 + len(dims)}d", *p[:2], *([p[2]] if "z" in dims else []), *([9.5] if "m" in dims else [])) for p in ring)
    return out


OUTER = [(0, 0, 5), (10, 0, 5), (10, 20, 6), (0, 20, 5), (0, 0, 5)]
HOLE = [(2, 4, 5), (8, 4, 5), (8, 12, 5), (2, 12, 5), (2, 4, 5)]
OTHER = [(20, 0, 1), (30, 0, 1), (25, 10, 1), (20, 0, 1)]


def test_wkb_of_any_dialect_holes_and_parts(spark):
    multi = struct.pack("<BII", 1, 1006, 2) + _polygon([OUTER, HOLE]) + _polygon([OTHER], order=">")
    blobs = {
        "plain": _polygon([OUTER], ""), "z": _polygon([OUTER]), "m": _polygon([OUTER], "m"), "zm": _polygon([OUTER], "zm"), "big": _polygon([OUTER], "zm", ">"),
        "ewkb": _polygon([OUTER, HOLE], "zm", ewkb=True), "hole": _polygon([OUTER, HOLE]), "multi": multi, "empty": _polygon([]), "none of it": struct.pack("<BII", 1, 6, 0),
        "point": struct.pack("<BI2d", 1, 1, 1.0, 2.0), "line": struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0), "null": None,
    }
    found = {r.name: r for r in wkb.with_outlines(spark.createDataFrame(list(blobs.items()) * 3, "name string, footprint_wkb binary").repartition(2)).collect()}
    assert [found[n].x2 for n in ("plain", "z", "m", "zm", "big")] == [10.0] * 5 and [found[n].z2 for n in ("plain", "m", "zm", "big")] == [0.0, 0.0, 6.0, 6.0]
    for name, parts in (("hole", 1), ("ewkb", 1), ("multi", 2)):
        r = found[name]
        assert r.x0 is None and len(r.parts) == parts and [tuple(p) for p in r.parts[0][1]] == HOLE and [tuple(p) for p in r.ring] == OUTER
    assert [tuple(p) for p in found["multi"].parts[1][0]] == OTHER
    assert [found[n].ring for n in ("empty", "none of it", "point", "line", "null")] == [[], [], None, None, None]


def test_wkb_round_trip_of_shapes(spark):
    shapes_in = [[[OUTER]], [[OUTER, HOLE]], [[OUTER, HOLE], [OTHER]], [], [[]], None, [[OTHER]]]
    kind = "array<array<array<struct<x: double, y: double, z: double>>>>"
    given = spark.createDataFrame([(k, None if s is None else [[[tuple(map(float, p)) for p in r] for r in part] for part in s]) for k, s in enumerate(shapes_in)], f"k int, shape {kind}")
    back = given.select("k", wkb.shape_to_wkb(F.col("shape")).alias("b")).select("k", wkb._decode(F.col("b")).alias("s"))
    assert [None if r.s is None else [[[tuple(p) for p in ring] for ring in part] for part in r.s] for r in back.orderBy("k").collect()] == shapes_in


def test_long_outline_crossings_and_health(spark):
    import math

    n = 20_000
    star = [(1000 * math.cos(2 * math.pi * k / n) * (1 + k % 2 * 0.01), 1000 * math.sin(2 * math.pi * k / n) * (1 + k % 2 * 0.01), 0.0) for k in range(n)]
    cut = list(star)
    cut[15_000] = (0.0, 1500.0, 0.0)  # one vertex drawn through the far side
    rows = [("star", [star]), ("cut", [cut]), ("hole across", [OUTER, [(8, 4, 0), (12, 4, 0), (12, 8, 0), (8, 8, 0)]]), ("two corners", [[(0, 0, 0), (1, 1, 0)]])]
    frames = wkb.with_outlines(spark.createDataFrame([(f, _polygon(r)) for f, r in rows], "filename string, footprint_wkb binary"))
    got = {r.filename: r.outline_state for r in expect.with_validity(frames).collect()}
    assert got == {"star": "valid", "cut": "invalid", "hole across": "invalid", "two corners": "invalid"}


def test_scene_and_rules_take_outlines_of_any_kind(spark, sf):
    from aerolens.catalog import outlines
    from aerolens.plans import scene

    f = outlines._shaped(spark, sf)
    height = f.where("size(ring) > 0").select((F.col("x0").isNull()).alias("odd"), scene._ground(f.columns).alias("h")).groupBy("odd").agg(F.count("*").alias("n"), F.count("h").alias("k")).collect()
    assert len(height) == 2 and all(r.n == r.k for r in height)
    bad = expect.rules(f.where("size(ring) > 0"), {"away": expect.misdirected(f.columns).isNull()}).first().n_bad
    assert bad == f.where("size(ring) > 0 AND x0 IS NULL AND cen_x IS NULL").count()


def test_edges_meet_every_cell_they_run_through(spark):
    import random

    from aerolens.operators.gridjoin import points_near_edges

    rng = random.Random(4)
    edges = [(0, 5.0, 5.0, 5.0, 5.0), (1, 0.0, 50.0, 400.0, 50.0), (2, 70.0, -200.0, 70.0, 300.0)]
    edges += [(k, *(rng.uniform(-300, 300) for _ in range(4))) for k in range(3, 60)]
    points = [(k, rng.uniform(-320, 320), rng.uniform(-320, 320)) for k in range(1500)] + [(1500, 399.0, 55.0), (1501, 5.0, 13.0)]

    def far(e, p):
        (ax, ay, bx, by), (x, y) = e[1:], p[1:]
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else 0
        return ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5

    want = {(p[0], e[0]) for e in edges for p in points if far(e, p) <= 9}
    pairs = points_near_edges(spark.createDataFrame(points, "p int, px double, py double"), spark.createDataFrame(edges, "e int, ax double, ay double, bx double, by double"), 9.0, cell=40.0).select("p", "e").collect()
    got = [(r.p, r.e) for r in pairs]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < 20 * len(want)
