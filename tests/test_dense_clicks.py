"""Clicks stay cheap where drawn features lie densely: formulas are asked of few pairs."""

from aerolens.operators import features
from aerolens.operators.gridjoin import points_near_edges


def _outline(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SHAPE = "id string, seq long, kind string, label string, outline array<struct<x: double, y: double>>"


def test_only_edges_within_reach_make_pairs(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 60.0, 60.0), (3, 10.0, 90000.0)], "p int, px double, py double")
    edges = [(1, 0.0, 0.0, 20.0, 0.0), (2, 70.0, 10.0, 70.0, 90.0), (3, 10.0, -50.0, 10.0, 200000.0), (4, 95.0, 95.0, 96.0, 96.0), (5, 10.0, 10.0, 10.0, 10.0)]
    edges = spark.createDataFrame(edges, "e int, ax double, ay double, bx double, by double")
    pairs = points_near_edges(points, edges, 11.0, cell=100.0).select("p", "e")
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (1, 3), (1, 5), (2, 2), (3, 3)]


def test_inside_is_asked_for_clicks_that_nothing_is_near_to(spark, monkeypatch):
    square = _outline((0, 0), (1000, 0), (1000, 1000), (0, 1000))
    inner = _outline((400, 400), (600, 400), (600, 600), (400, 600))
    drawn = [("big", 1, "polygon", "", square), ("small", 2, "rectangle", "", inner), ("spot", 3, "point", "", _outline((700, 700)))]
    clicks = spark.createDataFrame([(1, 500.0, 500.0), (2, 702.0, 701.0), (3, 401.0, 500.0), (4, 100.0, 100.0), (5, 5000.0, 5000.0)], "click_id long, cx double, cy double")
    asked, around = [], features._around
    monkeypatch.setattr(features, "_around", lambda c, *a: asked.extend(r["click_id"] for r in c.collect()) or around(c, *a))
    got = features.hits(clicks, spark.createDataFrame(drawn, SHAPE))
    assert sorted(map(tuple, got.collect())) == [(1, "small", 3), (2, "spot", 0), (3, "small", 2), (4, "big", 3)]
    assert sorted(asked) == [1, 4, 5]
