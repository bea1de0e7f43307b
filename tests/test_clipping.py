"""Clipped points counted by cells against brute force."""

import random

import pytest

from aerolens.operators import pointcloud


def _areas(spark, rings):
    box = lambda g: [min(x for x, _ in g), min(y for _, y in g), max(x for x, _ in g), max(y for _, y in g)]
    rows = [(n, [(float(x), float(y)) for x, y in g], *map(float, box(g))) for n, g in rings]
    return spark.createDataFrame(rows, "area_id int, grid array<struct<x: double, y: double>>, ax0 double, ay0 double, ax1 double, ay1 double")


def _points(spark, rows):
    return spark.createDataFrame(rows, "file long, key string, x double, y double, z double")


RINGS = [
    (1, [(100, 100), (6100, 300), (5500, 5200), (700, 6400)]),
    (2, [(1000, 1000), (5000, 5000), (5000, 1000), (1000, 5000)]),  # crosses itself
    (3, [(0, 0), (4000, 0), (4000, 500), (500, 500), (500, 4000), (0, 4000)]),
    (3, [(200, 200), (203, 200), (203, 209)]),  # an id used twice, smaller than any cell
    (None, [(-900, -900), (900, -900), (900, 900), (-900, 900)]),
    (4, [(50000, 50000), (51000, 50000), (51000, 51000)]),
]


@pytest.mark.parametrize("each", [1, 16, 10**9])
def test_chunks_by_cells_equal_single_points(spark, each):
    draw = random.Random(5)
    rows = [(n % 3, f"{n % 5}-0", draw.choice([0.0, 1500.0, 3000.0, draw.uniform(-1000, 7000)]), draw.uniform(-1000, 7000), draw.choice([None, float(n % 17)])) for n in range(4000)]
    rows += rows[:50] + [(None, None, 1200.0, 1100.0, 3.0), (1, "a", None, 5.0, 1.0), (1, "a", float("nan"), 5.0, 1.0), (1, "a", float("inf"), 5.0, 1.0)]
    points, areas = _points(spark, rows), _areas(spark, RINGS)
    want = pointcloud.chunk_sizes(pointcloud.clipped_points(points, areas))
    got = pointcloud.clipped_chunks(points, areas, each=each)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert want.count() > 20


def test_points_deep_inside_many_areas_are_not_met_one_by_one(spark):
    draw = random.Random(6)
    points = _points(spark, [(0, "0", draw.uniform(0, 6000), draw.uniform(0, 6000), 1.0) for _ in range(20000)])
    areas = _areas(spark, [(n, [(n, n), (6000 - n, 5), (5990, 5990 - n), (5, 6000)]) for n in range(10)])
    pairs = pointcloud.clipped_points(points, areas).count()
    assert pairs > 150000
    assert pointcloud.clipped_parts(points, areas).count() < pairs / 5


def test_no_points_make_no_chunks(spark):
    assert pointcloud.clipped_chunks(_points(spark, []), _areas(spark, RINGS)).count() == 0
