import math

import pytest
from pyspark.sql import functions as F

from aerolens.operators import features, terrain

SHAPES = {
    1: [(0.0, 0.0), (90.0, 10.0), (70.0, 80.0), (-10.0, 60.0)],  # partly off its patch
    2: [(0.0, 0.0), (60.0, 60.0), (60.0, 0.0), (0.0, 50.0)],  # crosses itself
    3: [(10.0, 10.0), (110.0, 12.0), (110.0, 12.001)],  # a sliver between the samples
    4: [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)],  # no patch
    5: [(0.0, 0.0), (50.0, 0.0), (100.0, 0.0)],  # no area
    6: [(20.0, 20.0), (180.0, 30.0), (150.0, 190.0)],
}


def tables(spark):
    rows = [(k, k if k != 4 else 99, [{"x": x, "y": y} for x, y in ring]) for k, ring in SHAPES.items()]
    rows += [(None, 1, rows[0][2]), rows[5]]  # without a number, and a repeated row
    outlines = spark.createDataFrame(rows, "shape_id long, patch_id long, ring array<struct<x: double, y: double>>")
    height = lambda k, i, j: -9999.0 if (i * 7 + j * 11 + k) % 13 == 0 else 500.0 + (i * 3 + j * 5 + k) % 17
    patches = [(k, 7.0, -5.0 * k % 11, 3.0, -9999.0, [[height(k, i, j) for i in range(20)] for j in range(25)]) for k in (1, 2, 3, 5, 6, 7)]
    patches = spark.createDataFrame(patches, "patch_id long, cellSize double, lowerLeftX double, lowerLeftY double, noDataValue double, value array<array<double>>")
    return outlines, patches.unionByName(patches.where("patch_id = 6"))


def by_samples(outlines, patches, samples, plane=None):
    """Every sample a row, its four neighbours looked up one by one."""
    spots, flats = [], {}
    for r in outlines.where("shape_id IS NOT NULL").distinct().collect():
        ring = [(p.x, p.y) for p in r.ring]
        pairs = list(zip(ring, ring[1:] + ring[:1]))
        flat = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)) / 2
        if not flat > 0:
            continue
        flats[r.shape_id] = flat
        (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*ring))
        sp = max(1.0, math.sqrt((x1 - x0) * (y1 - y0) / samples))
        inside = [(x, y) for i in range(int((x1 - x0) / sp) + 1) for j in range(int((y1 - y0) / sp) + 1) if (x := x0 + sp * (i + 0.5)) < x1 and (y := y0 + sp * (j + 0.5)) < y1
                  and sum((a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in pairs) % 2]
        places = [(x, y, False) for x, y in inside] + [(sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring), True)]
        d = max(2.0, sp / 2)
        spots += [(r.shape_id, r.patch_id, n, spare, d, o, x + a * d, y + b * d) for n, (x, y, spare) in enumerate(places) for o, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    spots = outlines.sparkSession.createDataFrame(spots, "shape_id long, patch_id long, n long, spare boolean, d double, o int, x double, y double")
    heights = {}
    for r in terrain.with_heights(spots, patches.distinct()).collect():
        h = r.height if r.height is not None or plane is None else plane(r.x, r.y)
        heights.setdefault((r.shape_id, r.spare), {}).setdefault((r.n, r.d), {})[r.o] = h
    out = {}
    for k, flat in flats.items():
        means = []
        for spare in (False, True):
            good = [(h, d) for (_, d), h in heights.get((k, spare), {}).items() if None not in h.values()]
            means.append(sum(math.sqrt(1 + ((h[0] - h[1]) / (2 * d)) ** 2 + ((h[2] - h[3]) / (2 * d)) ** 2) for h, d in good) / len(good) if good else None)
        factor = means[0] if means[0] is not None else means[1]
        out[k] = (flat, None if factor is None else flat * factor)
    return out


def assert_same(found, want):
    rows = found.collect()
    assert sorted(r.shape_id for r in rows) == sorted([*want, 6])  # the repeated row stays
    for r in rows:
        flat, surface = want[r.shape_id]
        assert r.flat == pytest.approx(flat, rel=1e-9)
        assert r.surface == (None if surface is None else pytest.approx(surface, rel=1e-9)), r


@pytest.mark.parametrize("points", [1 << 18, 50])
def test_surfaces_against_single_samples(spark, monkeypatch, points):
    monkeypatch.setattr(features, "POINTS_AT_ONCE", points)
    outlines, patches = tables(spark)
    found = features.surface_areas(outlines, patches, 300)
    want = by_samples(outlines, patches, 300)
    assert want[4][1] is None and want[1][1] is not None
    assert_same(found, want)


def test_surfaces_with_a_plane_beyond_the_patch(spark):
    outlines, patches = tables(spark)
    far = [(-300.0, -300.0), (400.0, -300.0), (400.0, 500.0), (-300.0, 500.0)]
    plane = lambda x, y: 400 + 0.02 * x + 0.01 * y
    corners = {f"{c}{n}": F.lit(v) for n, (x, y) in enumerate(far) for c, v in (("x", x), ("y", y), ("z", plane(x, y)))}
    found = features.surface_areas(outlines.withColumns(corners), patches, 300)
    assert_same(found, by_samples(outlines, patches, 300, plane))


def test_samples_are_no_rows(spark):
    """Tens of thousands of samples of each outline were exploded, copied four times and joined with heights."""
    plan = features.surface_areas(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(" not in plan
