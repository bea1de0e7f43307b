import math
import random

from pyspark.sql import functions as F

from aerolens.functions import shapes
from aerolens.operators import expect
from aerolens.plans import scene


def ring(points):
    return [{"x": float(x), "y": float(y), "z": 0.0} for x, y in points]


def cases():
    rng = random.Random(4)
    square, bow = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 10), (10, 0), (0, 10)]
    out = {
        "square": [[ring(square)]], "closed": [[ring([*square, square[0]])]], "bow": [[ring(bow)]], "closed bow": [[ring([*bow, bow[0]])]],
        "stuttering": [[ring([(0, 0), (0, 0), (10, 0), (10, 10), (10, 10), (0, 10)])]], "spot": [[ring([(1, 1)] * 4)]], "none": [[]],
        "hole within": [[ring(square), ring([(2, 2), (4, 2), (4, 4)])]], "hole across": [[ring(square), ring([(8, 2), (14, 3), (8, 4)])]],
        "parts across": [[ring(square)], [ring([(5, 5), (15, 5), (15, 15)])]], "touching": [[ring([(0, 0), (10, 0), (5, 0), (5, 5)])]],
    }
    round_ = [(100 * math.cos(a / 15), 100 * math.sin(a / 15)) for a in range(94)]
    out |= {"round": [[ring(round_)]], "round across": [[ring([*round_[:50], (300, 0), (-300, 1), *round_[50:]])]]}
    return out | {f"any {n}": [[ring([(rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(3, 8))])] for _ in range(rng.randrange(1, 3))] for n in range(40)}


def test_crossings_on_rows_and_in_cells(spark, monkeypatch):
    """Outlines of a few corners were brought together edge by edge through shuffles, with their names, like long ones."""
    rows = list(cases().items())
    df = spark.createDataFrame([*rows, (None, dict(rows)["bow"]), rows[2]], "name string, parts array<array<array<struct<x: double, y: double, z: double>>>>")
    keys = lambda: [r.name for r in expect.crossing_shapes(df, "name", F.col("parts")).collect()]
    found = {}
    for limit in (0, 64, 1000):
        monkeypatch.setattr(expect, "ALL_PAIRS", limit)
        names = keys()
        assert len(names) == len(set(names))
        found[limit] = set(names)
    assert found[0] == found[64] == found[1000]
    assert {"bow", "closed bow", "hole across", "parts across", "round across"} <= found[64] and None not in found[64]
    assert not found[64] & {"square", "closed", "stuttering", "spot", "none", "hole within", "touching", "round"}
    few = df.select("name", shapes.edge_list(F.col("parts")).alias("edges")).where(shapes.crosses_itself(F.col("edges")))
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert {r.name for r in few.collect()} - {None} == found[0]


def test_places_of_views_are_not_gathered(spark):
    """81 places are exploded of each view: Spark takes the table for as small as the views and would gather it in the driver."""
    views = spark.range(1000).select(F.col("id").alias("view_id"), *[F.lit(v).alias(c) for c, v in (("west", -85.8), ("south", 38.1), ("east", -85.7), ("north", 38.2))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    stack = views.select("view_id", F.lit("f").alias("filename"))
    plain = stack.join(scene._spread(views, 9), "view_id")._jdf.queryExecution().executedPlan().toString()
    merged = scene.with_places(stack, views, 9)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plain and "BroadcastExchange" not in merged
    assert scene.with_places(stack, views, 9).count() == 81_000
