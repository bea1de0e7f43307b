"""Byte chunks read the ends of a range once for it; what the ends come from is not made again for a filter."""

from pyspark.sql import functions as F

from aerolens.operators import imagery


def test_tile_lists_are_made_once_for_a_chunked_level(spark):
    tiles = F.sequence(F.lit(0), F.col("n") - 1)
    levels = spark.range(40).select(F.col("id").alias("photo"), (F.col("id") % 5 + 1).cast("int").alias("n"))
    levels = levels.withColumns({"offsets": F.transform(tiles, lambda i: i.cast("long") * 1000), "byte_counts": F.transform(tiles, lambda i: i * 10 + 7)})
    out = imagery.byte_chunks(imagery.with_span(levels), 512, ["photo"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1 and plan.count("transform(") == 2
    want = {(p, at, min(at + 512, end)) for p in range(40) for end in [p % 5 * 1000 + p % 5 * 10 + 7] for at in range(0, end, 512)}
    assert {tuple(r) for r in out.collect()} == want


def test_empty_and_unknown_ranges_have_no_chunks(spark):
    rows = [(1, 0, 10), (2, 5, 5), (3, 9, 4), (4, None, 4), (5, 4, None), (6, 7, 8)]
    out = imagery.byte_chunks(spark.createDataFrame(rows, "k int, start long, end long"), 4, ["k"])
    assert {tuple(r) for r in out.collect()} == {(1, 0, 4), (1, 4, 8), (1, 8, 10), (6, 7, 8)}
