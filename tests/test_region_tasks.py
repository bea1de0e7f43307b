"""Region plans are dealt to tasks whatever their size in bytes."""

from pyspark.sql import functions as F

from aerolens.operators import imagery


def test_region_plans_are_not_put_into_one_task(spark):
    size = lambda n: F.floor(F.lit(n) / F.pow(F.lit(2.0), F.col("level"))).cast("int")
    levels = spark.range(200).select(F.col("id").alias("photo"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    levels = levels.select("photo", "level", size(8000).alias("width"), size(6000).alias("height"), F.lit(512).alias("tile_width"), F.lit(512).alias("tile_height"))
    side = lambda n: F.lit(float(n))
    regions = spark.range(250).select(
        F.when(F.col("id") < 240, F.col("id") % 200).alias("photo"), side(100).alias("x0"), side(200).alias("y0"), side(3100).alias("x1"), side(2200).alias("y1"), F.lit(0.5).alias("need")
    )
    plans = imagery.planned_regions(regions, levels)
    held = plans.select(F.spark_partition_id().alias("task")).distinct().count()
    assert held == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = plans.collect()
    assert len(rows) == 240 and {r["level"] for r in rows} == {1}
