from pyspark.sql import functions as F

from aerolens.catalog import domain, photos
from aerolens.operators import photo


def test_small_patches_share_a_group(spark, sf):
    """Groups of 64 patches, however small, cost more than their rays; the answers do not depend on the groups."""
    f = domain.frames(spark, sf)
    rays = f.where("cam > 0").select(F.col("k").alias("ray_id"), "filename", (F.col("cam_width_px") / 3.0).alias("col"), (F.col("cam_height_px") / 2.0).alias("row"), F.lit(500.0).alias("around"))
    patches = photos._plane_patches(spark, sf)
    found = [photo.ground_at_pixels(rays, f, patches, group_patches=n, group_cells=c).orderBy("ray_id").collect() for n, c in ((1 << 30, 1 << 30), (10, 400 * 50), (64, 1 << 20))]
    assert found[0] == found[1] == found[2] and sum(r.gz is not None for r in found[0]) > 0
    assert patches.select(F.min(F.size("value")), F.max(F.size(F.col("value")[19]))).first() == (20, 20)
