"""Formulas of many steps run in methods that the JVM compiles."""

from pyspark.sql import functions as F

from aerolens.catalog import load
from aerolens.session import COMPILED_BYTES, compiled

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_photo_corners_do_not_run_in_a_method_too_long_to_compile(spark, sf):
    had, adaptive = spark.conf.get(LIMIT), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set(LIMIT, "65535")
        out = load()[0]["p4_photo_corners"](spark, sf)
        assert int(spark.conf.get(LIMIT)) <= COMPILED_BYTES
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = out.agg(F.count("*"), F.count("lon0"), F.min("lat3")).collect()[0]
        spark.conf.set(LIMIT, "65535")
        assert rows == out.agg(F.count("*"), F.count("lon0"), F.min("lat3")).collect()[0] and rows[0] > 0
    finally:
        spark.conf.set(LIMIT, had)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_lower_limit_of_the_session_is_kept(spark):
    had = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "5000")
        compiled(spark)
        assert spark.conf.get(LIMIT) == "5000"
    finally:
        spark.conf.set(LIMIT, had)
