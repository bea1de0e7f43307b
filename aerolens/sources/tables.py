"""Table sinks and JSON sources and sinks: the frame table, terrain patches, catalogue items, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.functions.crs import lonlat_to_grid
from aerolens.operators.features import attribute_columns, with_geometry

PATCH_SCHEMA = "patch_id bigint, cellSize double, lowerLeftX double, lowerLeftY double, noDataValue double, value array<array<double>>"
ITEM_SCHEMA = (
    "id string, bbox array<double>, properties struct<`proj:bbox`: array<double>, `pc:count`: bigint, datetime: string, `proj:wkt2`: string>, "
    "assets struct<pointcloud: struct<href: string>>"
)
ZONE = r"Kentucky Single Zone \(ftUS\)"
FRAME_ORDER = ("season_key", "pass_id", "shot", "camera")


class CountsDiffer(Exception):
    """A published table does not hold the rows it was made from."""


def write_sorted(df: DataFrame, path: str, order: tuple[str, ...] = FRAME_ORDER, partition_by: str | None = "season_key", files: int | None = None) -> None:
    """Sorted ZSTD Parquet: range-partitioned by the whole key, so one long pass is still spread over many files."""
    parted = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    out = parted.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def read_without(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).drop(*columns)


def publish(df: DataFrame, path: str, order: tuple[str, ...] = FRAME_ORDER, partition_by: str | None = "season_key") -> DataFrame:
    """Replace a table and compare row counts: source and target must agree."""
    write_sorted(df, path, order, partition_by)
    target = df.sparkSession.read.parquet(path)
    expected, actual = df.count(), target.count()
    if expected != actual:
        raise CountsDiffer(f"{path}: {expected} rows expected, {actual} found")
    return target


def read_patches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Elevation patches from JSON; a patch without its id in the file takes the file's name."""
    return spark.read.schema(PATCH_SCHEMA).option("multiLine", multi_line).json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_SCHEMA).json(path)


def catalogue_items(raw: DataFrame, phase: Column | int) -> DataFrame:
    """Catalogue items as tiles with a grid box; `state` is usable, foreign (another coordinate system) or unusable."""
    p = F.col("properties")
    wkt, proj, box = p["proj:wkt2"], p["proj:bbox"], F.col("bbox")
    ax, ay = lonlat_to_grid(F.get(box, F.lit(0)), F.get(box, F.lit(1)))
    bx, by = lonlat_to_grid(F.get(box, F.lit(2)), F.get(box, F.lit(3)))
    own, far = F.coalesce(F.size(proj) >= 4, F.lit(False)), F.coalesce(F.size(box) >= 4, F.lit(False))
    sides = [(F.least(ax, bx), 0), (F.least(ay, by), 1), (F.greatest(ax, bx), 2), (F.greatest(ay, by), 3)]
    pick = [F.when(own, F.get(proj, F.lit(i))).when(far, v) for v, i in sides]
    href = F.col("assets.pointcloud.href")
    state = (
        F.when(href.isNull() | (href == ""), "unusable")
        .when(wkt.isNotNull() & ~wkt.rlike(ZONE), "foreign")
        .when(~own & ~far, "unusable")
        .otherwise("usable")
    )
    return raw.select(
        F.col("id").alias("tile_id"), (phase if isinstance(phase, Column) else F.lit(phase)).alias("phase"), href.alias("href"),
        *[c.alias(n) for c, n in zip(pick, ("xmin", "ymin", "xmax", "ymax"))], F.coalesce(p["pc:count"], F.lit(0)).alias("count"),
        p["datetime"].alias("datetime"), state.alias("state"),
    )


def geojson_features(located: DataFrame) -> DataFrame:
    """One GeoJSON feature per row (id, json): degrees, polygons closed, attributes with their empty values."""
    pair = lambda q: F.array(q["lon"], q["lat"])
    line = F.transform("path", pair)
    coords = (
        F.when(F.col("type") == "Point", F.to_json(pair(F.col("path")[0])))
        .when(F.col("type") == "LineString", F.to_json(line))
        .otherwise(F.to_json(F.array(line)))
    )
    properties = F.to_json(F.struct(*attribute_columns()), {"ignoreNullFields": "false"})
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    feature = F.concat(
        F.lit('{"type":"Feature","id":'), quoted(F.col("id")), F.lit(',"geometry":{"type":"'), "type", F.lit('","coordinates":'), coords,
        F.lit('},"properties":'), properties, F.lit("}"),
    )
    return with_geometry(located).select("id", feature.alias("json"))


def write_geojson(located: DataFrame, path: str) -> None:
    """Newline-delimited features, one file per task."""
    geojson_features(located).select("json").write.mode("overwrite").text(path)
