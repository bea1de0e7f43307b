"""Queries over sources and sinks (S) and whole jobs: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.drawing import _REPAIRED, _located
from aerolens.catalog.registry import R, query, r
from aerolens.operators import normalise, terrain
from aerolens.plans import area, ingest
from aerolens.session import work_folder
from aerolens.sources import geoparquet, tables, wkb


def _folder(spark, sf, name):
    return f"{work_folder(spark)}/{name}-{abs(hash(sf)) % 10**8}"


@query("s3_union", "raw_frames raw_frames_faulty", "SELECT season_key, count(*) AS n FROM (SELECT season_key, rn FROM raw_frames UNION ALL SELECT season_key, rn FROM raw_frames_faulty) GROUP BY 1")
def s3(spark, sf):
    return domain.raw_frames(spark, sf).unionByName(domain.raw_frames_faulty(spark, sf)).groupBy("season_key").agg(F.count("*").alias("n"))


@query("s4_s5_sorted_table", "frames", "SELECT filename, season_key, pass_id, shot, camera, x, y FROM frames")
def s5(spark, sf):
    path = _folder(spark, sf, "sorted")
    tables.write_sorted(domain.frames(spark, sf), path)
    return tables.read_without(spark, path, "cam_name").select("filename", "season_key", "pass_id", "shot", "camera", "x", "y")


@query("s6_ingest_job", "norm", f"SELECT filename, season_key, pass_id, is_reflight, {r('look_azimuth_deg')} AS look_azimuth_deg, kappa_flag, dup_count FROM norm")
def s6(spark, sf):
    survey = ingest.Survey(domain.IMAGE_BASE, domain.FOLDER_PREFIX, domain.FOLDER_SUFFIX)
    kept, _ = ingest.run(domain.raw_frames(spark, sf), domain.raw_eo(spark, sf), survey, _folder(spark, sf, "ingest"))
    return kept.select("filename", "season_key", "pass_id", "is_reflight", R(F.col("look_azimuth_deg")).alias("look_azimuth_deg"), "kappa_flag", "dup_count")


@query("s7_s12_wkb", "frames", "SELECT filename, 5 AS n, x0, y1, x2, y3 FROM frames")
def s7(spark, sf):
    path = F.array(*[F.struct(F.col(f"x{i % 4}").alias("lon"), F.col(f"y{i % 4}").alias("lat")) for i in range(5)])
    coded = domain.frames(spark, sf).select("filename", wkb.to_wkb(F.lit("Polygon"), path).alias("footprint_wkb"))
    return wkb.with_outlines(coded).select("filename", F.size("ring").alias("n"), "x0", "y1", "x2", "y3")


@query("s8_terrain_json", "cells", "SELECT patch_id, i, j, z FROM cells")
def s8(spark, sf):
    path = _folder(spark, sf, "patches")
    domain.terrain_patches(spark, sf).write.mode("overwrite").json(path)
    return terrain.cells(tables.read_patches(spark, path))


@query("s9_catalogue_items", "", f"""WITH t AS (SELECT s_suppkey AS k, -85.8e0 + s_suppkey % 50 / 100e0 AS lon, 38.1e0 + s_suppkey % 40 / 100e0 AS lat FROM supplier)
SELECT 'tile' || k AS tile_id, k % 4 <> 3 AS has_box, CASE WHEN k % 11 = 0 THEN 'unusable' WHEN k % 7 = 0 THEN 'foreign' WHEN k % 4 = 3 THEN 'unusable' ELSE 'usable' END AS state,
 CASE WHEN k % 4 = 0 THEN 4900000e0 + k WHEN k % 4 IN (1, 2) THEN {r(f"least({s.grid_x('lon', 'lat')}, {s.grid_x('(lon + 0.01e0)', '(lat + 0.01e0)')})", 3)} END AS xmin FROM t""")  # fmt: skip
def s9(spark, sf):
    k = F.col("s_suppkey")
    lon, lat = F.lit(-85.8) + (k % 50) / 100.0, F.lit(38.1) + (k % 40) / 100.0
    own = F.when(k % 4 == 0, F.array((4900000 + k).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    raw = domain.table(spark, sf, "supplier").select(
        F.concat(F.lit("tile"), k.cast("string")).alias("id"), F.when(k % 4 != 3, F.array(lon, lat, lon + 0.01, lat + 0.01)).alias("bbox"),
        F.struct(own.alias("proj:bbox"), k.alias("pc:count"), F.when(k % 7 == 0, "Some Other Zone").otherwise("x Kentucky Single Zone (ftUS) y").alias("proj:wkt2")).alias("properties"),
        F.struct(F.struct(F.when(k % 11 != 0, F.lit("https://tiles.example/a.copc.laz")).alias("href")).alias("pointcloud")).alias("assets"),
    )
    path = _folder(spark, sf, "items")
    raw.write.mode("overwrite").json(path)
    out = tables.catalogue_items(tables.read_items(spark, path), 3)
    return out.select("tile_id", F.col("xmin").isNotNull().alias("has_box"), "state", R(F.col("xmin"), 3).alias("xmin"))


@query("s10_geojson", "drawn", f"""WITH {_REPAIRED} SELECT id, 'Feature' AS type, CASE WHEN kind IN ('point', 'text') THEN 'Point' WHEN kind = 'line' THEN 'LineString' ELSE 'Polygon' END AS geometry, kind, label, notes, color, created_at AS created FROM rep""")
def s10(spark, sf):
    path = _folder(spark, sf, "geojson")
    tables.write_geojson(_located(spark, sf), path)
    p = "struct<kind: string, label: string, notes: string, color: string, created: string>"
    back = spark.read.schema(f"type string, id string, geometry struct<type: string>, properties {p}").json(path)
    return back.select("id", "type", F.col("geometry.type").alias("geometry"), "properties.kind", "properties.label", "properties.notes", "properties.color", "properties.created")


@query("s11_geoparquet", "drawn", f"""WITH {_REPAIRED} SELECT id, kind, label, CASE WHEN kind = 'circle' THEN radius_m END AS radius_m, CASE WHEN kind IN ('point', 'text') THEN 21 WHEN kind = 'line' THEN 9 + 16 * len(ground)
 ELSE 13 + 16 * (len(outline) + 1) END AS bytes FROM outl""")  # fmt: skip
def s11(spark, sf):
    path = _folder(spark, sf, "geoparquet")
    spark.dataSource.register(geoparquet.GeoParquetSink)
    geoparquet.prepared(_located(spark, sf), "stateplane").write.format("geoparquet").option("crs", "stateplane").mode("overwrite").save(path)
    return spark.read.parquet(path).select("id", "kind", "label", "radius_m", F.length("geometry").alias("bytes"))


@query("s13_detail_json", "frames", "SELECT filename, camera, fl, shot, x AS eo_x, cam_width_px AS width, 5 AS corners FROM frames")
def s13(spark, sf):
    from aerolens.operators import select

    f = domain.frames(spark, sf)
    d = select.frame_detail(f, f, domain.IMAGE_BASE)
    text = d.select("filename", F.to_json(F.struct(*d.columns)).alias("j"))
    back = F.from_json("j", "camera string, fl string, shot bigint, eo struct<x: double>, sensor struct<widthPx: int>, footprint3089 array<array<double>>")
    return text.select("filename", back.alias("b")).select("filename", "b.camera", "b.fl", "b.shot", F.col("b.eo.x").alias("eo_x"), F.col("b.sensor.widthPx").alias("width"), F.size("b.footprint3089").alias("corners"))
