"""Sources, sinks and jobs."""

import json
import sqlite3
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aerolens.catalog import domain
from aerolens.operators import expect, features, photo, terrain
from aerolens.plans import ingest
from aerolens.sources import geoparquet, gpkg, wkb


def make_gpkg(path, table, columns, rows, geometry=None):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT)")
    con.execute("INSERT INTO gpkg_contents VALUES (?)", (table,))
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    if geometry:
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?)", (table, geometry))
    con.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY, {columns})")
    marks = ", ".join("?" * len(rows[0]))
    con.executemany(f"INSERT INTO {table} VALUES ({marks})", rows)
    con.commit()
    con.close()


def zm_polygon(points):
    body = b"".join(struct.pack("<4d", x, y, z, 0.0) for x, y, z in points)
    return struct.pack("<BIII", 1, 3003, 1, len(points)) + body


def test_geopackages_are_read_by_fid_range_and_decoded(spark, tmp_path):
    square = [(0, 0, 1), (10, 0, 2), (10, 10, 3), (0, 10, 4), (0, 0, 1)]
    blob = b"GP" + bytes([0, 0b11]) + struct.pack("<i4d", 3089, 0, 10, 0, 10) + zm_polygon(square)
    frame = [(i, f"n{i}.tif", "2024-03-19", blob) for i in range(1, 26)]
    make_gpkg(tmp_path / "S_2024_Season1_3IN_ImageFrames.gpkg", "t", "Filename TEXT, FlightDate DATE, geom BLOB", frame, "geom")
    make_gpkg(tmp_path / "S_2024_Season1_3IN_ImageFrameEO.gpkg", "e", "ID TEXT, X REAL, FlightDate DATE, FlightTime TEXT", [(i, f"n{i}", 1.5 * i, "2024-03-19", "10:00:00") for i in range(1, 26)])
    frames, eo = gpkg.survey_tables(spark, str(tmp_path), "S_")
    got = wkb.with_outlines(frames).orderBy("rn").collect()
    assert len(got) == 25 and got[0].season_key == "2024_Season1" and (got[0].x1, got[0].z2, got[0].srid) == (10.0, 3.0, 3089)
    assert eo.where("fid = 4").first().X == 6.0
    parts = spark.read.format("gpkg").option("rowsPerPartition", 10).load(str(tmp_path / "*Frames.gpkg"))
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 25
    (tmp_path / "S_2025_Season1_3IN_ImageFrames.gpkg").touch()
    with pytest.raises(FileNotFoundError):
        gpkg.seasons(str(tmp_path), "S_")


def test_ingest_refuses_faulty_rows(spark, sf, tmp_path):
    survey = ingest.Survey(domain.IMAGE_BASE, domain.FOLDER_PREFIX, domain.FOLDER_SUFFIX)
    with pytest.raises(expect.RuleBroken, match="unexpected camera"):
        ingest.run(domain.raw_frames_faulty(spark, sf), domain.raw_eo_faulty(spark, sf), survey, str(tmp_path))


def test_geoparquet_carries_its_metadata(spark, sf, tmp_path):
    spark.dataSource.register(geoparquet.GeoParquetSink)
    located = features.on_grid(features.repaired(domain.drawn(spark, sf)))
    path = str(tmp_path / "out")
    for _ in range(2):
        geoparquet.prepared(located, "stateplane").coalesce(2).write.format("geoparquet").option("crs", "stateplane").mode("overwrite").save(path)
    assert spark.read.parquet(path).count() == located.count()
    for f in tmp_path.glob("out/part-*.parquet"):
        meta = json.loads(pq.read_metadata(f).metadata[b"geo"])
        column = meta["columns"]["geometry"]
        assert meta["version"] == "1.1.0" and column["encoding"] == "WKB" and column["crs"]["id"]["code"] == 3089 and len(column["bbox"]) == 4


def test_terrain_plane_is_exact_and_missing_cells_are_bridged(spark):
    rows = [[100.0 + 2 * c + 5 * r for c in range(4)] for r in range(3)]
    rows[1][1] = -9999.0
    patches = spark.createDataFrame([(1, 50.0, 1000.0, 2000.0, -9999.0, rows)], "patch_id long, cellSize double, lowerLeftX double, lowerLeftY double, noDataValue double, value array<array<double>>")
    at = spark.createDataFrame([(1, 1150.0, 2030.0), (1, 1000.0, 2000.0), (1, 1201.0, 2030.0), (1, 1075.0, 2075.0)], "patch_id long, x double, y double")
    got = {(r.x, r.y): r.height for r in terrain.with_heights(at, patches).collect()}
    assert abs(got[(1150.0, 2030.0)] - (100 + 2 * 2.5 + 5 * 0.1)) < 1e-9
    assert abs(got[(1000.0, 2000.0)] - (100 * 1.05 + 102 * 0.05 + 105 * 0.05) / 1.15) < 1e-9 and got[(1201.0, 2030.0)] is None and got[(1075.0, 2075.0)] is not None


def test_rays_of_one_photo_in_several_parts(spark, sf):
    f = domain.frames(spark, sf).where("k = 1")
    rays = spark.range(50).crossJoin(f.select("filename")).select(F.col("id").alias("ray_id"), "filename", (F.col("id") * 250.0).alias("col"), F.lit(7000.0).alias("row"), F.lit(500.0).alias("around"))
    empty = spark.createDataFrame([], "filename string, cellSize double, lowerLeftX double, lowerLeftY double, noDataValue double, value array<array<double>>")
    whole = photo.ground_at_pixels(rays, f, empty).orderBy("ray_id").collect()
    parts = photo.ground_at_pixels(rays, f, empty, floor=7).orderBy("ray_id").collect()
    assert whole == parts and len(parts) == 50 and sum(r.gx is not None for r in parts) == 50


def test_stack_lets_a_fading_photo_show_the_next(spark):
    layers = spark.createDataFrame([(0, 0, 0.25, 100.0, 0.0, 0.0), (0, 1, 1.0, 200.0, 0.0, 0.0), (0, 2, 1.0, 9.0, 9.0, 9.0)], "px int, priority int, edge double, r double, g double, b double")
    row = photo.stacked(layers, ["px"]).first()
    assert (row.r, row.g, row.a) == (175, 0, 255)
