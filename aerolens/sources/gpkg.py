"""GeoPackage feature and attribute tables as a Spark data source.

    spark.dataSource.register(GeoPackageSource)
    spark.read.format("gpkg").option("table", ...).load("/shared/folder/*_ImageFrames.gpkg")

A GeoPackage is an SQLite file, so each task opens its file read-only and reads one range of fids. Files must be on a
path every executor sees.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

ENVELOPE_BYTES = (0, 32, 48, 48, 64)
ROWS_PER_PARTITION = 200_000
BATCH_ROWS = 4096


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _main_table(con: sqlite3.Connection, wanted: str | None) -> tuple[str, str | None]:
    """(table, geometry column) of a file: the wanted one, else its only listed table."""
    tables = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name")]
    if wanted is None and len(tables) != 1:
        raise ValueError(f"choose one of the tables {tables} with the option `table`")
    table = wanted or tables[0]
    try:
        geom = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
    except sqlite3.OperationalError:
        geom = None
    return table, geom[0] if geom else None


def _spark_type(declared: str) -> T.DataType:
    name = declared.upper()
    if re.match(r"(BIG|MEDIUM|SMALL|TINY)?INT", name):
        return T.LongType()
    if re.match(r"(REAL|DOUBLE|FLOAT)", name):
        return T.DoubleType()
    if name.startswith("BOOLEAN"):
        return T.BooleanType()
    if name.startswith("BLOB"):
        return T.BinaryType()
    return T.StringType()


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage geometry, without its header and envelope."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        return blob
    return blob[8 + ENVELOPE_BYTES[(blob[3] >> 1) & 7] :]


class FidRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class GeoPackageReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = to_arrow_schema(schema)
        self.names = [f.name for f in schema.fields]
        self.bools = [isinstance(f.dataType, T.BooleanType) for f in schema.fields]
        self.paths = _paths(options)
        self.table = options.get("table")
        self.rows = int(options.get("rowsperpartition", ROWS_PER_PARTITION))

    def partitions(self) -> list[FidRange]:
        out = []
        for path in self.paths:
            with _open(path) as con:
                table, _ = _main_table(con, self.table)
                lo, hi = con.execute(f"SELECT min(fid), max(fid) FROM {_quoted(table)}").fetchone()
            if lo is not None:
                out += [FidRange(path, at, min(at + self.rows - 1, hi)) for at in range(lo, hi + 1, self.rows)]
        return out

    def read(self, part: FidRange) -> Iterator[pa.RecordBatch]:
        con = _open(part.path)
        try:
            table, geom = _main_table(con, self.table)
            named = [n for n in self.names if n != "source_file"]
            columns = ", ".join(["fid", *(_quoted(geom if n == "geometry_wkb" else n) for n in named)])
            rows = con.execute(f"SELECT {columns} FROM {_quoted(table)} WHERE fid BETWEEN ? AND ?", (part.first, part.last))
            while block := rows.fetchmany(BATCH_ROWS):
                values = dict(zip(named, list(zip(*block))[1:]))
                for n, is_bool in zip(self.names, self.bools):
                    if is_bool:
                        values[n] = [None if v is None else bool(v) for v in values[n]]
                if "geometry_wkb" in values:
                    values["geometry_wkb"] = [wkb_of(v) for v in values["geometry_wkb"]]
                if "source_file" in self.names:
                    values["source_file"] = [os.path.basename(part.path)] * len(block)
                yield pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in self.schema], schema=self.schema)
        finally:
            con.close()


def _paths(options: dict) -> list[str]:
    paths = sorted(glob.glob(options["path"]))
    if not paths:
        raise FileNotFoundError(f"no GeoPackage at {options['path']}")
    return paths


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> T.StructType:
        with _open(_paths(self.options)[0]) as con:
            table, geom = _main_table(con, self.options.get("table"))
            fields = [T.StructField("source_file", T.StringType())]
            for _, name, declared, *_ in con.execute(f"PRAGMA table_info({_quoted(table)})"):
                fields.append(T.StructField("geometry_wkb", T.BinaryType()) if name == geom else T.StructField(name, _spark_type(declared)))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GeoPackageReader(schema, self.options)


def seasons(folder: str, prefix: str, frames_suffix: str = "_3IN_ImageFrames.gpkg", eo_suffix: str = "_3IN_ImageFrameEO.gpkg") -> list[str]:
    """Season keys of the frame files in a folder; every one must have its orientation file."""
    found = sorted(os.path.basename(p)[len(prefix) : -len(frames_suffix)] for p in glob.glob(f"{folder}/{prefix}*{frames_suffix}"))
    if not found:
        raise FileNotFoundError(f"no frame files in {folder}")
    for key in found:
        if not os.path.exists(f"{folder}/{prefix}{key}{eo_suffix}"):
            raise FileNotFoundError(f"missing orientation file for {key}")
    return found


def _season(df: DataFrame, prefix: str) -> DataFrame:
    key = F.regexp_extract("source_file", rf"^{re.escape(prefix)}(.*)_3IN_[A-Za-z]+\.gpkg$", 1)
    return df.withColumn("season_key", key).drop("source_file")


def survey_tables(spark: SparkSession, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(raw_frames, raw_eo) of all seasons of a folder, with the fid as the row number that pairs them."""
    spark.dataSource.register(GeoPackageSource)
    frames, eo = None, None
    for key in seasons(folder, prefix):
        load = lambda kind, k=key: _season(spark.read.format("gpkg").load(f"{folder}/{prefix}{k}_3IN_{kind}.gpkg"), prefix)
        f, e = load("ImageFrames"), load("ImageFrameEO")
        frames = f if frames is None else frames.unionByName(f)
        eo = e if eo is None else eo.unionByName(e)
    frames = frames.withColumnsRenamed({"fid": "rn", "geometry_wkb": "footprint_wkb"}).withColumn("FlightDate", F.col("FlightDate").cast("date"))
    eo = eo.withColumnsRenamed({"FlightDate": "eo_date", "FlightTime": "eo_time"}).withColumn("eo_date", F.col("eo_date").cast("date"))
    return frames, eo
