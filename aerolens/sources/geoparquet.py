"""GeoParquet 1.1: a Parquet file per task with a WKB column and the `geo` entry in its metadata.

    spark.dataSource.register(GeoParquetSink)
    df.write.format("geoparquet").option("crs", "stateplane").mode("overwrite").save(path)

Rows are (geometry BINARY, type STRING, bounds, attributes); see `prepared`.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from aerolens.operators.features import attribute_columns, with_geometry
from aerolens.sources.wkb import to_wkb

# The grid's definition as PROJJSON. Degrees need none: the format's default is longitude, latitude.
_FOOT = {"type": "LinearUnit", "name": "US survey foot", "conversion_factor": 0.3048006096012192}
_PARAMETERS = [
    ("Latitude of false origin", 36.33333333333334, "degree", 8821),
    ("Longitude of false origin", -85.75, "degree", 8822),
    ("Latitude of 1st standard parallel", 37.08333333333334, "degree", 8823),
    ("Latitude of 2nd standard parallel", 38.66666666666666, "degree", 8824),
    ("Easting at false origin", 4921250, _FOOT, 8826),
    ("Northing at false origin", 3280833.333, _FOOT, 8827),
]


def _axis(name: str, short: str, direction: str, unit) -> dict:
    return {"name": name, "abbreviation": short, "direction": direction, "unit": unit}


STATE_PLANE = {
    "$schema": "https://proj.org/schemas/v0.7/projjson.schema.json",
    "type": "ProjectedCRS",
    "name": "NAD83 / Kentucky Single Zone (ftUS)",
    "base_crs": {
        "name": "NAD83",
        "datum": {
            "type": "GeodeticReferenceFrame",
            "name": "North American Datum 1983",
            "ellipsoid": {"name": "GRS 1980", "semi_major_axis": 6378137, "inverse_flattening": 298.257222101},
        },
        "coordinate_system": {
            "subtype": "ellipsoidal",
            "axis": [_axis("Geodetic latitude", "Lat", "north", "degree"), _axis("Geodetic longitude", "Lon", "east", "degree")],
        },
        "id": {"authority": "EPSG", "code": 4269},
    },
    "conversion": {
        "name": "SPCS83 Kentucky Single Zone (US Survey feet)",
        "method": {"name": "Lambert Conic Conformal (2SP)", "id": {"authority": "EPSG", "code": 9802}},
        "parameters": [{"name": n, "value": v, "unit": u, "id": {"authority": "EPSG", "code": c}} for n, v, u, c in _PARAMETERS],
    },
    "coordinate_system": {"subtype": "Cartesian", "axis": [_axis("Easting", "X", "east", _FOOT), _axis("Northing", "Y", "north", _FOOT)]},
    "id": {"authority": "EPSG", "code": 3089},
}


def prepared(located: DataFrame, crs: str = "wgs84") -> DataFrame:
    """Features ready to write: WKB, geometry type, bounds, and the ten attribute columns."""
    lon, lat = F.transform("path", lambda p: p["lon"]), F.transform("path", lambda p: p["lat"])
    own = attribute_columns()
    return with_geometry(located, crs).select(
        own[0], to_wkb("type", "path").alias("geometry"), "type", F.array_min(lon).alias("xmin"), F.array_min(lat).alias("ymin"),
        F.array_max(lon).alias("xmax"), F.array_max(lat).alias("ymax"), *own[1:],
    )


HELPERS = ("type", "xmin", "ymin", "xmax", "ymax")


def geo_metadata(types: list[str], bbox: list[float] | None, crs: str) -> dict:
    column: dict = {"encoding": "WKB", "geometry_types": sorted(types)}
    if bbox:
        column["bbox"] = bbox
    if crs == "stateplane":
        column["crs"] = STATE_PLANE
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, crs: str, overwrite: bool):
        self.path, self.crs, self.overwrite = path, crs, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """One file of this task, streamed batch by batch; it becomes visible under its name on commit."""
        os.makedirs(self.path, exist_ok=True)
        name, writer, types, box = f"part-{uuid.uuid4().hex}.parquet", None, set(), None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows == 0:
                continue
            types |= set(pc.unique(t["type"]).to_pylist())
            low = [pc.min(t[c]).as_py() for c in ("xmin", "ymin")]
            high = [pc.max(t[c]).as_py() for c in ("xmax", "ymax")]
            box = low + high if box is None else [min(box[0], low[0]), min(box[1], low[1]), max(box[2], high[0]), max(box[3], high[1])]
            t = t.drop_columns(list(HELPERS))
            if writer is None:
                writer = pq.ParquetWriter(f"{self.path}/.{name}", t.schema, compression="zstd")
            writer.write_table(t)
        if writer is None:
            return Part(None)
        writer.add_key_value_metadata({"geo": json.dumps(geo_metadata(sorted(types), box, self.crs))})
        writer.close()
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        mine = {m.name for m in messages if m and m.name}
        if self.overwrite:
            for old in os.listdir(self.path) if os.path.isdir(self.path) else []:
                if old.startswith("part-") and old not in mine:
                    os.remove(f"{self.path}/{old}")
        for name in mine:
            os.replace(f"{self.path}/.{name}", f"{self.path}/{name}")

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m and m.name and os.path.exists(f"{self.path}/.{m.name}"):
                os.remove(f"{self.path}/.{m.name}")


class GeoParquetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self) -> T.StructType:
        raise NotImplementedError("read GeoParquet with spark.read.parquet")

    def writer(self, schema: T.StructType, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(self.options["path"], self.options.get("crs", "wgs84"), overwrite)
