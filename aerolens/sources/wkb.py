"""Well-known binary at the edges: outlines in, geometry out.

Blobs of one length and one structure (byte order, kinds, counts) differ in their coordinates alone, so they are read and written
together, as views of one array; batches of survey outlines are one such group.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
RING = T.ArrayType(VERTEX)
SHAPE = T.ArrayType(T.ArrayType(RING))
SRID = 3089
TYPE_CODE = {"Point": 1, "LineString": 2, "Polygon": 3}
POLYGON, MULTIPOLYGON = 3, 6


def _kind(blob: bytes, at: int) -> tuple[str, int, bool, bool, int]:
    """Byte order, kind, whether there is Z and M, and where the body begins, in any of the usual dialects."""
    order = "<" if blob[at] == 1 else ">"
    code = struct.unpack_from(order + "I", blob, at + 1)[0]
    body = at + (9 if code & 0x20000000 else 5)
    flags = bool(code & 0x80000000), bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    z, m = {0: flags, 1: (True, False), 2: (False, True), 3: (True, True)}.get(code // 1000, flags)
    return order, code % 1000, z, m, body


def structure(blob: bytes) -> list[list[tuple[int, int, int, str, bool]]] | None:
    """Parts of a polygon or multipolygon, their rings as (where the coordinates begin, vertices, numbers a vertex, order, has Z).

    None for another kind of geometry.
    """

    def polygon(at: int):
        order, _, z, m, at = _kind(blob, at)
        rings = []
        count, at = struct.unpack_from(order + "I", blob, at)[0], at + 4
        for _ in range(count):
            n = struct.unpack_from(order + "I", blob, at)[0]
            width = 2 + z + m
            rings.append((at + 4, n, width, order + "f8", z))
            at += 4 + 8 * n * width
        return rings, at

    order, kind, _, _, at = _kind(blob, 0)
    if kind == POLYGON:
        return [polygon(0)[0]]
    if kind != MULTIPOLYGON:
        return None
    parts = []
    count, at = struct.unpack_from(order + "I", blob, at)[0], at + 4
    for _ in range(count):
        rings, at = polygon(at)
        parts.append(rings)
    return parts


def _shapes(rows: np.ndarray, parts) -> pa.Array:
    """The shapes of blobs of one structure, a row of bytes each."""
    n, xyz = len(rows), [np.empty((len(rows), 0, 3))]
    for at, count, width, kind, has_z in (r for p in parts for r in p):
        v = np.ascontiguousarray(rows[:, at : at + 8 * count * width]).view(kind).reshape(n, count, width).astype("f8")
        # M is dropped, a missing Z is 0.
        xyz.append(np.concatenate([v[:, :, :2], v[:, :, 2:3] if has_z else np.zeros((n, count, 1))], axis=2))
    flat = np.concatenate(xyz, axis=1).reshape(-1, 3)
    ends = lambda sizes: np.concatenate([[0], np.cumsum(np.tile(np.array(sizes, np.int64), n))]).astype(np.int32)
    vertices = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["x", "y", "z"])
    rings = pa.ListArray.from_arrays(ends([r[1] for p in parts for r in p]), vertices)
    return pa.ListArray.from_arrays(ends([len(parts)]), pa.ListArray.from_arrays(ends([len(p) for p in parts]), rings))


_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))))


def decoded(blobs: pa.Array) -> pa.Array:
    """Shapes of blobs, in their order; null for null and for other kinds of geometry."""
    blobs = blobs.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(1, np.int64)
    data = np.frombuffer(blobs.buffers()[2], np.uint8) if blobs.buffers()[2] is not None else np.empty(0, np.uint8)
    known = blobs.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(known, np.diff(offsets), 0)
    pieces, places, at = [pa.nulls(1, _ARROW)], np.zeros(len(blobs), np.int64), 1
    for size in np.unique(sizes[sizes > 0]):
        ours = np.flatnonzero(sizes == size)
        rows = np.stack([data[offsets[k] : offsets[k] + size] for k in ours]) if size > 4096 else data[offsets[ours][:, None] + np.arange(size)]
        while len(ours):
            first = rows[0]
            parts = structure(first.tobytes())
            fixed = np.ones(size, bool)
            if parts is None:
                fixed[9:] = False
            for start, count, width, *_ in (r for p in parts or [] for r in p):
                fixed[start : start + 8 * count * width] = False
            same = (rows[:, fixed] == first[fixed]).all(axis=1)
            if parts is not None:
                pieces.append(_shapes(rows[same], parts).cast(_ARROW))
                places[ours[same]] = at + np.arange(same.sum())
                at += int(same.sum())
            ours, rows = ours[~same], rows[~same]
    return pa.concat_arrays(pieces).take(pa.array(places))


@F.arrow_udf(SHAPE)
def _decode(blobs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in blobs:
        yield decoded(batch)


def with_outlines(df: DataFrame, blob: str = "footprint_wkb") -> DataFrame:
    """Decode outlines once, at ingest: `ring`, the outer ring of the first part with all its vertices; `parts`, all rings of all
    parts, where there are holes or several parts, else NULL; four corner columns; and the srid.

    The corner columns are those of four-cornered outlines, which take the short formulas; other outlines have NULL there and are
    worked on by their ring, or by their parts. An empty polygon has an empty ring, another kind of geometry none.
    """
    from aerolens.functions import rings

    out = rings.settle(df.withColumn("parts", _decode(F.col(blob))), "parts").drop(blob)
    first = F.try_element_at(F.try_element_at("parts", F.lit(1)), F.lit(1))
    out = out.withColumn("ring", F.when(F.col("parts").isNotNull(), F.coalesce(first, F.array().cast(RING))))
    several = (F.size("parts") > 1) | F.exists("parts", lambda p: F.size(p) > 1)
    out = out.withColumn("parts", F.when(several, F.col("parts")))
    closed = (F.size("ring") == 5) & F.element_at("ring", 1).eqNullSafe(F.try_element_at("ring", F.lit(5)))
    four = F.col("parts").isNull() & (closed | (F.size("ring") == 4))
    corner = lambda n: F.when(four, F.try_element_at("ring", F.lit(n + 1)))
    return out.withColumns({**{f"{a}{n}": corner(n)[a] for n in range(4) for a in "xyz"}, "srid": F.lit(SRID)})


def _blobs(sizes: list[list[int]], xyz: np.ndarray) -> np.ndarray:
    """Little-endian blobs, a row of bytes each, of shapes of one structure: vertices of each ring of each part; (row, vertex, number)."""
    n, width = len(xyz), xyz.shape[2]
    code = 1000 * (width == 3)
    out, at = [], 0
    words = lambda *v: np.tile(np.frombuffer(struct.pack("<" + "I" * len(v), *v), np.uint8), (n, 1))
    order = np.ones((n, 1), np.uint8)
    if len(sizes) != 1:
        out += [order, words(code + MULTIPOLYGON, len(sizes))]
    for part in sizes:
        out += [order, words(code + POLYGON, len(part))]
        for count in part:
            out += [words(count), np.ascontiguousarray(xyz[:, at : at + count]).astype("<f8").view(np.uint8).reshape(n, -1)]
            at += count
    return np.concatenate(out, axis=1)


def _rows_by_structure(counts: list[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Rows that are alike in all counts, which are given as one number sequence for each row (its bytes)."""
    groups: dict[bytes, list[int]] = {}
    for k, c in enumerate(counts):
        groups.setdefault(c.tobytes(), []).append(k)
    for rows in groups.values():
        yield np.array(rows)


def encoded(shapes: pa.Array) -> pa.Array:
    """Blobs of shapes with Z: a polygon for one part, a multipolygon for another number of parts; null for null."""
    valid = shapes.is_valid().to_numpy(zero_copy_only=False)
    some = shapes.filter(pa.array(valid))
    level = lambda a: (a.offsets.to_numpy() - a.offsets[0].as_py(), a.flatten())
    part_at, parts = level(some)
    ring_at, rings = level(parts)
    vertex_at, vertices = level(rings)
    xyz = np.stack([vertices.field(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1) if len(vertices) else np.empty((0, 3))
    n_rings, n_vertices = np.diff(ring_at), np.diff(vertex_at)
    counts = [np.concatenate([n_rings[part_at[k] : part_at[k + 1]], [-1], n_vertices[ring_at[part_at[k]] : ring_at[part_at[k + 1]]]]) for k in range(len(some))]
    out = np.empty(len(some), object)
    for rows in _rows_by_structure(counts, len(some)):
        k = rows[0]
        ring_sizes = n_vertices[ring_at[part_at[k]] : ring_at[part_at[k + 1]]].tolist()
        sizes, at = [], 0
        for m in n_rings[part_at[k] : part_at[k + 1]].tolist():
            sizes.append(ring_sizes[at : at + m])
            at += m
        first = vertex_at[ring_at[part_at[rows]]]
        blobs = _blobs(sizes, xyz[first[:, None] + np.arange(sum(ring_sizes))])
        out[rows] = [b.tobytes() for b in blobs]
    whole = np.empty(len(shapes), object)
    whole[valid] = out
    return pa.array(whole, pa.binary())


@F.arrow_udf(T.BinaryType())
def _encode_shapes(shapes: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in shapes:
        yield encoded(batch)


def shape_to_wkb(shape: Column) -> Column:
    """WKB with Z of a shape: parts of rings of vertices."""
    return _encode_shapes(shape)


@F.arrow_udf(T.BinaryType())
def _encode(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for kinds, paths in columns:
        codes = np.array([TYPE_CODE[k] for k in kinds.to_pylist()], np.int64)
        ends = paths.offsets.to_numpy() - paths.offsets[0].as_py()
        flat = paths.flatten()
        xy = np.stack([flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lon", "lat")], axis=1) if len(flat) else np.empty((0, 2))
        out = np.empty(len(codes), object)
        for rows in _rows_by_structure(list(np.stack([codes, np.diff(ends)], axis=1)), len(codes)):
            code, count = int(codes[rows[0]]), int(ends[rows[0] + 1] - ends[rows[0]])
            head = {1: struct.pack("<BI", 1, 1), 2: struct.pack("<BII", 1, 2, count), 3: struct.pack("<BIII", 1, 3, 1, count)}[code]
            body = xy[ends[rows][:, None] + np.arange(count)].astype("<f8").reshape(len(rows), -1).view(np.uint8)
            out[rows] = [head + b.tobytes() for b in body.reshape(len(rows), -1)]
        yield pa.array(out, pa.binary())


def to_wkb(kind: str | Column, path: str | Column) -> Column:
    """Little-endian two-dimensional WKB of a geometry given as its type and its path of (lon, lat)."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return _encode(as_column(kind), as_column(path))
