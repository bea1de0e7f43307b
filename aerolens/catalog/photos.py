"""Queries over coordinate, geometry and camera formulas (K, G, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.registry import R, query, r
from aerolens.functions import angles, crs, quads, rings, text
from aerolens.functions.camera import ROTATION, Rig, mounted_at_angle
from aerolens.operators import photo, pointcloud, select, terrain
from aerolens.session import stored


def _pairs(*named, digits=8):
    return [R(c, digits).alias(n) for n, c in named]


@query("k1_lonlat_to_grid", "places", f"SELECT point_id, {r(s.grid_x('lon', 'lat'), 4)} AS x, {r(s.grid_y('lon', 'lat'), 4)} AS y FROM places")
def k1(spark, sf):
    x, y = crs.lonlat_to_grid(F.col("lon"), F.col("lat"))
    return domain.places(spark, sf).select("point_id", *_pairs(("x", x), ("y", y), digits=4))


@query("k2_grid_to_lonlat", "points", f"SELECT point_id, {r(s.lon_of('px', 'py'), 9)} AS lon, {r(s.lat_of('px', 'py'), 9)} AS lat FROM points")
def k2(spark, sf):
    lon, lat = crs.grid_to_lonlat(F.col("px"), F.col("py"))
    return domain.points(spark, sf).select("point_id", *_pairs(("lon", lon), ("lat", lat), digits=9))


@query("k3_world_square", "places", f"""SELECT point_id, {r(s.world_x('lon'), 11)} AS wx, {r(s.world_y('lat'), 11)} AS wy, {r(f"{s.world_x('lon')} * 360 - 180", 9)} AS lon,
 {r(f"360 / pi() * atan(exp((0.5e0 - {s.world_y('lat')}) * 2 * pi())) - 90", 9)} AS lat, {r('1e9 / (40075016.686e0 * cos(radians(lat)))', 6)} AS nano FROM places""")  # fmt: skip
def k3(spark, sf):
    wx, wy = crs.lonlat_to_world(F.col("lon"), F.col("lat"))
    lon, lat = crs.world_to_lonlat(wx, wy)
    return domain.places(spark, sf).select("point_id", *_pairs(("wx", wx), ("wy", wy), digits=11), *_pairs(("lon", lon), ("lat", lat), digits=9),
                                           R(crs.world_per_metre(F.col("lat")) * 1e9).alias("nano"))


_ANGLES = "SELECT o_orderkey AS k, ((o_orderkey * 37) % 1500 - 700) / 2e0 AS a, ((o_orderkey * 61) % 1100 - 500) / 4e0 AS b FROM orders"


def _angles(spark, sf):
    k = F.col("o_orderkey")
    return domain.table(spark, sf, "orders").select(k.alias("k"), (((k * 37) % 1500 - 700) / 2).alias("a"), (((k * 61) % 1100 - 500) / 4).alias("b"))


@query("k4_k5_k9_angles", "", f"""SELECT k, {s.wrap('a')} AS wrapped, {s.gap('a', 'b')} AS gap, {s.turn('a')} AS turned,
 ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][1 + floor({s.turn('a')} / 45 + 0.5e0)::INT % 8] AS wind FROM ({_ANGLES})""")  # fmt: skip
def k4(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _angles(spark, sf).select("k", angles.half_turn(a).alias("wrapped"), angles.bearing_gap(a, b).alias("gap"), angles.full_turn(a).alias("turned"), angles.compass_name(a).alias("wind"))


@query("k5_sql_function", "", f"SELECT k, {s.gap('a', 'b')} AS gap FROM ({_ANGLES})")
def k5(spark, sf):
    select.register_sql(spark)
    return _angles(spark, sf).select("k", F.expr("angle_diff(a, b)").alias("gap"))


@query("k6_bearing", "places", f"SELECT point_id, {r(s.bearing('lon', 'lat', 'lon + (point_id % 7 - 3) / 100e0', 'lat + (point_id % 5 - 1) / 90e0'), 6)} AS bearing FROM places WHERE point_id % 7 <> 3 OR point_id % 5 <> 1")
def k6(spark, sf):
    p = F.col("point_id")
    b = angles.initial_bearing(F.col("lon"), F.col("lat"), F.col("lon") + (p % 7 - 3) / 100.0, F.col("lat") + (p % 5 - 1) / 90.0)
    return domain.places(spark, sf).where((p % 7 != 3) | (p % 5 != 1)).select("point_id", R(b).alias("bearing"))


_K7 = [("px", "py"), ("px + 1000 * sin(radians(b))", "py + 1000 * cos(radians(b))")]


@query("k7_true_bearing", "points", f"""WITH t AS (SELECT point_id, px, py, (point_id % 360)::DOUBLE AS b FROM points), u AS (SELECT point_id, {s.lon_of('px', 'py')} AS lo1, {s.lat_of('px', 'py')} AS la1,
 {s.lon_of('(px + 1000 * sin(radians(b)))', '(py + 1000 * cos(radians(b)))')} AS lo2, {s.lat_of('(px + 1000 * sin(radians(b)))', '(py + 1000 * cos(radians(b)))')} AS la2 FROM t)
SELECT point_id, {r(s.bearing('lo1', 'la1', 'lo2', 'la2'), 4)} AS bearing FROM u""")  # fmt: skip
def k7(spark, sf):
    b = crs.grid_bearing_to_true(F.col("px"), F.col("py"), (F.col("point_id") % 360).cast("double"))
    return domain.points(spark, sf).select("point_id", R(b, 4).alias("bearing"))


@query("k8_lattice_warp", "points", f"SELECT point_id, {r(s.world_x(s.lon_of('px', 'py')), 9)} AS wx, {r(s.world_y(s.lat_of('px', 'py')), 9)} AS wy, true AS within_1_mm FROM points")
def k8(spark, sf):
    out = pointcloud.lattice_world(domain.points(spark, sf), "px", "py")
    lon, lat = crs.grid_to_lonlat(F.col("px"), F.col("py"))
    wx, wy = crs.lonlat_to_world(lon, lat)
    near = quads.distance(wx, wy, F.col("wx"), F.col("wy")) < crs.world_per_metre(lat) / 1000
    return out.select("point_id", R(wx, 9).alias("wx"), R(wy, 9).alias("wy"), near.alias("within_1_mm"))


@query("k10_map_scale", "places", f"""WITH t AS (SELECT *, 13 + (point_id % 40) / 5e0 AS zoom FROM places), u AS (SELECT *, 156543.03392e0 * cos(radians(lat)) / pow(2, zoom + 1) * 96 / 0.0254e0 AS sc FROM t)
SELECT point_id, zoom + 1 AS level, {r('sc', 5)} AS scale, CASE WHEN 256 / sc > 1.05e0 THEN 'enlarged' WHEN 256 / sc >= 1 / 1.05e0 THEN 'native' ELSE 'coarser' END AS state,
 'Level ' || printf('%.1f', zoom + 1) || ' · 1:' || printf('%,d', floor(sc + 0.5e0)::BIGINT) || CASE WHEN 256 / sc > 1.05e0 THEN ' · enlarged ' || printf('%.1f', 256 / sc) || '×' WHEN 256 / sc >= 1 / 1.05e0 THEN ' · native' ELSE '' END AS label FROM u""")  # fmt: skip
def k10(spark, sf):
    zoom = (F.lit(13) + (F.col("point_id") % 40) / 5.0).cast("double")
    scale = crs.map_scale(zoom, F.col("lat"))
    return domain.places(spark, sf).select("point_id", crs.tile_level(zoom).alias("level"), R(scale, 5).alias("scale"), crs.native_state(scale)[0].alias("state"),
                                           crs.scale_text(zoom, F.col("lat")).alias("label"))


_PAIR = "pr AS (SELECT p.point_id, p.px, p.py, f.* FROM points p JOIN frames f ON f.k = p.point_id * 9 + 1)"


def _near_pairs(spark, sf):
    return domain.points(spark, sf).join(domain.frames(spark, sf), F.col("k") == F.col("point_id") * 9 + 1)


@query("g2_box_overlap", "fg", """SELECT a.filename, a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AS touching,
 a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax AS overlapping FROM fg a JOIN fg b ON b.k = a.k + 35""")  # fmt: skip
def g2(spark, sf):
    f = domain.frames(spark, sf).select("filename", "k", "xmin", "ymin", "xmax", "ymax")
    j = f.alias("a").join(f.alias("b"), F.col("b.k") == F.col("a.k") + 35)
    box = lambda t: tuple(F.col(f"{t}.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))
    return j.select("a.filename", rings.overlap_inclusive(box("a"), box("b")).alias("touching"), rings.overlap_strict(box("a"), box("b")).alias("overlapping"))


_G_POINT = "x0 + ((x2 - x0) * (k % 13)) / 12e0 AS gx, y0 + ((y2 - y0) * (k % 11)) / 10e0 AS gy"


@query("g3_g8_quads", "frames", f"""WITH t AS (SELECT *, {_G_POINT} FROM frames) SELECT filename, {s.quad_covers('', 'gx', 'gy')} AS covered, {r(s.quad_area(''), 3)} AS area,
 {r(s.quad_centroid('')[0])} AS cen_x, {r(s.quad_centroid('')[1])} AS cen_y, {r('sqrt((x - gx)^2 + (y - gy)^2)')} AS away, {r(s.quad_edge_dist('', 'gx', 'gy'))} AS edge, (least(z0, z1, z2, z3) + greatest(z0, z1, z2, z3)) / 2 AS z_mid FROM t""")  # fmt: skip
def g3(spark, sf):
    k = F.col("k")
    f = domain.frames(spark, sf).withColumns({"gx": F.col("x0") + ((F.col("x2") - F.col("x0")) * (k % 13)) / 12.0, "gy": F.col("y0") + ((F.col("y2") - F.col("y0")) * (k % 11)) / 10.0})
    q, gx, gy = quads.corners(), F.col("gx"), F.col("gy")
    cx, cy = quads.centroid(q)
    return f.select("filename", quads.covers(q, gx, gy).alias("covered"), R(quads.area(q), 3).alias("area"), *_pairs(("cen_x", cx), ("cen_y", cy), ("away", quads.distance(F.col("x"), F.col("y"), gx, gy)), ("edge", quads.edge_distance(q, gx, gy)), digits=6), quads.z_middle(quads.heights()).alias("z_mid"))


_RING_SQL = "ring AS (SELECT filename, k, x, y, [{'x': x0, 'y': y0}, {'x': x1, 'y': y1}, {'x': x2, 'y': y2}, {'x': x3, 'y': y3}, {'x': x0 + (k % 5 - 2) * 300, 'y': (y0 + y3) / 2}] AS ring, x0 + 500 AS qx, y0 - 700 AS qy FROM frames)"


def _ringed(spark, sf):
    f = domain.frames(spark, sf)
    make = lambda: f.select("filename", "k", "x", "y", F.array(*[rings.point(a, b) for a, b in quads.corners()], rings.point(F.col("x0") + (F.col("k") % 5 - 2) * 300.0, (F.col("y0") + F.col("y3")) / 2)).alias("ring"),
                            (F.col("x0") + 500).alias("qx"), (F.col("y0") - 700).alias("qy"))
    return stored(spark, f"ringed|{sf}", make)


_SIDE = "sign((q.bx - q.ax) * (p.y - q.ay) - (q.by - q.ay) * (p.x - q.ax))"


@query("g4_g8_rings", "frames", f"""WITH {_RING_SQL} SELECT filename, {s.even_odd('ring', 'qx', 'qy')} AS hit, {r(s.ring_area('ring'), 3)} AS area, {r(s.ring_length('ring', True))} AS round, {r(s.ring_length('ring', False))} AS along,
 {r(s.ring_min('ring', s.seg_dist('a.x', 'a.y', 'b.x', 'b.y', 'qx', 'qy')))} AS edge FROM ring""")  # fmt: skip
def g4(spark, sf):
    ring = F.col("ring")
    return _ringed(spark, sf).select("filename", rings.inside(ring, F.col("qx"), F.col("qy")).alias("hit"), R(rings.area(ring), 3).alias("area"), R(rings.perimeter(ring)).alias("round"),
                                     R(rings.path_length(ring)).alias("along"), R(rings.edge_distance(ring, F.col("qx"), F.col("qy"))).alias("edge"))


@query("g10_interior_point", "frames", f"""WITH t AS (SELECT *, {s.quad_interior('')[0]} AS scan FROM frames), u AS (SELECT *, list_filter([{', '.join(f'CASE WHEN (y{a} <= scan) <> (y{b} <= scan) THEN x{a} + (x{b} - x{a}) * (scan - y{a}) / (y{b} - y{a}) END' for a, b in s.QUAD_EDGES)}], lambda v: v IS NOT NULL) AS xs FROM t)
SELECT filename, {r('(list_min(xs) + list_max(xs)) / 2')} AS px, {r('scan')} AS py FROM u""")  # fmt: skip
def g10(spark, sf):
    px, py = quads.interior_point(quads.corners())
    return domain.frames(spark, sf).select("filename", *_pairs(("px", px), ("py", py), digits=6))


@query("g11_g12_boxes", "frames nodes", """WITH b AS (SELECT filename, k, least(x0, x2) AS l, least(y0, y2) AS m, greatest(x0, x2) AS n, greatest(y0, y2) AS o, x - 900 AS bx0, y - 4000 AS by0, x + 1100 AS bx1, y - 1500 AS by1 FROM frames WHERE cam = 0),
 c AS (SELECT *, least(bx1, n) - greatest(bx0, l) AS w, least(by1, o) - greatest(by0, m) AS h FROM b)
SELECT filename, w >= 0 AND h >= 0 AS touches, round(CASE WHEN w > 0 AND h > 0 THEN w * h / ((bx1 - bx0) * (by1 - by0)) ELSE 0 END, 6) AS share FROM c""")  # fmt: skip
def g11(spark, sf):
    f = stored(spark, f"nadir_rings|{sf}", lambda: domain.frames(spark, sf).where("cam = 0").select(
        "filename", "x", "y", "xmin", "ymin", "xmax", "ymax", F.array(*[rings.point(a, b) for a, b in quads.corners()]).alias("ring")))
    box = (F.col("x") - 900, F.col("y") - 4000, F.col("x") + 1100, F.col("y") - 1500)
    own = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    return f.select("filename", rings.box_touches(F.col("ring"), *box).alias("touches"), R(rings.covered_share(box, own)).alias("share"))


@query("g13_crossing", "frames", """SELECT filename, k % 3 = 1 AS crossed FROM frames""")
def g13(spark, sf):
    q = quads.corners()
    c = [rings.point(a, b) for a, b in q]
    ring = F.when(F.col("k") % 3 == 1, F.array(c[0], c[2], c[1], c[3])).otherwise(F.array(*c))
    f = stored(spark, f"bowties|{sf}", lambda: domain.frames(spark, sf).select("filename", ring.alias("ring")))
    return f.select("filename", rings.crosses_itself(F.col("ring")).alias("crossed"))


@query("g15_vertices", "frames", "SELECT filename, 1 AS path, x0 AS x, y0 AS y, z0 AS z FROM frames UNION ALL SELECT filename, 2, x1, y1, z1 FROM frames UNION ALL SELECT filename, 3, x2, y2, z2 FROM frames UNION ALL SELECT filename, 4, x3, y3, z3 FROM frames")
def g15(spark, sf):
    d = domain.frames(spark, sf).select("filename", F.posexplode(select.corner_array(4)).alias("p", "v"))
    return d.select("filename", (F.col("p") + 1).alias("path"), F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("z"))


@query("g16_outline_lonlat", "frames", f"SELECT filename, {r(s.lon_of('x1', 'y1'))} AS lon1, {r(s.lat_of('x1', 'y1'))} AS lat1, {r(s.lon_of('x3', 'y3'), 1)} AS lon3 FROM frames")
def g16(spark, sf):
    lon1, lat1 = crs.grid_to_lonlat(F.col("x1"), F.col("y1"))
    return domain.frames(spark, sf).select("filename", R(lon1).alias("lon1"), R(lat1).alias("lat1"), R(crs.grid_to_lonlat(F.col("x3"), F.col("y3"))[0], 1).alias("lon3"))


@query("g17_outline_text", "frames", "SELECT filename, 'POLYGON Z ((' || " + " || ', ' || ".join(f"printf('%.3f %.3f %.3f', x{i}, y{i}, z{i})" for i in (0, 1, 2, 3, 0)) + " || '))' AS wkt FROM frames")
def g17(spark, sf):
    ring = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"z{i}").alias("z")) for i in (0, 1, 2, 3, 0)])
    return domain.frames(spark, sf).select("filename", rings.wkt_polygon_z(ring).alias("wkt"))


@query("p1_rotation", "rig", "SELECT filename, " + ", ".join(f"{r(f'm{3 * i + j}', 9)} AS r{i}{j}" for i in range(3) for j in range(3)) + ", false AS refused FROM rig")
def p1(spark, sf):
    return domain.frames(spark, sf).select("filename", *[R(F.col(c), 9).alias(c) for c in ROTATION], mounted_at_angle().alias("refused"))


_TARGET = ("(x + (k % 17 - 8) * 500)", "(y + (k % 13 - 6) * 700)", "(480e0 + k % 60)")
_PIX = s.rig_pixel("", *_TARGET)


def _target():
    k = F.col("k")
    return F.col("x") + (k % 17 - 8) * 500, F.col("y") + (k % 13 - 6) * 700, (480 + k % 60).cast("double")


@query("p2_ground_to_pixel", "rig", f"SELECT filename, {r(_PIX[0], 4)} AS col, {r(_PIX[1], 4)} AS row FROM rig")
def p2(spark, sf):
    col, row = Rig().to_pixel(*_target())
    return domain.frames(spark, sf).select("filename", R(col, 4).alias("col"), R(row, 4).alias("row"))


_COLROW = ("(cam_width_px * (k % 9) / 8e0)", "(cam_height_px * (k % 7) / 6e0)")
_GROUND = s.rig_ground("", *_COLROW, "500e0")


@query("p3_pixel_to_ground", "rig", f"SELECT filename, {r(_GROUND[0], 4)} AS gx, {r(_GROUND[1], 4)} AS gy FROM rig")
def p3(spark, sf):
    k = F.col("k")
    gx, gy = Rig().to_ground(F.col("cam_width_px") * (k % 9) / 8.0, F.col("cam_height_px") * (k % 7) / 6.0, F.lit(500.0))
    return domain.frames(spark, sf).select("filename", R(gx, 4).alias("gx"), R(gy, 4).alias("gy"))


_CORNERS = [("0e0", "0e0"), ("cam_width_px::DOUBLE", "0e0"), ("cam_width_px::DOUBLE", "cam_height_px::DOUBLE"), ("0e0", "cam_height_px::DOUBLE")]
_C_XY = ", ".join(f"{g} AS {n}{i}c" for i, (c, w) in enumerate(_CORNERS) for n, g in zip("xy", s.rig_ground("", c, w, "flat")))


@query("p4_photo_corners", "rig", f"WITH t AS (SELECT filename, {_C_XY} FROM rig) SELECT filename, " + ", ".join(f"{r(s.lon_of(f'x{i}c', f'y{i}c'), 8)} AS lon{i}, {r(s.lat_of(f'x{i}c', f'y{i}c'), 8)} AS lat{i}" for i in range(4)) + " FROM t WHERE x0c + x1c + x2c + x3c IS NOT NULL")
def p4(spark, sf):
    f = domain.frames(spark, sf).withColumn("flat", quads.mean_height(quads.heights()))
    cols = {}
    for i, (c, w) in enumerate(Rig().corner_pixels()):
        gx, gy = Rig().to_ground(c, w, F.col("flat"))
        cols.update({f"gx{i}": gx, f"gy{i}": gy})
    f = f.select("filename", *[v.alias(n) for n, v in cols.items()]).where(" AND ".join(f"gx{i} IS NOT NULL" for i in range(4)))
    out = []
    for i in range(4):
        lon, lat = crs.grid_to_lonlat(F.col(f"gx{i}"), F.col(f"gy{i}"))
        out += _pairs((f"lon{i}", lon), (f"lat{i}", lat))
    return f.select("filename", *out)


_LOW, _HIGH = s.rig_ground("", "cam_width_px / 2e0", "cam_height_px::DOUBLE", "flat"), s.rig_ground("", "cam_width_px / 2e0", "0e0", "flat")


@query("p5_up_bearing", "rig", f"""WITH t AS (SELECT filename, {_LOW[0]} AS ax, {_LOW[1]} AS ay, {_HIGH[0]} AS ex, {_HIGH[1]} AS ey FROM rig),
 u AS (SELECT filename, {s.lon_of('ax', 'ay')} AS lo1, {s.lat_of('ax', 'ay')} AS la1, {s.lon_of('ex', 'ey')} AS lo2, {s.lat_of('ex', 'ey')} AS la2 FROM t) SELECT filename, {r(s.bearing('lo1', 'la1', 'lo2', 'la2'), 4)} AS up FROM u""")  # fmt: skip
def p5(spark, sf):
    return domain.frames(spark, sf).select("filename", R(Rig().up_bearing(quads.mean_height(quads.heights())), 4).alias("up"))


@query("p6_flight_heading", "frames", f"SELECT filename, {r('coalesce(' + s.turn('look_azimuth_deg - CASE cam WHEN 1 THEN 0 WHEN 2 THEN 180 WHEN 3 THEN -90 WHEN 4 THEN 90 END') + ', track_heading_deg)')} AS heading FROM frames")
def p6(spark, sf):
    return domain.frames(spark, sf).select("filename", R(angles.flight_heading(F.col("camera"), F.col("look_azimuth_deg"), F.col("track_heading_deg"))).alias("heading"))


@query("p7_p8_ground", "rig", f"""WITH c AS (SELECT filename, x, y, flat, unnest([{{'x': x0, 'y': y0, 'z': z0}}, {{'x': x1, 'y': y1, 'z': z1}}, {{'x': x2, 'y': y2, 'z': z2}}, {{'x': x3, 'y': y3, 'z': z3}}]) AS p FROM rig),
 m AS (SELECT filename, any_value(x) AS x, any_value(y) AS y, any_value(flat) AS flat, avg(p.x) AS mx, avg(p.y) AS my, covar_pop(p.x, p.x) AS sxx, covar_pop(p.x, p.y) AS sxy, covar_pop(p.y, p.y) AS syy, covar_pop(p.x, p.z) AS sxz, covar_pop(p.y, p.z) AS syz FROM c GROUP BY filename)
SELECT filename, {r('flat')} AS mean, {r('flat + (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) * (x + 500 - mx) + (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) * (y + 300 - my)', 5)} AS plane FROM m""")  # fmt: skip
def p7(spark, sf):
    plane = quads.plane_height(quads.corners(), quads.heights(), F.col("x") + 500, F.col("y") + 300)
    return domain.frames(spark, sf).select("filename", R(quads.mean_height(quads.heights())).alias("mean"), R(plane, 5).alias("plane"))


@query("p9_terrain_height", "th", f"SELECT tq.patch_id, tq.q, {r('th.height')} AS height FROM tq LEFT JOIN th USING (patch_id, q)")
def p9(spark, sf):
    patches = stored(spark, f"patches|{sf}", lambda: domain.terrain_patches(spark, sf))
    out = terrain.with_heights(domain.terrain_queries(spark, sf), patches)
    return out.select("patch_id", "q", R(F.col("height")).alias("height"))


@query("p10_ground_or_plane", "th rig", f"""WITH t AS (SELECT tq.patch_id, tq.q, tq.x, tq.y, CASE WHEN tq.patch_id % 4 <> 3 THEN th.height END AS h, tq.patch_id % 4 = 3 AS approximate FROM tq LEFT JOIN th USING (patch_id, q)),
 c AS (SELECT k, flat, unnest([{{'x': x0, 'y': y0, 'z': z0}}, {{'x': x1, 'y': y1, 'z': z1}}, {{'x': x2, 'y': y2, 'z': z2}}, {{'x': x3, 'y': y3, 'z': z3}}]) AS p FROM rig),
 m AS (SELECT k, any_value(flat) AS flat, avg(p.x) AS mx, avg(p.y) AS my, covar_pop(p.x, p.x) AS sxx, covar_pop(p.x, p.y) AS sxy, covar_pop(p.y, p.y) AS syy, covar_pop(p.x, p.z) AS sxz, covar_pop(p.y, p.z) AS syz FROM c GROUP BY k)
SELECT patch_id, q, {r('coalesce(h, flat + (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) * (x - mx) + (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) * (y - my))', 4)} AS z, approximate FROM t JOIN m ON m.k = t.q * 5 + 1""")  # fmt: skip
def p10(spark, sf):
    f = domain.frames(spark, sf)
    places = domain.terrain_queries(spark, sf).join(f.select("filename", "k").hint("merge"), F.col("k") == F.col("q") * 5 + 1)
    patches = stored(spark, f"patches|{sf}", lambda: domain.terrain_patches(spark, sf)).where("patch_id % 4 <> 3")
    return photo.grounded(places, f, patches).select("patch_id", "q", R(F.col("z"), 4).alias("z"), "approximate")


def _plane_patches(spark, sf):
    """A patch per photo, wide cells on a tilted plane: bilinear interpolation is exact, so rays have a closed form."""
    k = F.col("k")
    left, low = F.col("x") - 30000, F.col("y") - 30000
    # A height is a sum of a part by column and one by row: each is made once for its twenty, not for all cells.
    steps = F.sequence(F.lit(0), F.lit(19))
    across = F.transform(steps, lambda i: 500 + (k % 5 - 2) * 0.01 * (left + (i + 0.5) * 3000 - F.col("x")))
    up = F.transform(steps, lambda j: (k % 3 - 1) * 0.01 * (low + (j + 0.5) * 3000 - F.col("y")))
    f = domain.frames(spark, sf).where("cam > 0").select("filename", F.lit(3000.0).alias("cellSize"), left.alias("lowerLeftX"), low.alias("lowerLeftY"), F.lit(-9999.0).alias("noDataValue"), across.alias("across"), up.alias("up"))
    f = rings.settle(f, "across", "up")
    return f.select("filename", "cellSize", "lowerLeftX", "lowerLeftY", "noDataValue", F.transform("up", lambda b: F.transform("across", lambda a: a + b)).alias("value"))


_RAY = ("(cam_width_px * (1 + n) / 4e0)", "(cam_height_px * (2 + (k + n) % 3) / 6e0)")
_DIR = s.rig_ground("", *_RAY, "(z - 1000e0)")


@query("p11_ray_terrain", "rig", f"""WITH t AS (SELECT * FROM rig, (SELECT unnest([0, 1, 2]) AS n) WHERE cam > 0), u AS (SELECT *, ({_DIR[0]} - x) / 1000 AS dx, ({_DIR[1]} - y) / 1000 AS dy, (k % 5 - 2) * 0.01e0 AS gx, (k % 3 - 1) * 0.01e0 AS gy FROM t),
 v AS (SELECT *, (z - 500e0) / (1 + gx * dx + gy * dy) AS d FROM u) SELECT k * 3 + n AS ray_id, {r('x + dx * d', 3)} AS gx, {r('y + dy * d', 3)} AS gy, {r('z - d', 3)} AS gz FROM v""")  # fmt: skip
def p11(spark, sf):
    f = domain.frames(spark, sf)
    k, n = F.col("k"), F.col("n")
    rays = f.where("cam > 0").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        (k * 3 + n).alias("ray_id"), "filename", (F.col("cam_width_px") * (1 + n) / 4.0).alias("col"), (F.col("cam_height_px") * (2 + (k + n) % 3) / 6.0).alias("row"), F.lit(500.0).alias("around"))
    out = photo.ground_at_pixels(rays, f, stored(spark, f"plane_patches|{sf}", lambda: _plane_patches(spark, sf)))
    return out.select("ray_id", *_pairs(("gx", F.col("gx")), ("gy", F.col("gy")), ("gz", F.col("gz")), digits=3))


@query("p12_height_above", "rig", "SELECT filename, (k % 300)::DOUBLE AS height, 0e0 AS off_px FROM rig WHERE cam > 0")
def p12(spark, sf):
    f = domain.frames(spark, sf).where("cam > 0")
    bx, by, bz = quads.interior_point(quads.corners()) + (F.lit(500.0),)
    f = f.withColumns({"bx": bx, "by": by, "bz": bz})
    col, row = Rig().to_pixel(F.col("bx"), F.col("by"), F.col("bz") + F.col("k") % 300)
    out = photo.heights_above(f.withColumns({"col": col, "row": row}))
    return out.select("filename", R(F.col("height"), 4).alias("height"), R(F.col("off_px"), 3).alias("off_px"))


_NINE = [(a, b) for b in (-900, 0, 900) for a in (-700, 0, 700)]
_NINE_SQL = "SELECT unnest([" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in _NINE) + "]) AS o"
_NPIX = s.rig_pixel("", "((x0 + x2) / 2 + o.a + k % 50 * 60)", "((y0 + y2) / 2 + o.b)", "flat")


def _under(spark, sf):
    f = domain.frames(spark, sf).withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _NINE])))
    return f.withColumns({"gx": (F.col("x0") + F.col("x2")) / 2 + F.col("o.a") + F.col("k") % 50 * 60, "gy": (F.col("y0") + F.col("y2")) / 2 + F.col("o.b"), "gz": quads.mean_height(quads.heights())})


_REGION = f"""px AS (SELECT filename, {_NPIX[0]} AS c, {_NPIX[1]} AS w, cam_width_px, cam_height_px FROM rig, ({_NINE_SQL})),
 g AS (SELECT filename, bool_or(c IS NULL) AS behind, min(c) AS c0, max(c) AS c1, min(w) AS r0, max(w) AS r1, max(cam_width_px) AS pw, max(cam_height_px) AS ph FROM px GROUP BY filename),
 reg AS (SELECT filename, CASE WHEN behind THEN 0 ELSE greatest(0, c0 - (c1 - c0) * 0.05e0) END AS x0, CASE WHEN behind THEN 0 ELSE greatest(0, r0 - (r1 - r0) * 0.05e0) END AS y0,
  CASE WHEN behind THEN pw ELSE least(pw, c1 + (c1 - c0) * 0.05e0) END AS x1, CASE WHEN behind THEN ph ELSE least(ph, r1 + (r1 - r0) * 0.05e0) END AS y1 FROM g)"""


@query("p13_region_under", "rig", f"WITH {_REGION} SELECT filename, {r('x0', 4)} AS x0, {r('y0', 4)} AS y0, {r('x1', 4)} AS x1, {r('y1', 4)} AS y1 FROM reg WHERE x1 > x0 AND y1 > y0")
def p13(spark, sf):
    out = photo.regions_under(_under(spark, sf), ["filename"])
    return out.select("filename", *_pairs(*[(c, F.col(c)) for c in ("x0", "y0", "x1", "y1")], digits=4))


def _spot(c, w, n):
    gx, gy = s.rig_ground("", c, w, "flat")
    return f"{gx} AS {n}x, {gy} AS {n}y"


@query("p14_screen_scale", "rig", f"""WITH sp AS (SELECT *, cam_width_px * f.u AS c, cam_height_px * f.v AS w FROM rig, (SELECT unnest([{{'u': 0.25e0, 'v': 0.25e0}}, {{'u': 0.75e0, 'v': 0.25e0}}, {{'u': 0.75e0, 'v': 0.75e0}}, {{'u': 0.25e0, 'v': 0.75e0}}, {{'u': 0.5e0, 'v': 0.5e0}}]) AS f)),
 cw AS (SELECT * REPLACE (CASE WHEN f.u = 0.5e0 THEN c WHEN f.u < 0.5e0 THEN c - cam_width_px / 8e0 + 40 ELSE c + cam_width_px / 8e0 - 40 END AS c, CASE WHEN f.v = 0.5e0 THEN w WHEN f.v < 0.5e0 THEN w - cam_height_px / 8e0 + 40 ELSE w + cam_height_px / 8e0 - 40 END AS w) FROM sp),
 g AS (SELECT filename, {_spot('c', 'w', 'h')}, {_spot('(c + 40)', 'w', 'r')}, {_spot('c', '(w + 40)', 'd')} FROM cw),
 a AS (SELECT filename, greatest(sqrt(pow(0.5e0 * (rx - hx) + 0.1e0 * (ry - hy), 2) + pow(0.1e0 * (rx - hx) - 0.5e0 * (ry - hy), 2)), sqrt(pow(0.5e0 * (dx - hx) + 0.1e0 * (dy - hy), 2) + pow(0.1e0 * (dx - hx) - 0.5e0 * (dy - hy), 2))) / 40 AS sc FROM g)
SELECT filename, {r('max(sc)', 5)} AS scale FROM a GROUP BY filename""")  # fmt: skip
def p14(spark, sf):
    f = domain.frames(spark, sf)
    w, h = F.col("cam_width_px"), F.col("cam_height_px")
    reg = f.withColumns({"rx0": w / 8.0, "ry0": h / 8.0, "rx1": w * 7 / 8.0, "ry1": h * 7 / 8.0, "gz": quads.mean_height(quads.heights()), "ax": F.lit(0.5), "bx": F.lit(0.1), "ay": F.lit(0.1), "by": F.lit(-0.5)})
    return photo.max_screen_scales(reg, ["filename"]).select("filename", R(F.col("scale"), 5).alias("scale"))


_CP = s.rig_pixel("", "gx", "gy", "flat")
_CH, _CA = s.rig_ground("", "c", "w", "flat"), s.rig_ground("", "(c + 25)", "w", "flat")


@query("p15_crops", "rig", f"""WITH t AS (SELECT *, x0 + (x2 - x0) * (k % 9) / 8e0 AS gx, y0 + (y2 - y0) * (k % 7) / 6e0 AS gy FROM rig), u AS (SELECT *, {_CP[0]} AS c, {_CP[1]} AS w FROM t),
 v AS (SELECT *, sqrt(pow({_CA[0]} - {_CH[0]}, 2) + pow({_CA[1]} - {_CH[1]}, 2)) / 25 AS fpp FROM u), a AS (SELECT *, 250 / fpp AS w0, least(1, cam_width_px / (250 / fpp), cam_height_px / (250 / fpp / (4 / 3e0))) AS sc FROM v),
 b AS (SELECT *, w0 * sc AS cw, w0 / (4 / 3e0) * sc AS ch FROM a), d AS (SELECT *, least(cam_width_px - cw, greatest(0, c - cw / 2)) AS cx, least(cam_height_px - ch, greatest(0, w - ch / 2)) AS cy FROM b)
SELECT filename, {r('cx', 3)} AS crop_x, {r('cy', 3)} AS crop_y, {r('cw', 3)} AS width, {r('ch', 3)} AS height, {r('(c - cx) / cw', 5)} AS marker_x, {r('(w - cy) / ch', 5)} AS marker_y FROM d WHERE fpp > 0""")  # fmt: skip
def p15(spark, sf):
    k = F.col("k")
    f = domain.frames(spark, sf).withColumns({"gx": F.col("x0") + (F.col("x2") - F.col("x0")) * (k % 9) / 8.0, "gy": F.col("y0") + (F.col("y2") - F.col("y0")) * (k % 7) / 6.0, "gz": quads.mean_height(quads.heights())})
    out = photo.crops(f, F.lit(250.0), F.lit(4 / 3))
    return out.select("filename", *_pairs(*[(c, F.col(c)) for c in ("crop_x", "crop_y", "width", "height")], digits=3), *_pairs(("marker_x", F.col("marker_x")), ("marker_y", F.col("marker_y")), digits=5))


# A stack: the six exposures about a Fwd frame, seen at 25 places of its footprint.
_STACK = f"""st AS (SELECT v.k AS view_id, a.i AS pi, b.i AS pj, f.k - v.k AS priority, v.x0 + (v.x2 - v.x0) * (a.i + 0.5e0) / 5 AS gx, v.y0 + (v.y2 - v.y0) * (b.i + 0.5e0) / 5 AS gy, v.flat AS gz, f.*
 FROM rig v JOIN rig f ON f.k IN (v.k, v.k + 5, v.k + 10, v.k + 15) AND v.cam = 1, unnest(range(0, 5)) a(i), unnest(range(0, 5)) b(i)),
 wt AS (SELECT *, {s.fade('', 'c', 'w')} AS weight0 FROM (SELECT view_id, pi, pj, priority, filename, cam_width_px, cam_height_px, {s.rig_pixel('', 'gx', 'gy', 'gz')[0]} AS c, {s.rig_pixel('', 'gx', 'gy', 'gz')[1]} AS w FROM st))"""


def _stack(spark, sf):
    f = domain.frames(spark, sf)
    v = f.where("cam = 1").select(F.col("k").alias("view_id"), F.col("x0").alias("vx0"), F.col("x2").alias("vx2"), F.col("y0").alias("vy0"), F.col("y2").alias("vy2"), quads.mean_height(quads.heights()).alias("gz"))
    v = v.withColumn("priority", F.explode(F.array(*[F.lit(n) for n in (0, 5, 10, 15)]).cast("array<long>"))).withColumn("k", F.col("view_id") + F.col("priority"))
    rig = f.select("k", "filename", *photo.RIG_COLUMNS)
    st = v.join(rig, "k").withColumn("pi", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("pj", F.explode(F.sequence(F.lit(0), F.lit(4))))
    st = st.withColumns({"gx": F.col("vx0") + (F.col("vx2") - F.col("vx0")) * (F.col("pi") + 0.5) / 5, "gy": F.col("vy0") + (F.col("vy2") - F.col("vy0")) * (F.col("pj") + 0.5) / 5})
    return photo.photo_weights(st)


@query("p16_edge_fade", "rig", f"WITH {_STACK} SELECT view_id, pi, pj, priority, {r('coalesce(weight0, 0)')} AS weight FROM wt")
def p16(spark, sf):
    return _stack(spark, sf).select("view_id", "pi", "pj", "priority", R(F.col("weight")).alias("weight"))


@query("p17_needed_frames", "rig", f"""WITH {_STACK}, o AS (SELECT *, coalesce(max(CASE WHEN weight0 >= 0.999e0 THEN 1 ELSE 0 END) OVER (PARTITION BY view_id, pi, pj ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM wt)
SELECT view_id, priority, bool_or(coalesce(weight0, 0) > 0 AND closed = 0) AS needed FROM o GROUP BY ALL""")  # fmt: skip
def p17(spark, sf):
    return photo.needed_frames(_stack(spark, sf), ["view_id"], ["pi", "pj"])


@query("p18_frame_shown", "rig", f"""WITH {_STACK} SELECT view_id, pi, pj, min(priority) AS priority, arg_min(filename, priority) AS filename, {r('arg_min(c, priority)', 3)} AS col, {r('arg_min(w, priority)', 3)} AS row
FROM wt WHERE weight0 >= 0.5e0 GROUP BY ALL""")  # fmt: skip
def p18(spark, sf):
    out = photo.shown_at(_stack(spark, sf), ["view_id", "pi", "pj"])
    return out.select("view_id", "pi", "pj", "priority", "filename", R(F.col("col"), 3).alias("col"), R(F.col("row"), 3).alias("row"))


@query("p22_seams", "rig", f"""WITH t AS (SELECT a.filename, {', '.join(f'{c} AS {n}' for q, z in (('a.', '560e0'), ('b.', '620e0')) for n, c in zip((q[0] + 'lx', q[0] + 'ly'), s.rig_ground(q, *s.rig_pixel(q, '((a.x0 + a.x2) / 2)', '((a.y0 + a.y2) / 2)', '700e0'), z)))} FROM rig a JOIN rig b ON b.k = a.k + 5)
SELECT filename, {r('sqrt((alx - blx)^2 + (aly - bly)^2)', 3)} AS seam FROM t""")  # fmt: skip
def p22(spark, sf):
    f = domain.frames(spark, sf).select("filename", "k", "x0", "y0", "x2", "y2", *photo.RIG_COLUMNS)
    j = f.alias("a").join(f.alias("b"), F.col("b.k") == F.col("a.k") + 5)
    gx, gy, z = (F.col("a.x0") + F.col("a.x2")) / 2, (F.col("a.y0") + F.col("a.y2")) / 2, F.lit(700.0)
    a, b = photo.landing(Rig("a."), gx, gy, z, F.lit(560.0)), photo.landing(Rig("b."), gx, gy, z, F.lit(620.0))
    return j.select("a.filename", R(quads.distance(*a, *b), 3).alias("seam"))
