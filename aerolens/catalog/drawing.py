"""Queries over drawn features and measurements (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.registry import R, query, r
from aerolens.functions import rings, text
from aerolens.functions.crs import METRES_PER_FOOT
from aerolens.operators import features
from aerolens.session import stored

FT = s.num(METRES_PER_FOOT)


def _raw(spark, sf):
    return stored(spark, f"drawn|{sf}", lambda: domain.drawn(spark, sf))


def _located(spark, sf):
    return stored(spark, f"located|{sf}", lambda: features.on_grid(features.repaired(_raw(spark, sf))))


_PROBLEM = """CASE WHEN id = '' THEN 'no id' WHEN kind NOT IN ('point', 'text', 'line', 'polygon', 'rectangle', 'circle') THEN 'unknown kind ' || kind
 WHEN len(coordinates) < CASE kind WHEN 'line' THEN 2 WHEN 'polygon' THEN 3 WHEN 'rectangle' THEN 4 ELSE 1 END OR len(coordinates) > CASE kind WHEN 'line' THEN 100000 WHEN 'polygon' THEN 100000 WHEN 'rectangle' THEN 4 ELSE 1 END
  THEN 'a ' || kind || ' cannot have ' || len(coordinates) || ' vertices'
 WHEN len(list_filter(coordinates, lambda c: abs(c.lon) > 180 OR abs(c.lat) > 90)) > 0 THEN 'a vertex is outside the world' WHEN kind = 'circle' AND NOT coalesce(radius_m > 0, false) THEN 'a circle needs a radius above zero' END"""
_REPAIRED = f"""rep AS (SELECT seq, id, kind, coordinates, radius_m, coalesce(label, '') AS label, coalesce(notes, '') AS notes, CASE WHEN regexp_full_match(color, '#[0-9a-fA-F]{{6}}') THEN color ELSE '#e53935' END AS color,
 coalesce(created_at, '1970-01-01T00:00:00.000Z') AS created_at FROM drawn WHERE ({_PROBLEM}) IS NULL),
loc AS (SELECT *, list_transform(coordinates, lambda c: {{'x': {s.grid_x('c.lon', 'c.lat')}, 'y': {s.grid_y('c.lon', 'c.lat')}}}) AS ground FROM rep),
outl AS (SELECT *, CASE WHEN kind = 'circle' THEN list_transform(range(0, 64), lambda a: {{'x': ground[1].x + radius_m / {FT} * cos(2 * pi() * a / 64), 'y': ground[1].y + radius_m / {FT} * sin(2 * pi() * a / 64)}}) ELSE ground END AS outline FROM loc)"""


@query("m14_problems", "drawn", f"SELECT seq, {_PROBLEM} AS problem FROM drawn")
def m14(spark, sf):
    return _raw(spark, sf).select("seq", features.problem().alias("problem"))


@query("m15_repaired", "drawn", f"WITH {_REPAIRED} SELECT seq, id, kind, radius_m, label, notes, color, created_at FROM rep")
def m15(spark, sf):
    return features.repaired(_raw(spark, sf)).select("seq", "id", "kind", "radius_m", "label", "notes", "color", "created_at")


_MEAS = f"m AS (SELECT *, list_transform(v, lambda p: {{'x': p.x, 'y': p.y}}) AS ring FROM (SELECT meas_id, tool, list({{'x': x, 'y': y, 'z': z, 'a': approximate}} ORDER BY seq) AS v, max(rise) AS rise, max(off_px) AS off_px FROM meas GROUP BY ALL))"
_L3 = "coalesce(list_sum(list_transform(list_zip(v[:len(v) - 1], v[2:]), lambda q: sqrt((q[2].x - q[1].x)^2 + (q[2].y - q[1].y)^2 + (q[2].z - q[1].z)^2))), 0)"


@query("m1_m2_lengths", "meas", f"WITH {_MEAS} SELECT meas_id, {r(s.ring_length('ring', False))} AS flat, {r(_L3)} AS slope, CASE WHEN len(v) < 2 THEN 0e0 ELSE {r(s.ring_length('ring', True))} END AS round FROM m")
def m1(spark, sf):
    m = features.measured(domain.measurements(spark, sf))
    v = F.col("v")
    return m.select("meas_id", R(rings.path_length(v)).alias("flat"), R(rings.path_length3(v)).alias("slope"), R(rings.perimeter(v)).alias("round"))


@query("m3_sides", "meas", f"""WITH w AS (SELECT *, count(*) OVER (PARTITION BY meas_id) AS n FROM meas) SELECT a.meas_id, a.seq AS a, b.seq AS b, {r('sqrt((a.x - b.x)^2 + (a.y - b.y)^2)')} AS feet
FROM w a JOIN w b ON b.meas_id = a.meas_id AND (b.seq = a.seq + 1 OR (a.tool IN ('area', 'area3d') AND a.n >= 3 AND a.seq = a.n - 1 AND b.seq = 0))""")  # fmt: skip
def m3(spark, sf):
    out = features.side_lengths(domain.measurements(spark, sf), F.col("tool").isin("area", "area3d"))
    return out.withColumn("feet", R(F.col("feet")))


def _big_patches(spark, sf):
    """One plane patch per area measurement, far wider than its outline."""
    m = domain.measurements(spark, sf).where((F.col("tool") == "area3d") & (F.col("seq") == 0))
    k = F.col("meas_id")
    z = lambda i, j: 500 + (k % 7 - 3) * 0.05 * i * 200 + (k % 5 - 2) * 0.04 * j * 200
    grid = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: z(i, j)))
    return m.select(k.alias("patch_id"), F.lit(200.0).alias("cellSize"), (F.col("x") - 6000).alias("lowerLeftX"), (F.col("y") - 6000).alias("lowerLeftY"), F.lit(-9999.0).alias("noDataValue"), grid.alias("value"))


_SURF = f"CASE WHEN {s.ring_area('ring')} > 0 THEN {s.ring_area('ring')} * sqrt(1 + ((meas_id % 7 - 3) * 0.05e0)^2 + ((meas_id % 5 - 2) * 0.04e0)^2) END"


def _surfaces(spark, sf):
    m = features.measured(domain.measurements(spark, sf)).where((F.col("tool") == "area3d") & (F.size("v") >= 3))
    outlines = m.select(F.col("meas_id").alias("shape_id"), F.col("meas_id").alias("patch_id"), F.transform("v", lambda p: rings.point(p["x"], p["y"])).alias("ring"))
    make = lambda: features.surface_areas(outlines, _big_patches(spark, sf))
    return stored(spark, f"surfaces|{sf}", make)


@query("m4_surface_area", "meas", f"WITH {_MEAS} SELECT meas_id AS shape_id, {r(s.ring_area('ring'), 3)} AS flat, {r(_SURF, 2)} AS surface FROM m WHERE tool = 'area3d' AND len(v) >= 3 AND {s.ring_area('ring')} > 0")
def m4(spark, sf):
    return _surfaces(spark, sf).select("shape_id", R(F.col("flat"), 3).alias("flat"), R(F.col("surface"), 2).alias("surface"))


#: Bent ground under the middle of each outline, a tilted footprint around it: heights of cells, and of places between or beyond.
_CELL = "(500 + ((({i})::BIGINT * 7 + ({j})::BIGINT * 11 + meas_id) % 13) * 3)::DOUBLE"


def _bent(x: str, y: str) -> str:
    u, v = (f"least(19, greatest(0, ({a}) / 50e0 - 0.5e0))" for a in (f"{x} - left0", f"{y} - low0"))
    i, j = f"least(18, floor({u}))", f"least(18, floor({v}))"
    cell = lambda a, b: _CELL.format(i=f"{i} + {a}", j=f"{j} + {b}")
    low, high = (f"({cell(0, b)} * (1 - ({u} - {i})) + {cell(1, b)} * ({u} - {i}))" for b in (0, 1))
    on = f"{x} BETWEEN left0 AND left0 + 1000 AND {y} BETWEEN low0 AND low0 + 1000"
    return f"(CASE WHEN {on} THEN {low} * (1 - ({v} - {j})) + {high} * ({v} - {j}) ELSE 400 + 0.02e0 * ({x} - left0) + 0.01e0 * ({y} - low0) END)"


_SAMPLED = f"""outline AS (SELECT meas_id, ring, {s.ring_area('ring')} AS flat, ring[1].x - 300 AS left0, ring[1].y - 300 AS low0, list_min(list_transform(ring, lambda p: p.x)) AS bx0, list_max(list_transform(ring, lambda p: p.x)) AS bx1,
 list_min(list_transform(ring, lambda p: p.y)) AS by0, list_max(list_transform(ring, lambda p: p.y)) AS by1, list_avg(list_transform(ring, lambda p: p.x)) AS mx, list_avg(list_transform(ring, lambda p: p.y)) AS my FROM m WHERE tool = 'area3d' AND len(v) >= 3),
spaced AS (SELECT *, greatest(1, sqrt((bx1 - bx0) * (by1 - by0) / 400)) AS sp, greatest(2, sp / 2) AS d FROM outline WHERE flat > 0),
sample AS (SELECT * FROM (SELECT *, bx0 + sp * (i + 0.5e0) AS sx, by0 + sp * (j + 0.5e0) AS sy FROM spaced, unnest(range(0, 600)) a(i), unnest(range(0, 600)) b(j) WHERE bx0 + sp * (i + 0.5e0) < bx1 AND by0 + sp * (j + 0.5e0) < by1) WHERE {s.even_odd('ring', 'sx', 'sy')}),
spot AS (SELECT meas_id, flat, left0, low0, d, sx, sy FROM sample UNION ALL SELECT meas_id, flat, left0, low0, d, mx, my FROM spaced WHERE meas_id NOT IN (SELECT meas_id FROM sample))"""


@query("m4_bent_surface", "meas", f"""WITH {_MEAS}, {_SAMPLED} SELECT meas_id AS shape_id, {r("any_value(flat) * avg(sqrt(1 + pow((e - w) / (2 * d), 2) + pow((n - o) / (2 * d), 2)))", 2)} AS surface
FROM (SELECT *, {_bent('(sx + d)', 'sy')} AS e, {_bent('(sx - d)', 'sy')} AS w, {_bent('sx', '(sy + d)')} AS n, {_bent('sx', '(sy - d)')} AS o FROM spot) GROUP BY meas_id""")  # fmt: skip
def m4_bent(spark, sf):
    m = features.measured(domain.measurements(spark, sf)).where((F.col("tool") == "area3d") & (F.size("v") >= 3))
    left, low, k = F.col("v")[0]["x"] - 300, F.col("v")[0]["y"] - 300, F.col("meas_id")
    far = [(a, b) for a in (-3000, 4000) for b in (-3000, 4000)]
    plane = {f"{c}{n}": e for n, (a, b) in enumerate(far) for c, e in (("x", left + a), ("y", low + b), ("z", F.lit(400 + 0.02 * a + 0.01 * b)))}
    outlines = m.select(k.alias("shape_id"), k.alias("patch_id"), F.transform("v", lambda p: rings.point(p["x"], p["y"])).alias("ring"), *[e.alias(c) for c, e in plane.items()])
    grid = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (500 + ((i * 7 + j * 11 + k) % 13) * 3).cast("double")))
    patches = m.select(k.alias("patch_id"), F.lit(50.0).alias("cellSize"), left.alias("lowerLeftX"), low.alias("lowerLeftY"), F.lit(-9999.0).alias("noDataValue"), grid.alias("value"))
    return features.surface_areas(outlines, patches, 400).select("shape_id", R(F.col("surface"), 2).alias("surface"))


def _grp(e: str, d: str) -> str:
    """Thousands separators and d decimals."""
    return f"(CASE WHEN round({e}, {d}) < 0 THEN '-' ELSE '' END || printf('%,d', floor(abs(round({e}, {d})))::BIGINT) || CASE WHEN {d} > 0 THEN '.' || lpad((round(abs(round({e}, {d})) * pow(10, {d})) % pow(10, {d}))::BIGINT::VARCHAR, {d}, '0') ELSE '' END)"


def _len_sql(e: str) -> str:
    return f"(CASE WHEN abs({e}) < 1000 THEN {_grp(e, '1')} || ' ft (' || {_grp(f'({e} * {FT})', '1')} ELSE {_grp(e, '0')} || ' ft (' || {_grp(f'({e} * {FT})', '0')} END || ' m' || CASE WHEN abs({e}) >= 5280 THEN ' · ' || {_grp(f'({e} / 5280)', '2')} || ' mi' ELSE '' END || ')')"


def _area_sql(e: str) -> str:
    m2, ac = f"({e} * {FT} * {FT})", f"({e} / 43560)"
    pick = lambda c, a, b: f"CASE WHEN {c} THEN {a} ELSE {b} END"
    return f"({pick(f'{e} < 1000', _grp(e, '1'), _grp(e, '0'))} || ' ft² (' || {pick(f'{ac} < 10', _grp(ac, '3'), _grp(ac, '1'))} || ' acres · ' || {pick(f'{m2} < 1000', _grp(m2, '1'), _grp(m2, '0'))} || ' m²)')"


_NUMS = "SELECT o_orderkey AS k, ((o_orderkey * 7919) % 2000003 - 600000) / 37e0 AS v FROM orders"


@query("m6_unit_text", "", f"""SELECT k, {_len_sql('v')} AS length, {_area_sql('(abs(v) * 11)')} AS area, CASE WHEN abs(v) * 3 >= 43560 THEN {_grp('(abs(v) * 3 / 43560)', '2')} || ' acres' WHEN abs(v) * 3 < 1000 THEN {_grp('(abs(v) * 3)', '1')} || ' ft²' ELSE {_grp('(abs(v) * 3)', '0')} || ' ft²' END AS short,
 CASE WHEN abs(v) < 1000 THEN {_grp('v', '1')} ELSE {_grp('v', '0')} END || ' ft' AS feet, CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '−' ELSE '' END || CASE WHEN abs(v) < 1000 THEN {_grp('abs(v)', '1')} ELSE {_grp('abs(v)', '0')} END || ' ft (' ||
 CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '−' ELSE '' END || CASE WHEN abs(v) < 1000 THEN {_grp(f'(abs(v) * {FT})', '1')} ELSE {_grp(f'(abs(v) * {FT})', '0')} END || ' m)' AS rise, {_grp('(v / 977 * 100)', '1')} || '%' AS percent FROM ({_NUMS})""")  # fmt: skip
def m6(spark, sf):
    k = F.col("o_orderkey")
    v = F.col("v")
    n = domain.table(spark, sf, "orders").select(k.alias("k"), (((k * 7919) % 2000003 - 600000) / 37).alias("v"))
    return n.select("k", text.length_text(v).alias("length"), text.area_text(F.abs(v) * 11).alias("area"), text.short_area_text(F.abs(v) * 3).alias("short"), text.feet_text(v).alias("feet"), text.rise_text(v).alias("rise"), text.percent_text(v / 977).alias("percent"))


@query("m5_readings", "meas", f"""WITH {_MEAS}, t AS (SELECT *, {s.ring_length('ring', False)} AS flat, {_L3} AS slope, v[len(v)].z - v[1].z AS change, v[1].z AS fz, v[1].x AS fx, v[1].y AS fy FROM m)
SELECT meas_id, tool, CASE WHEN tool = 'distance' THEN 'Distance: ' || {_len_sql('flat')} WHEN tool = 'distance3d' THEN 'Distance 3D: ' || {_len_sql('slope')} WHEN tool = 'area' AND len(v) >= 3 THEN 'Area: ' || {_area_sql(s.ring_area('ring'))}
  WHEN tool = 'surface' THEN 'Latitude, longitude: ' || printf('%.6f', {s.lat_of('fx', 'fy')}) || ', ' || printf('%.6f', {s.lon_of('fx', 'fy')}) WHEN tool = 'height' AND rise IS NOT NULL THEN 'Height: ' || {_len_sql('rise')}
  WHEN tool = 'location3d' AND rise IS NOT NULL THEN 'Elevation: ' || {_len_sql('(fz + rise)')} END AS answer,
 len(list_filter(v, lambda p: p.a)) > 0 AS approximate, coalesce(tool IN ('height', 'location3d') AND rise IS NOT NULL AND off_px > 12, false) AS off_line, coalesce(tool IN ('height', 'location3d') AND rise < 0, false) AS below FROM t""")  # fmt: skip
def m5(spark, sf):
    m = features.measured(domain.measurements(spark, sf)).join(_surfaces(spark, sf).select(F.col("shape_id").alias("meas_id"), "surface"), "meas_id", "left")
    out = features.readings(stored(spark, f"measured|{sf}", lambda: m))
    first = F.try_element_at("rows", F.lit(1))
    answer = F.when(F.col("tool") == "location3d", F.try_element_at("rows", F.lit(2))).when(F.col("tool") != "area3d", first)
    has = lambda t: F.exists("warnings", lambda w: F.startswith(w, F.lit(t)))
    return out.select("meas_id", "tool", answer.alias("answer"), has("One photo").alias("approximate"), has("The top").alias("off_line"), has("The second").alias("below"))


_LL = lambda p: f"{{'lon': {s.lon_of(f'{p}.x', f'{p}.y')}, 'lat': {s.lat_of(f'{p}.x', f'{p}.y')}}}"


@query("m7_m8_m16_geometry", "drawn", f"""WITH {_REPAIRED}, g AS (SELECT id, kind, CASE WHEN kind IN ('point', 'text') THEN 'Point' WHEN kind = 'line' THEN 'LineString' ELSE 'Polygon' END AS type, outline, ground FROM outl)
SELECT id, type, len(outline) + CASE WHEN type = 'Polygon' THEN 1 ELSE 0 END AS n, {r('outline[len(outline)].x', 3)} AS last_x, {r('outline[len(outline)].y', 3)} AS last_y, {r(s.lon_of('outline[1].x', 'outline[1].y'), 8)} AS lon, {r(s.lat_of('outline[1].x', 'outline[1].y'), 8)} AS lat FROM g""")  # fmt: skip
def m8(spark, sf):
    loc = _located(spark, sf)
    deg = features.with_geometry(loc).select("id", "type", F.size("path").alias("n"), R(F.col("path")[0]["lon"], 8).alias("lon"), R(F.col("path")[0]["lat"], 8).alias("lat"))
    grid = features.with_geometry(loc, "stateplane")
    at = F.element_at("path", F.when(F.col("type") == "Polygon", -2).otherwise(-1))
    grid = grid.select("id", R(at["lon"], 3).alias("last_x"), R(at["lat"], 3).alias("last_y"))
    return deg.join(grid, "id")


@query("m9_s14_attributes", "drawn", f"""WITH {_REPAIRED} SELECT id, kind, label, notes, color, CASE WHEN kind = 'circle' THEN radius_m END AS radius_m, CASE WHEN kind = 'line' THEN {r(s.ring_length('ground', False), 3)} END AS length_ft,
 CASE WHEN kind IN ('polygon', 'rectangle') THEN {r(s.ring_length('ground', True), 3)} WHEN kind = 'circle' THEN {r(f'2 * pi() * radius_m / {FT}', 3)} END AS perimeter_ft,
 CASE WHEN kind IN ('polygon', 'rectangle') THEN {r(s.ring_area('ground'), 1)} WHEN kind = 'circle' THEN {r(f'pi() * pow(radius_m / {FT}, 2)', 1)} END AS area_sqft, created_at AS created FROM loc""")  # fmt: skip
def m9(spark, sf):
    a = features.attributes(_located(spark, sf))
    return a.withColumns({"length_ft": R(F.col("length_ft"), 3), "perimeter_ft": R(F.col("perimeter_ft"), 3), "area_sqft": R(F.col("area_sqft"), 1)})


@query("m10_m11_label_points", "drawn", f"""WITH {_REPAIRED}, c AS (SELECT *, {s.ring_sum('ground', '((a.x - ground[1].x) * (b.y - ground[1].y) - (b.x - ground[1].x) * (a.y - ground[1].y))')} AS tw,
 {s.ring_sum('ground', '((a.x + b.x - 2 * ground[1].x) * ((a.x - ground[1].x) * (b.y - ground[1].y) - (b.x - ground[1].x) * (a.y - ground[1].y)))')} AS tx,
 {s.ring_sum('ground', '((a.y + b.y - 2 * ground[1].y) * ((a.x - ground[1].x) * (b.y - ground[1].y) - (b.x - ground[1].x) * (a.y - ground[1].y)))')} AS ty FROM loc WHERE kind IN ('polygon', 'rectangle')),
d AS (SELECT *, ground[1].x + tx / (3 * tw) AS gx, ground[1].y + ty / (3 * tw) AS gy FROM c), e AS (SELECT *, {s.even_odd('ground', 'gx', 'gy')} AS hit FROM d)
SELECT id, {r(s.lon_of('gx', 'gy'), 7)} AS lon, {r(s.lat_of('gx', 'gy'), 7)} AS lat FROM e WHERE hit UNION ALL SELECT id, {r('coordinates[1].lon', 7)}, {r('coordinates[1].lat', 7)} FROM loc WHERE kind IN ('point', 'text', 'circle')""")  # fmt: skip
def m10(spark, sf):
    loc = _located(spark, sf)
    cx, cy = rings.centroid(F.col("ground"))
    c = rings.settle(loc.withColumns({"gx": cx, "gy": cy}), "gx", "gy")
    inside = c.where(~F.col("kind").isin("polygon", "rectangle") | F.coalesce(rings.inside(F.col("ground"), F.col("gx"), F.col("gy")), F.lit(False))).where(F.col("kind") != "line").select("id")
    return features.label_points(loc).join(inside, "id", "left_semi").select("id", R(F.col("lon"), 7).alias("lon"), R(F.col("lat"), 7).alias("lat"))


@query("m10_label_points_all")
def m10_all(spark, sf):
    return features.label_points(_located(spark, sf)).select("id", "kind", R(F.col("lon"), 6).alias("lon"), R(F.col("lat"), 6).alias("lat"))


@query("m12_bounds", "drawn", f"""WITH {_REPAIRED}, p AS (SELECT id, kind, CASE WHEN kind = 'circle' THEN list_transform(outline, lambda q: {_LL('q')}) ELSE coordinates END AS c FROM outl)
SELECT id, {r('list_min(list_transform(c, lambda q: q.lon))', 7)} AS west, {r('list_min(list_transform(c, lambda q: q.lat))', 7)} AS south, {r('list_max(list_transform(c, lambda q: q.lon))', 7)} AS east, {r('list_max(list_transform(c, lambda q: q.lat))', 7)} AS north FROM p""")  # fmt: skip
def m12(spark, sf):
    return features.bounds(_located(spark, sf)).select("id", *[R(F.col(c), 7).alias(c) for c in ("west", "south", "east", "north")])


_HERE, _THERE = ("lon", "lat"), ("(lon + 0.01e0)", "(lat + 0.002e0)")
_D13 = f"sqrt(pow({s.grid_x(*_HERE)} - {s.grid_x(*_THERE)}, 2) + pow({s.grid_y(*_HERE)} - {s.grid_y(*_THERE)}, 2)) * {FT}"


@query("m13_ground_distance", "places", f"SELECT point_id, {r(_D13, 4)} AS d FROM places")
def m13(spark, sf):
    d = features.ground_distance_m(F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.002)
    return domain.places(spark, sf).select("point_id", R(d, 4).alias("d"))


@query("m17_layers", "drawn", f"""WITH {_REPAIRED}, g AS (SELECT CASE WHEN kind IN ('point', 'text') THEN 'points' WHEN kind = 'line' THEN 'lines' ELSE 'polygons' END AS layer, unnest(outline) AS p FROM outl),
n AS (SELECT CASE WHEN kind IN ('point', 'text') THEN 'points' WHEN kind = 'line' THEN 'lines' ELSE 'polygons' END AS layer, count(*) AS n FROM outl GROUP BY 1)
SELECT layer, any_value(n) AS n, {r('min(p.x)', 3)} AS min_x, {r('min(p.y)', 3)} AS min_y, {r('max(p.x)', 3)} AS max_x, {r('max(p.y)', 3)} AS max_y FROM g JOIN n USING (layer) GROUP BY layer""")  # fmt: skip
def m17(spark, sf):
    out = features.layer_extents(features.with_geometry(_located(spark, sf), "stateplane"))
    return out.select("layer", "n", *[R(F.col(c), 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def _clicks(spark, sf):
    """Clicks near vertices of drawn features, on the grid."""
    loc = _located(spark, sf)
    at = F.element_at("outline", (F.col("seq") % F.size("outline") + 1).cast("int"))
    off = lambda a, m: ((F.col("seq") * a) % m - m // 2).cast("double")
    return loc.select(F.col("seq").alias("click_id"), (at["x"] + off(37, 61)).alias("cx"), (at["y"] + off(53, 47)).alias("cy"))


_CLICK = "ck AS (SELECT seq AS click_id, outline[1 + seq % len(outline)].x + (seq * 37) % 61 - 30 AS cx, outline[1 + seq % len(outline)].y + (seq * 53) % 47 - 23 AS cy FROM outl)"
_SEG = s.seg_dist("a.x", "a.y", "b.x", "b.y", "cx", "cy")


@query("m18_hit_test", "drawn", f"""WITH {_REPAIRED}, {_CLICK}, bx AS (SELECT *, list_min(list_transform(outline, lambda q: q.x)) - 200 AS x0, list_max(list_transform(outline, lambda q: q.x)) + 200 AS x1, list_min(list_transform(outline, lambda q: q.y)) - 200 AS y0, list_max(list_transform(outline, lambda q: q.y)) + 200 AS y1 FROM outl),
 pr AS MATERIALIZED (SELECT click_id, cx, cy, bx.* FROM ck JOIN bx ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1),
 t AS (SELECT click_id, id, seq, kind, label, sqrt((cx - outline[1].x)^2 + (cy - outline[1].y)^2) AS hub, abs(cx - outline[1].x) AS dx, abs(cy - outline[1].y) AS dy, CASE WHEN kind = 'line' THEN {s.ring_min('outline', _SEG, False)} WHEN len(outline) > 2 THEN {s.ring_min('outline', _SEG)} END AS edge,
  CASE WHEN len(outline) > 2 THEN {s.even_odd('outline', 'cx', 'cy')} END AS hit, {s.ring_area('outline')} AS area FROM pr),
 k AS (SELECT *, CASE WHEN kind = 'point' AND hub <= 12 THEN {{'rank': 0, 'tie': hub}} WHEN kind = 'text' AND dx <= greatest(12, length(label) * 4 + 4) AND dy <= 12 THEN {{'rank': 0, 'tie': hub}} WHEN kind = 'line' AND edge <= 9 THEN {{'rank': 1, 'tie': edge}}
  WHEN kind IN ('polygon', 'rectangle', 'circle') AND edge <= 9 THEN {{'rank': 2, 'tie': edge}} WHEN kind IN ('polygon', 'rectangle', 'circle') AND hit THEN {{'rank': 3, 'tie': area}} END AS k FROM t)
SELECT click_id, arg_min(id, {{'r': k.rank, 't': k.tie, 's': seq}}) AS id, min(k.rank) AS rank FROM k WHERE k IS NOT NULL GROUP BY click_id""")  # fmt: skip
def m18(spark, sf):
    shapes = _located(spark, sf).select("id", "seq", "kind", "label", "outline")
    return features.hits(_clicks(spark, sf), shapes)


def _near(spark, sf):
    return _located(spark, sf).join(_clicks(spark, sf), F.col("seq") == F.col("click_id"))


@query("m19_nearest_edge", "drawn", f"""WITH {_REPAIRED}, {_CLICK}, e AS (SELECT c.click_id, c.cx, c.cy, unnest(range(0, len(outline) - CASE WHEN kind = 'line' THEN 1 ELSE 0 END)) AS after, outline FROM outl JOIN ck c ON c.click_id = outl.seq WHERE len(outline) > 1),
 d AS (SELECT *, outline[after + 1] AS a, outline[1 + (after + 1) % len(outline)] AS b FROM e), f AS (SELECT *, {_SEG} AS d FROM d)
SELECT click_id, {r('min(d)', 3)} AS d FROM f WHERE d <= 9 GROUP BY click_id""")  # fmt: skip
def m19(spark, sf):
    near = _near(spark, sf).where(F.size("outline") > 1)
    return features.nearest_edge(near, F.col("kind") != "line").select("click_id", R(F.col("d"), 3).alias("d"))


@query("m19_nearest_handle", "drawn", f"""WITH {_REPAIRED}, {_CLICK}, h AS (SELECT seq, unnest(CASE WHEN kind = 'circle' THEN [ground[1], outline[1]] ELSE ground END) AS p, unnest(range(0, CASE WHEN kind = 'circle' THEN 2 ELSE len(ground) END)) AS i, kind FROM outl),
 d AS (SELECT click_id, i, kind, sqrt((p.x - cx)^2 + (p.y - cy)^2) AS d FROM h JOIN ck ON click_id = seq)
SELECT click_id, arg_min(i, {{'d': d, 'i': i}}) AS index, CASE WHEN any_value(kind) <> 'circle' THEN 'vertex' WHEN arg_min(i, {{'d': d, 'i': i}}) = 0 THEN 'centre' ELSE 'radius' END AS role, {r('min(d)', 3)} AS d FROM d WHERE d <= 11 GROUP BY click_id""")  # fmt: skip
def m19h(spark, sf):
    loc = _located(spark, sf)
    pairs = features.handles(loc).join(loc.select("id", "seq"), "id").join(_clicks(spark, sf), F.col("seq") == F.col("click_id"))
    out = features.nearest_handle(pairs)
    return out.select("click_id", F.col("index").cast("long").alias("index"), "role", R(F.col("d"), 3).alias("d"))


#: Every click against every feature, edge by edge and handle by handle; boxes only save work.
_EVERY = f"""ev AS MATERIALIZED (SELECT c.click_id, c.cx, c.cy, o.id, o.seq, o.kind, o.ground, o.outline FROM outl o JOIN ck c ON c.cx BETWEEN list_min(list_transform(o.outline, lambda q: q.x)) - 20 AND list_max(list_transform(o.outline, lambda q: q.x)) + 20
 AND c.cy BETWEEN list_min(list_transform(o.outline, lambda q: q.y)) - 20 AND list_max(list_transform(o.outline, lambda q: q.y)) + 20)"""


@query("m19_nearest_edge_of_all", "drawn", f"""WITH {_REPAIRED}, {_CLICK}, {_EVERY}, e AS (SELECT click_id, cx, cy, id, seq, outline, unnest(range(0, len(outline) - CASE WHEN kind = 'line' THEN 1 ELSE 0 END)) AS after FROM ev WHERE len(outline) > 1),
 d AS (SELECT *, outline[after + 1] AS a, outline[1 + (after + 1) % len(outline)] AS b FROM e),
 t AS (SELECT *, greatest(0, least(1, coalesce(((cx - a.x) * (b.x - a.x) + (cy - a.y) * (b.y - a.y)) / nullif((b.x - a.x)^2 + (b.y - a.y)^2, 0), 0))) AS t FROM d),
 f AS (SELECT *, a.x + t * (b.x - a.x) AS x, a.y + t * (b.y - a.y) AS y, sqrt((cx - a.x - t * (b.x - a.x))^2 + (cy - a.y - t * (b.y - a.y))^2) AS d FROM t)
SELECT click_id, {r('min(d)', 3)} AS d, arg_min(id, {{'d': round(d, 6), 's': seq, 'o': -after}}) AS id, {r("arg_min(x, {'d': round(d, 6), 's': seq, 'o': -after})", 2)} AS x, {r("arg_min(y, {'d': round(d, 6), 's': seq, 'o': -after})", 2)} AS y FROM f WHERE d <= 9 GROUP BY click_id""")  # fmt: skip
def m19_all(spark, sf):
    shapes = _located(spark, sf).select("id", "seq", "kind", "outline")
    out = features.nearest_edges(_clicks(spark, sf), shapes)
    return out.select("click_id", R(F.col("d"), 3).alias("d"), "id", R(F.col("x"), 2).alias("x"), R(F.col("y"), 2).alias("y"))


@query("m19_nearest_handle_of_all", "drawn", f"""WITH {_REPAIRED}, {_CLICK}, {_EVERY}, h AS (SELECT click_id, cx, cy, id, seq, kind, unnest(CASE WHEN kind = 'circle' THEN [ground[1], outline[1]] ELSE ground END) AS p, unnest(range(0, CASE WHEN kind = 'circle' THEN 2 ELSE len(ground) END)) AS i FROM ev),
 d AS (SELECT *, sqrt((p.x - cx)^2 + (p.y - cy)^2) AS d, {{'d': sqrt((p.x - cx)^2 + (p.y - cy)^2), 's': seq, 'i': i}} AS k FROM h)
SELECT click_id, arg_min(id, k) AS id, arg_min(i, k) AS index, arg_min(CASE WHEN kind <> 'circle' THEN 'vertex' WHEN i = 0 THEN 'centre' ELSE 'radius' END, k) AS role, {r('min(d)', 3)} AS d FROM d WHERE d <= 11 GROUP BY click_id""")  # fmt: skip
def m19_handles_all(spark, sf):
    out = features.nearest_handles(_clicks(spark, sf), _located(spark, sf))
    return out.select("click_id", "id", F.col("index").cast("long").alias("index"), "role", R(F.col("d"), 3).alias("d"))
