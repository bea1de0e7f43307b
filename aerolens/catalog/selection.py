"""Queries over frame selection (Q) and its evaluation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.registry import R, query, r
from aerolens.operators import select


def _picks(df, keep=("point_id",)):
    return df.select(
        *keep, F.col("pick").cast("long").alias("pick"), "filename", "camera", R(F.col("look_azimuth_deg")).alias("look_azimuth_deg"),
        R(F.col("az_off_deg")).alias("az_off_deg"), "az_ok", "eligible", "is_reflight", "ts_utc", "pass_id", "shot",
        R(F.col("center_dist_ft")).alias("center_dist_ft"), R(F.col("edge_frac")).alias("edge_frac"), R(F.col("est_gsd_ft")).alias("est_gsd_ft"),
    )


_PICK_SQL = (
    f"pick, filename, camera, {r('look_azimuth_deg')} AS look_azimuth_deg, {r('az_off')} AS az_off_deg, az_ok, eligible, is_reflight, ts_utc, "
    f"pass_id, shot, {r('center_dist')} AS center_dist_ft, {r('edge_frac')} AS edge_frac, {r('gsd')} AS est_gsd_ft"
)


@query("q1_frames_at_point", "ranked", f"SELECT point_id, {_PICK_SQL} FROM ranked WHERE pick <= 5")
def q1(spark, sf):
    return _picks(select.frames_at_points(domain.points(spark, sf), domain.frames(spark, sf)))


def _wide(lon: str, lat: str) -> str:
    return f"{s.grid_x(lon, lat)} AS px, {s.grid_y(lon, lat)} AS py"


def _rank_sql(source: str, part: str) -> str:
    """Candidates of a table (px, py, want_azimuth and key columns) ranked within `part`."""
    return s.picked(f"({s.candidates(source)})", part)


@query(
    "q2_frames_at_lonlat",
    "places fg",
    f"WITH w AS (SELECT *, {_wide('lon', 'lat')} FROM places), k AS ({_rank_sql('w', 'point_id')}) SELECT point_id, {_PICK_SQL} FROM k WHERE pick <= 5".replace("round(center_dist, 6)", "round(center_dist, 1)"),
)
def q2(spark, sf):
    out = _picks(select.frames_at_lonlat(domain.places(spark, sf), domain.frames(spark, sf)))
    return out.withColumn("center_dist_ft", R(F.col("center_dist_ft"), 1))


def _views_sql(views: str, n: int = 5) -> str:
    lon, lat = f"west + (east - west) * i / {n - 1}e0", f"south + (north - south) * j / {n - 1}e0"
    ends = [(a, b) for a in ("west", "east") for b in ("south", "north")]
    box = ", ".join(
        f"{fn}({', '.join(f(a, b) for a, b in ends)}) AS {name}"
        for fn, f, name in (("least", s.grid_x, "vx0"), ("least", s.grid_y, "vy0"), ("greatest", s.grid_x, "vx1"), ("greatest", s.grid_y, "vy1"))
    )
    return f"""
vp AS (SELECT v.*, i, j, {s.grid_x(lon, lat)} AS px, {s.grid_y(lon, lat)} AS py, {box} FROM {views} v, unnest(range(0, {n})) a(i), unnest(range(0, {n})) b(j)),
won AS (SELECT view_id, i, j, arg_min(filename, {s.preference()}) AS filename FROM ({s.candidates('vp')})
 WHERE az_ok AND want_azimuth IS NOT NULL AND NOT (xmax < vx0 OR xmin > vx1 OR ymax < vy0 OR ymin > vy1) GROUP BY view_id, i, j),
shown AS (SELECT view_id, filename, count(*) AS wins, row_number() OVER (PARTITION BY view_id ORDER BY {{'fewer': -count(*), 'name': filename}}) AS place FROM won GROUP BY view_id, filename)"""


@query("q3_frames_in_view", "views fg", f"WITH {_views_sql('views')} SELECT view_id, place, filename, wins FROM shown WHERE place <= 6")
def q3(spark, sf):
    out = select.frames_in_views(domain.views(spark, sf), domain.frames(spark, sf))
    return out.select("view_id", F.col("place").cast("long").alias("place"), "filename", F.col("wins").cast("long").alias("wins"))


_NEIGHBOURS = """
nb AS (SELECT c.filename AS of, 'next' AS direction, n.filename, n.shot, n.x, n.y, c.x AS cx, c.y AS cy, n.shot - c.shot AS gap
  FROM frames c JOIN LATERAL (SELECT f.filename, f.shot, f.x, f.y FROM frames f WHERE f.pass_id = c.pass_id AND f.camera = c.camera AND f.shot > c.shot ORDER BY f.shot LIMIT 1) n ON true
 UNION ALL SELECT c.filename, 'prev', n.filename, n.shot, n.x, n.y, c.x, c.y, c.shot - n.shot
  FROM frames c JOIN LATERAL (SELECT f.filename, f.shot, f.x, f.y FROM frames f WHERE f.pass_id = c.pass_id AND f.camera = c.camera AND f.shot < c.shot ORDER BY f.shot DESC LIMIT 1) n ON true),
near AS (SELECT of, direction, filename, shot, sqrt((x - cx)^2 + (y - cy)^2) AS dist_ft FROM nb WHERE gap <= 5 AND sqrt((x - cx)^2 + (y - cy)^2) <= 3000)"""


@query("q4_frame_neighbours", "frames", f'WITH {_NEIGHBOURS} SELECT "of", direction, filename, shot, {r("dist_ft")} AS dist_ft FROM near')
def q4(spark, sf):
    return select.frame_neighbours(domain.frames(spark, sf)).withColumn("dist_ft", R(F.col("dist_ft")))


_NAMES = "names AS (SELECT 'SURVEY_2024_Season' || (1 + (l_suppkey + l_partkey) % 2) || '_3IN/Fwd_' || (7001 + l_partkey % 60) || '_' || (40000 + l_suppkey % 60) || '.tif' AS filename FROM lineitem)"


def _names(spark, sf):
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    return domain.table(spark, sf, "lineitem").select(
        F.concat(
            F.lit("SURVEY_2024_Season"), (1 + (q + p) % 2).cast("string"), F.lit("_3IN/Fwd_"), (7001 + p % 60).cast("string"),
            F.lit("_"), (40000 + q % 60).cast("string"), F.lit(".tif"),
        ).alias("filename")
    )


def _half(expr: str, d: int) -> str:
    return f"(floor(({expr}) * 1e{d} + 0.5e0) / 1e{d})"


@query(
    "q5_frame_detail",
    "frames",
    f"""WITH {_NAMES} SELECT filename, 'https://images.example/frames/' || filename AS url, 'https://images.example/frames/' || regexp_replace(filename, '\\.tif$', '.json') AS "sidecarUrl",
 season_key AS "seasonKey", fl, shot, camera, exposure_id AS "exposureId", pass_id AS "passId", shot_prefix AS "shotPrefix", is_reflight AS "isReflight",
 flight_date::VARCHAR AS "localDate", strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS utc, {_half(s.lon_of('x', 'y'), 6)} AS lon, {_half(s.lat_of('x', 'y'), 6)} AS lat,
 {_half('look_azimuth_deg', 2)} AS "lookAzimuth", {_half('track_heading_deg', 2)} AS "trackHeading", {_half('kappa_err_deg', 2)} AS "kappaErr", kappa_flag AS "kappaFlag",
 cam_width_px AS "widthPx", {_half(s.lon_of('x2', 'y2'), 6)} AS lon3, {_half(s.lat_of('x2', 'y2'), 6)} AS lat3, z2 AS z3
FROM frames WHERE filename IN (SELECT filename FROM names)""",
)
def q5(spark, sf):
    d = select.frame_detail(domain.frames(spark, sf), _names(spark, sf), domain.IMAGE_BASE)
    return d.select(
        "filename", "url", "sidecarUrl", "seasonKey", "fl", "shot", "camera", "exposureId", "passId", "shotPrefix", "isReflight",
        "flown.localDate", "flown.utc", "eo.lon", "eo.lat", "lookAzimuth", "trackHeading", "kappaErr", "kappaFlag", "sensor.widthPx",
        F.col("footprintLonLat")[2][0].alias("lon3"), F.col("footprintLonLat")[2][1].alias("lat3"), F.col("footprint3089")[2][2].alias("z3"),
    )


@query(
    "q6_existing",
    "frames",
    f"WITH {_NAMES} SELECT filename, filename IN (SELECT filename FROM frames) AS found, count(*) AS n FROM names GROUP BY ALL",
)
def q6(spark, sf):
    return select.existing(_names(spark, sf), domain.frames(spark, sf)).groupBy("filename", "found").agg(F.count("*").alias("n"))


@query(
    "q7_scene_frames",
    "views fg",
    f"""WITH {_views_sql('views')} SELECT s.view_id, s.place, s.filename, s.wins, 'https://images.example/frames/' || s.filename AS url, f.camera,
 {_half('f.look_azimuth_deg', 2)} AS "lookAzimuth", f.is_reflight AS "isReflight", strftime(f.ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS "flownUtc", f.x AS eo_x, {r('f.kappa')} AS eo_kappa,
 f.cam_focal_mm AS focal, f.x0 + f.x1 + f.x2 + f.x3 AS sum_x, f.y0 + f.y1 + f.y2 + f.y3 AS sum_y, f.z3 AS z_last FROM shown s JOIN fg f USING (filename) WHERE place <= 6""",
)
def q7(spark, sf):
    frames = domain.frames(spark, sf)
    wins = select.frames_in_views(domain.views(spark, sf), frames)
    c = F.col("footprint3089")
    return select.scene_frames(wins, frames, domain.IMAGE_BASE).select(
        "view_id", F.col("place").cast("long").alias("place"), "filename", F.col("wins").cast("long").alias("wins"), "url", "camera",
        "lookAzimuth", "isReflight", "flownUtc", F.col("eo.x").alias("eo_x"), R(F.col("eo.kappa")).alias("eo_kappa"), F.col("sensor.focalMm").alias("focal"),
        (c[0][0] + c[1][0] + c[2][0] + c[3][0]).alias("sum_x"), (c[0][1] + c[1][1] + c[2][1] + c[3][1]).alias("sum_y"), c[3][2].alias("z_last"),
    )


_LOOKS = ["North", "west", "down", "45", "-90", "450", "sideways", "constructor", "1e3", "", " East ", "12345", "22.5", "-0.5"]


def _looks(spark, sf):
    k = F.col("c_custkey")
    return domain.table(spark, sf, "customer").select(
        k.alias("request_id"),
        F.concat(F.element_at(F.array(*[F.lit(v) for v in _LOOKS]), (k % len(_LOOKS) + 1).cast("int")), F.when(k % 3 == 1, (k % 97).cast("string")).otherwise("")).alias("raw"),
    )


_LOOK_SQL = f"SELECT c_custkey AS request_id, {_LOOKS!r}[1 + c_custkey % {len(_LOOKS)}] || CASE WHEN c_custkey % 3 = 1 THEN (c_custkey % 97)::VARCHAR ELSE '' END AS raw FROM customer"
_PARSE = """SELECT *, key IN ('north', 'east', 'south', 'west', 'down') OR regexp_full_match(key, '-?[0-9]{1,4}([.][0-9]+)?') AS ok,
 CASE key WHEN 'north' THEN 0 WHEN 'east' THEN 90 WHEN 'south' THEN 180 WHEN 'west' THEN 270 ELSE CASE WHEN regexp_full_match(key, '-?[0-9]{1,4}([.][0-9]+)?')
 THEN (key::DOUBLE % 360 + 360) % 360 END END::DOUBLE AS azimuth FROM (SELECT *, lower(trim(raw)) AS key FROM looks)"""


@query("q8_parse_look", "", f"WITH looks AS ({_LOOK_SQL}), p AS ({_PARSE}) SELECT request_id, ok, CASE WHEN ok THEN key END AS label, azimuth FROM p")
def q8(spark, sf):
    return _looks(spark, sf).select("request_id", select.parse_look(F.col("raw")).alias("p")).select("request_id", "p.ok", "p.label", "p.azimuth")


@query(
    "q9_point_requests",
    "",
    f"""WITH looks AS ({_LOOK_SQL}), p AS ({_PARSE}), q AS (SELECT *, -200e0 + request_id % 400 AS lon, -95e0 + (request_id * 7) % 190 AS lat, request_id % 23 AS lim FROM p)
SELECT request_id, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon must be between -180 and 180' WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat must be between -90 and 90'
 WHEN lim NOT BETWEEN 1 AND 20 THEN 'limit must be between 1 and 20' WHEN length(raw) > 12 THEN 'look is too long'
 WHEN NOT ok THEN 'look must be north, east, south, west, down, or a bearing in degrees' END AS problem FROM q""",
)
def q9(spark, sf):
    k = F.col("request_id")
    asked = _looks(spark, sf).select(
        k, F.col("raw").alias("look"), (k % 400 - 200).cast("double").alias("lon"), ((k * 7) % 190 - 95).cast("double").alias("lat"), (k % 23).alias("lim")
    )
    return asked.select("request_id", select.point_request_problem().alias("problem"))


@query(
    "q9_view_requests",
    "",
    f"""WITH looks AS ({_LOOK_SQL}), p AS ({_PARSE}), q AS (SELECT *, -85e0 + request_id % 7 AS west, west + (request_id % 11 - 2) / 64e0 AS east, 38e0 AS south, south + (request_id % 9 - 1) / 128e0 AS north, request_id % 14 AS lim FROM p)
SELECT request_id, CASE WHEN lim NOT BETWEEN 1 AND 12 THEN 'limit must be between 1 and 12' WHEN length(raw) > 12 THEN 'look is too long'
 WHEN NOT ok OR azimuth IS NULL THEN 'look must be north, east, south, west, or a bearing in degrees'
 WHEN NOT (east > west AND north > south) OR east - west > 0.08e0 OR north - south > 0.08e0 THEN 'the view must have west < east and south < north, and be no more than 0.08 degrees across' END AS problem FROM q""",
)
def q9v(spark, sf):
    k = F.col("request_id")
    asked = _looks(spark, sf).select(k, F.col("raw").alias("look"), (k % 7 - 85).cast("double").alias("west"), F.lit(38.0).alias("south"), (k % 14).alias("lim"))
    asked = asked.withColumns({"east": F.col("west") + (k % 11 - 2) / F.lit(64.0), "north": F.col("south") + (k % 9 - 1) / F.lit(128.0)})
    return asked.select("request_id", select.view_request_problem().alias("problem"))


@query(
    "q9_name_requests",
    "raw_frames_faulty",
    "SELECT rn, season_key, coalesce(regexp_full_match(Filename, 'SURVEY_[0-9]{4}_Season[0-9]_3IN/(Color|Fwd|Bwd|Left|Right)_[0-9_]{1,40}[.]tif'), false) AS ok FROM raw_frames_faulty",
)
def q9n(spark, sf):
    ok = select.name_request_ok(F.col("Filename"), domain.FOLDER_PREFIX, domain.FOLDER_SUFFIX)
    return domain.raw_frames_faulty(spark, sf).select("rn", "season_key", ok.alias("ok"))


_SHAPED = f"""SELECT point_id, want_azimuth, pick, filename, 'https://images.example/frames/' || filename AS url, camera, {_half('look_azimuth_deg', 1)} AS "lookAzimuth", {_half('az_off', 1)} AS "azOff",
 az_ok AS "azOk", eligible, is_reflight AS "isReflight", strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS "flownUtc", pass_id AS "passId", shot, floor(center_dist + 0.5e0)::BIGINT AS "centerDistFt",
 {_half('edge_frac', 2)} AS "edgeFrac", {_half('gsd', 3)} AS "estGsdFt" FROM ranked WHERE pick <= 5"""


@query("q10_shaped_picks", "ranked", _SHAPED)
def q10(spark, sf):
    picks = select.frames_at_points(domain.points(spark, sf), domain.frames(spark, sf)).drop("px", "py")
    return select.shaped_picks(picks, domain.IMAGE_BASE).withColumn("pick", F.col("pick").cast("long"))


@query(
    "q11_described_picks",
    "ranked",
    f"""WITH sh AS ({_SHAPED}), d AS (SELECT *, bool_or(coalesce("azOk", false)) OVER (PARTITION BY point_id) AS anyok, count(*) FILTER (WHERE NOT eligible) OVER (PARTITION BY point_id) >= 2 AS shares,
 CASE WHEN want_azimuth IS NULL THEN 'down' ELSE ['north', 'east', 'south', 'west'][1 + (want_azimuth / 90)::INT] END AS want, floor(coalesce("azOff", 0) + 0.5e0)::BIGINT AS away FROM sh)
SELECT point_id, pick, filename, CASE WHEN "lookAzimuth" IS NULL THEN 'Straight down' ELSE 'Looking ' || ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][1 + floor(("lookAzimuth" % 360 + 360) % 360 / 45 + 0.5e0)::INT % 8] END AS title,
 camera || ' camera; flown ' || "flownUtc"[1:10] || coalesce('; about ' || printf('%.2f', "estGsdFt") || ' ft per pixel here', '') AS facts,
 concat_ws('; ', CASE WHEN NOT coalesce("azOk", false) AND want <> 'down' THEN CASE WHEN anyok THEN 'Looks ' || away || '° away from ' || want || '.' ELSE 'No photo here looks ' || want || '. This is the closest, ' || away || '° away.' END END,
  CASE WHEN NOT eligible THEN 'The point is near the edge of this photo, or the resolution is coarse there.' END, CASE WHEN "isReflight" THEN 'From a later re-flight of the line.' END) AS notes,
 NOT eligible AS "nearEdge", shares AS "sharesEdgeNote" FROM d""",
)
def q11(spark, sf):
    picks = select.frames_at_points(domain.points(spark, sf), domain.frames(spark, sf)).drop("px", "py")
    want = F.when(F.col("want_azimuth").isNull(), "down").otherwise(domain.pick((F.col("want_azimuth") / 90).cast("int"), "north", "east", "south", "west"))
    d = select.described_picks(select.shaped_picks(picks, domain.IMAGE_BASE), want)
    return d.withColumns({"facts": F.array_join("facts", "; "), "notes": F.array_join("notes", "; "), "pick": F.col("pick").cast("long")})


@query(
    "q12_outline_terms",
    "fg",
    f"SELECT filename, {r('cen_x')} AS cen_x, {r('cen_y')} AS cen_y, {r('sqrt_area')} AS sqrt_area, z_mid, xmin, ymin, xmax, ymax FROM fg",
)
def q12(spark, sf):
    f = select.with_outline_terms(domain.frames(spark, sf).select("filename", *select.OUTLINE))
    return f.select("filename", R(F.col("cen_x")).alias("cen_x"), R(F.col("cen_y")).alias("cen_y"), R(F.col("sqrt_area")).alias("sqrt_area"), "z_mid", "xmin", "ymin", "xmax", "ymax")


@query("q13_page", "ranked", "SELECT point_id, pick, filename FROM ranked WHERE pick BETWEEN 6 AND 10")
def q13(spark, sf):
    c = select.graded(select.candidates(domain.points(spark, sf), domain.frames(spark, sf)))
    return select.page(c, ["point_id"], 6, 5).select("point_id", F.col("pick").cast("long").alias("pick"), "filename")
