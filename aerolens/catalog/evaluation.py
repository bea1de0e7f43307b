"""Queries over the evaluation of the selection rule (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.registry import R, query, r
from aerolens.catalog.selection import _rank_sql, _views_sql
from aerolens.operators import evaluate, select
from aerolens.session import stored

_SAMPLE = "pts AS (SELECT filename AS point_id, (x0 + x2) / 2 AS px, (y0 + y2) / 2 AS py FROM frames WHERE camera = 'Color' ORDER BY md5(filename || '42'), filename LIMIT 2000)"
_DIRS = "dirs AS (SELECT unnest([0e0, 90e0, 180e0, 270e0]) AS want_azimuth), asked AS (SELECT * FROM pts, dirs)"
_TOP = f"{_SAMPLE}, {_DIRS}, k AS ({_rank_sql('asked', 'point_id, want_azimuth')}), picks AS (SELECT a.point_id, a.want_azimuth, a.px, a.py, k.* EXCLUDE (point_id, want_azimuth, px, py) FROM asked a LEFT JOIN k ON k.point_id = a.point_id AND k.want_azimuth = a.want_azimuth AND k.pick = 1)"

#: Each asked place with its outcome as flags of 0 or 1.
_GRADED = """graded AS (SELECT *, coalesce(az_ok, false)::INT AS toward, eligible::INT AS fine, (filename IS NULL)::INT AS missing, coalesce(NOT az_ok, false)::INT AS turned,
 coalesce(toward * (1 - fine), 0) AS poor, coalesce(toward * fine, 0) AS good FROM picks)"""


def _sample(spark, sf):
    return stored(spark, f"sample|{sf}", lambda: evaluate.sample_points(domain.frames(spark, sf)))


def _top(spark, sf):
    return stored(spark, f"picks|{sf}", lambda: evaluate.top_picks(_sample(spark, sf), domain.frames(spark, sf)))


@query("e1_sample_points", "frames", f"WITH {_SAMPLE} SELECT * FROM pts")
def e1(spark, sf):
    return _sample(spark, sf)


@query(
    "e2_top_picks",
    "fg",
    f"WITH {_TOP} SELECT point_id, want_azimuth, px, py, filename, {r('az_off')} AS az_off_deg, az_ok, eligible, {r('center_dist')} AS center_dist_ft FROM picks",
)
def e2(spark, sf):
    p = evaluate.top_picks(_sample(spark, sf), domain.frames(spark, sf))
    return p.select("point_id", "want_azimuth", "px", "py", "filename", R(F.col("az_off_deg")).alias("az_off_deg"), "az_ok", "eligible", R(F.col("center_dist_ft")).alias("center_dist_ft"))


@query(
    "e3_outcomes",
    "fg",
    f"""WITH {_TOP}, {_GRADED} SELECT want_azimuth AS look_az, sum(missing)::BIGINT AS no_frame, sum(turned)::BIGINT AS az_fallback, sum(poor)::BIGINT AS in_tolerance_but_ineligible,
 sum(good)::BIGINT AS good, round(100e0 * avg(good), 1) AS pct_good FROM graded GROUP BY want_azimuth""",
)
def e3(spark, sf):
    return evaluate.outcomes(_top(spark, sf))


@query(
    "e4_good_profile",
    "fg",
    f"""WITH {_TOP}, {_GRADED}, sorted AS (SELECT camera, list_sort(list(center_dist)) AS far, list_sort(list(gsd)) AS size, list_sort(list(az_off)) AS off, sum(is_reflight::INT)::BIGINT AS reflight_picks
 FROM graded WHERE good = 1 GROUP BY camera)
SELECT camera, len(off) AS n, round(list_avg(off), 2) AS mean_az_off, round(off[-1], 1) AS max_az_off, round({s.quantile('far', 0.5)}, 0) AS median_center_ft,
 round({s.quantile('size', 0.5)}, 3) AS median_gsd_ft, round({s.quantile('size', 0.95)}, 3) AS p95_gsd_ft, reflight_picks FROM sorted""",
)
def e4(spark, sf):
    return evaluate.good_profile(_top(spark, sf))


_NORTH = "asked AS (SELECT *, 0e0 AS want_azimuth FROM pts)"


@query(
    "e5_competition",
    "fg",
    f"""WITH {_SAMPLE}, {_NORTH}, held AS (SELECT point_id, list((az_ok AND eligible)::INT) AS fit FROM ({s.candidates('asked')}) GROUP BY point_id)
SELECT count(*) AS points, round(avg(len(fit)), 1) AS mean_candidates, max(len(fit)) AS max_candidates, round(avg(coalesce(list_sum(fit), 0)), 1) AS mean_in_tolerance_and_eligible,
 sum((coalesce(list_sum(fit), 0) = 0)::INT)::BIGINT AS points_with_none FROM held""",
)
def e5(spark, sf):
    return evaluate.competition(_sample(spark, sf), domain.frames(spark, sf))


@query(
    "e6_edge_sweep",
    "fg",
    f"""WITH {_SAMPLE}, {_NORTH}, tried AS (SELECT *, coalesce(edge_frac >= min_edge_frac AND gsd <= 0.40e0, false) AS fit FROM ({s.candidates('asked')}), (SELECT unnest([0e0, 0.05e0, 0.1e0, 0.2e0]) AS min_edge_frac)),
won AS (SELECT min_edge_frac, point_id, arg_min(coalesce(az_ok AND fit, false)::INT, {s.preference('fit')}) AS good FROM tried GROUP BY min_edge_frac, point_id)
SELECT min_edge_frac, round(100e0 * sum(good) / (SELECT count(*) FROM pts), 1) AS pct_good FROM won GROUP BY min_edge_frac""",
)
def e6(spark, sf):
    return evaluate.edge_sweep(_sample(spark, sf), domain.frames(spark, sf))


def _sets(spark, sf):
    return stored(spark, f"sets|{sf}", lambda: _review_sets(domain.frames(spark, sf)))


def _review_sets(f):
    return evaluate.review_random(f, 300, "7").unionByName(evaluate.review_reflight(f, 600, "7")).unionByName(evaluate.review_fallback(f, 3000, "7"))


_SETS = f"""r1 AS (SELECT 'random' AS category, filename AS point_id, (x0 + x2) / 2 AS px, (y0 + y2) / 2 AS py, [0e0, 90e0, 180e0, 270e0][1 + row_number() OVER (ORDER BY md5(filename || '7'), filename) % 4] AS want_azimuth
 FROM (SELECT * FROM frames WHERE camera = 'Color' ORDER BY md5(filename || '7'), filename LIMIT 300)),
r2p AS (SELECT filename AS point_id, (x0 + x2) / 2 AS px, (y0 + y2) / 2 AS py, 0e0 AS want_azimuth FROM frames WHERE camera = 'Color' AND is_reflight ORDER BY md5(filename || '7'), filename LIMIT 600),
r2k AS ({_rank_sql('r2p', 'point_id')}),
r2 AS (SELECT 'reflight' AS category, point_id, px, py, want_azimuth FROM r2k WHERE pick <= 20 GROUP BY ALL HAVING bool_or(pick = 1 AND is_reflight AND az_ok AND eligible) AND bool_or(NOT is_reflight AND az_ok AND eligible)),
r3p AS (SELECT * FROM (SELECT filename AS point_id, (x0 + x2) / 2 AS px, (y0 + y2) / 2 AS py FROM frames WHERE camera = 'Color' ORDER BY md5(filename || '7'), filename LIMIT 3000), (SELECT unnest([0e0, 90e0, 180e0, 270e0]) AS want_azimuth)),
r3k AS ({_rank_sql('r3p', 'point_id, want_azimuth')}),
r3 AS (SELECT 'fallback' AS category, point_id, px, py, want_azimuth FROM r3k WHERE pick = 1 AND NOT az_ok),
sets AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""


@query("e7_review_sets", "fg", f"WITH {_SETS} SELECT * FROM sets")
def e7(spark, sf):
    return _sets(spark, sf)


@query(
    "e8_review_payload",
    "fg",
    f"""WITH {_SETS}, k AS ({_rank_sql('sets', 'category, point_id, want_azimuth')}) SELECT s.category, s.point_id, s.want_azimuth, {r(s.lon_of('s.px', 's.py'), 8)} AS lon, {r(s.lat_of('s.px', 's.py'), 8)} AS lat,
 count(k.filename) AS n, string_agg(k.pick || ':' || k.filename || ':' || k.az_ok || ':' || k.cam_x::BIGINT, ',' ORDER BY k.pick) AS picks
FROM sets s LEFT JOIN k ON k.category = s.category AND k.point_id = s.point_id AND k.want_azimuth = s.want_azimuth AND k.pick <= 6 GROUP BY s.category, s.point_id, s.want_azimuth, s.px, s.py""",
)
def e8(spark, sf):
    p = evaluate.review_payload(_sets(spark, sf), domain.frames(spark, sf))
    text = F.transform("cands", lambda c: F.concat_ws(":", c["pick"].cast("string"), c["filename"], c["az_ok"].cast("string"), c["cam_x"].cast("long").cast("string")))
    return p.select(
        "category", "point_id", "want_azimuth", R(F.col("lon"), 8).alias("lon"), R(F.col("lat"), 8).alias("lat"),
        F.coalesce(F.size("cands"), F.lit(0)).cast("long").alias("n"), F.array_join(text, ",").alias("picks"),
    )


@query(
    "e9_outside_shown",
    "fg",
    f"""WITH {_SETS}, k AS ({_rank_sql('sets', 'category, point_id, want_azimuth')}), t AS (SELECT *, [{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x3, 'y': y3}}] AS ring FROM k WHERE pick <= 6)
SELECT category, count(*) FILTER (WHERE NOT {s.even_odd('ring', 'px', 'py')}) AS warned, count(*) AS shown FROM t GROUP BY category""",
)
def e9(spark, sf):
    payload = evaluate.review_payload(_sets(spark, sf), domain.frames(spark, sf))
    warned = evaluate.outside_shown(payload).groupBy("category").agg(F.count("*").alias("warned"))
    shown = payload.groupBy("category").agg(F.sum(F.size("cands")).alias("shown"))
    return shown.join(warned, "category", "left").select("category", F.coalesce("warned", F.lit(0)).alias("warned"), "shown")


_RULES = [
    "a frame covers the place", "looking down returns only the nadir camera", "a compass request returns only obliques", "pick 1 exists where a frame covers", "pick 1 is in tolerance when any is",
    "pick 1 is eligible when any in tolerance is", "degrees agree with the grid", "the first frame of a pass has no previous one", "neighbours are in shot order", "shots are distinct along a pass",
]


@query("e10_selection_rules", "", f"SELECT unnest({_RULES!r}) AS rule, 0::BIGINT AS n_bad FROM (SELECT count(*) AS c FROM orders HAVING count(*) > 0)")
def e10(spark, sf):
    return evaluate.selection_rules(_sample(spark, sf), domain.frames(spark, sf))


def _inner(n: int) -> str:
    """Interior points of obliques: the cut halfway up a trapezoid, middle of its two side crossings."""
    scan, _ = s.quad_interior("")
    cut = lambda a, b: f"CASE WHEN (y{a} <= scan) <> (y{b} <= scan) THEN x{a} + (x{b} - x{a}) * (scan - y{a}) / (y{b} - y{a}) END"
    xs = ", ".join(cut(a, b) for a, b in s.QUAD_EDGES)
    return f"SELECT * EXCLUDE (xs), (list_min(xs) + list_max(xs)) / 2 + 37.3e0 AS px, scan + 61.7e0 AS py FROM (SELECT *, list_filter([{xs}], lambda v: v IS NOT NULL) AS xs FROM (SELECT *, {scan} AS scan FROM frames WHERE camera IN ('Fwd', 'Left') ORDER BY md5(filename), filename LIMIT {n}))"


@query("e10_uncovered_places", "cand", "SELECT 'a frame covers the place' AS rule, count(*) AS n_bad FROM points WHERE point_id % 17 = 0 OR point_id NOT IN (SELECT point_id FROM cand)")
def e10_uncovered(spark, sf):
    points = domain.points(spark, sf).withColumn("px", F.col("px") + F.when(F.col("point_id") % 17 == 0, 5e6).otherwise(0.0))
    return evaluate.uncovered(points, select.candidates(points, domain.frames(spark, sf)))


_FORMS = f"""WITH pk AS (SELECT filename AS point_id, {s.lon_of('px', 'py')} AS lon, {s.lat_of('px', 'py')} AS lat, [0e0, 90e0, 180e0, 270e0][1 + (row_number() OVER (ORDER BY md5(filename), filename) - 1) % 4] AS want_azimuth FROM ({_inner(400)})),
a0 AS (SELECT *, {s.grid_x('lon', 'lat')} AS px, {s.grid_y('lon', 'lat')} AS py FROM pk), k AS ({_rank_sql('a0', 'point_id')}),
vw AS (SELECT point_id AS view_id, lon - 1e-6 AS west, lat - 1e-6 AS south, lon + 1e-6 AS east, lat + 1e-6 AS north, want_azimuth FROM pk), {_views_sql('vw')}
SELECT pk.point_id, pk.want_azimuth, k.filename AS by_point, shown.filename AS by_view FROM pk LEFT JOIN k ON k.point_id = pk.point_id AND k.pick = 1 AND k.az_ok LEFT JOIN shown ON shown.view_id = pk.point_id AND shown.place = 1"""


@query("e11_formulations", "fg", _FORMS)
def e11(spark, sf):
    f = domain.frames(spark, sf)
    chosen = stored(spark, f"hash|{sf}", lambda: evaluate.hash_chosen(f))
    # Off the middle line of the outlines, where two exposures would be equally far.
    return evaluate.formulations(chosen.withColumns({"px": F.col("px") + 37.3, "py": F.col("py") + 61.7}), f)


@query("e11_agreement", "fg", f"""SELECT 'the point form and the view form agree' AS rule, count(*) AS n_places, sum((by_point IS DISTINCT FROM by_view)::INT)::BIGINT AS n_apart,
 CASE WHEN sum((by_point IS DISTINCT FROM by_view)::INT) > 2 THEN sum((by_point IS DISTINCT FROM by_view)::INT) ELSE 0 END::BIGINT AS n_bad FROM ({_FORMS})""")  # fmt: skip
def e11_agreement(spark, sf):
    return evaluate.agreement(e11(spark, sf))
