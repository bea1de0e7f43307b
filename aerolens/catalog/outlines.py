"""Queries over outlines of any kind: many corners, holes, several parts, through WKB and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.registry import R, query, r
from aerolens.functions import shapes
from aerolens.operators import evaluate, expect, normalise, select
from aerolens.session import stored
from aerolens.sources import wkb

#: Shapes by kind, as parts of rings of corners along the first and last side of a frame's own outline.
_SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
KINDS = [
    [[_SQUARE]],
    [[[(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)]]],
    [[[(0.0, 0.25), (0.25, 0.0), (0.75, 0.0), (1.0, 0.25), (1.0, 0.75), (0.75, 1.0), (0.25, 1.0), (0.0, 0.75)]]],
    [[_SQUARE, [(0.25, 0.25), (0.75, 0.25), (0.75, 0.625), (0.25, 0.625)]]],
    [[[(0.0, 0.0), (0.375, 0.0), (0.375, 1.0), (0.0, 1.0)]], [[(0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 1.0)], [(0.625, 0.25), (0.625, 0.5), (0.875, 0.5), (0.875, 0.25)]]],
    [[[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.5, -0.25), (0.0, 1.0)]]],
]
_NUMBERS = "x0 y0 z0 x1 y1 z1 x2 y2 z2 x3 y3 z3 xmin ymin xmax ymax cen_x cen_y sqrt_area z_mid turning".split()


def _shape(kind):
    first, right, up = (lambda a: F.col(f"{a}0")), (lambda a: F.col(f"{a}1") - F.col(f"{a}0")), (lambda a: F.col(f"{a}3") - F.col(f"{a}0"))
    place = lambda u, v, a: first(a) + right(a) * F.lit(u) + up(a) * F.lit(v)
    ring = lambda c: F.array(*[F.struct(place(u, v, "x").alias("x"), place(u, v, "y").alias("y"), F.lit(500.0 + i % len(c)).alias("z")) for i, (u, v) in enumerate([*c, c[0]])])
    return F.array(*[F.array(*[ring(c) for c in part]) for part in kind])


def _coded(spark, sf):
    """Frames with their shapes as WKB: every 101st has an empty one, every 103rd none."""
    k, of = F.col("k"), F.col("k") % len(KINDS)
    shape = F.coalesce(*[F.when(of == n, _shape(kind)) for n, kind in enumerate(KINDS)])
    empty = F.array(F.array().cast(shapes_type()))
    shape = F.when(k % 103 != 0, F.when(k % 101 == 0, empty).otherwise(shape))
    frames = domain.frames(spark, sf)
    return frames.withColumn("footprint_wkb", wkb.shape_to_wkb(shape)).drop(*_NUMBERS)


def shapes_type() -> str:
    return "array<array<struct<x: double, y: double, z: double>>>"


def _shaped(spark, sf):
    return stored(spark, f"shaped|{sf}", lambda: select.with_outline_terms(wkb.with_outlines(_coded(spark, sf))))


_CORNERS = ", ".join(f"({n}, {p}, {g}, {i}, {len(c)}, {u}e0, {v}e0)" for n, kind in enumerate(KINDS) for p, part in enumerate(kind) for g, c in enumerate(part) for i, (u, v) in enumerate(c))
#: Corners, edges and sums over edges, a ring's sign being that of an outer ring or of a hole.
_SHAPES = f"""corner AS (SELECT f.filename, f.k, c.part, c.ring, c.i, c.n, f.x0 + (f.x1 - f.x0) * c.u + (f.x3 - f.x0) * c.v AS x, f.y0 + (f.y1 - f.y0) * c.u + (f.y3 - f.y0) * c.v AS y, 500e0 + c.i AS z
 FROM frames f JOIN (VALUES {_CORNERS}) AS c(kind, part, ring, i, n, u, v) ON c.kind = f.k % {len(KINDS)} WHERE f.k % 103 <> 0 AND f.k % 101 <> 0),
edge AS (SELECT a.*, b.x AS ex, b.y AS ey FROM corner a JOIN corner b ON b.filename = a.filename AND b.part = a.part AND b.ring = a.ring AND b.i = (a.i + 1) % a.n),
origin AS (SELECT filename, x AS ox, y AS oy FROM corner WHERE part = 0 AND ring = 0 AND i = 0),
sums AS (SELECT *, CASE WHEN ring = 0 THEN sign(a) ELSE -sign(a) END AS w FROM (SELECT filename, part, ring, sum((x - ox) * (ey - oy) - (ex - ox) * (y - oy)) AS a, sum((x + ex - 2 * ox) * ((x - ox) * (ey - oy) - (ex - ox) * (y - oy))) AS mx,
  sum((y + ey - 2 * oy) * ((x - ox) * (ey - oy) - (ex - ox) * (y - oy))) AS my FROM edge JOIN origin USING (filename) GROUP BY ALL)),
total AS (SELECT filename, sum(w * a) / 2 AS area, any_value(ox) + sum(w * mx) / nullif(3 * sum(w * a), 0) AS cen_x, any_value(oy) + sum(w * my) / nullif(3 * sum(w * a), 0) AS cen_y
 FROM sums JOIN origin USING (filename) GROUP BY filename),
bounds AS (SELECT filename, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, (min(z) + max(z)) / 2 AS z_mid, count(*) AS corners FROM corner GROUP BY filename)"""


@query("s7_g5_g6_shapes", "frames", f"""WITH {_SHAPES} SELECT filename, corners, {r('area', 3)} AS area, {r('cen_x', 4)} AS cen_x, {r('cen_y', 4)} AS cen_y, xmin, ymin, xmax, ymax, z_mid
FROM total JOIN bounds USING (filename)""")  # fmt: skip
def shapes_measured(spark, sf):
    f = _shaped(spark, sf).where(F.size("ring") > 0)
    corners = F.aggregate(F.flatten(shapes.of_frame(f.columns)), F.lit(0), lambda n, v: n + F.size(v) - 1).cast("long")
    area = R(F.col("sqrt_area") * F.col("sqrt_area"), 3).alias("area")
    return f.select("filename", corners.alias("corners"), area, R(F.col("cen_x"), 4).alias("cen_x"), R(F.col("cen_y"), 4).alias("cen_y"), "xmin", "ymin", "xmax", "ymax", "z_mid")


#: Places at sixteenths of a frame's own outline: in holes, in gaps between parts and near corners.
_PROBES = "probe AS (SELECT f.filename, p.p, f.x0 + (f.x1 - f.x0) * p.u + (f.x3 - f.x0) * p.v AS px, f.y0 + (f.y1 - f.y0) * p.u + (f.y3 - f.y0) * p.v AS py FROM frames f, (VALUES (0, 0.4375e0, 0.40625e0), (1, 0.6875e0, 0.8125e0), (2, 0.8125e0, 0.3125e0), (3, 0.0625e0, 0.3125e0)) AS p(p, u, v))"
_SPOTS = [(0.4375, 0.40625), (0.6875, 0.8125), (0.8125, 0.3125), (0.0625, 0.3125)]


@query("g3_g8_shapes", "frames", f"""WITH {_SHAPES}, {_PROBES} SELECT filename, p, count(*) FILTER ((y > py) <> (ey > py) AND px < (ex - x) * (py - y) / (ey - y) + x) % 2 = 1 AS hit,
 {r(f"min({s.seg_dist('x', 'y', 'ex', 'ey', 'px', 'py')})", 4)} AS edge FROM edge JOIN probe USING (filename) GROUP BY filename, p""")  # fmt: skip
def shapes_covering(spark, sf):
    place = lambda a, u, v: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * u + (F.col(f"{a}3") - F.col(f"{a}0")) * v
    spots = F.array(*[F.struct(F.lit(n).alias("p"), place("x", u, v).alias("px"), place("y", u, v).alias("py")) for n, (u, v) in enumerate(_SPOTS)])
    asked = domain.frames(spark, sf).select("filename", F.explode(spots).alias("s")).select("filename", "s.*")
    f = _shaped(spark, sf).where(F.size("ring") > 0)
    both = stored(spark, f"probes|{sf}", lambda: f.select("filename", shapes.of_frame(f.columns).alias("shape")).join(asked, "filename"))
    px, py = F.col("px"), F.col("py")
    return both.select("filename", "p", shapes.covers(F.col("shape"), px, py).alias("hit"), R(shapes.edge_distance(F.col("shape"), px, py), 4).alias("edge"))


#: Cuts of every part halfway between the corner heights around its middle; crossings of a cut in pairs.
_INNER = f"""{_SHAPES}, cut AS (SELECT filename, part, (max(y) FILTER (y <= mid) + min(y) FILTER (y > mid)) / 2 AS cut_y FROM (SELECT *, (min(y) OVER w + max(y) OVER w) / 2 AS mid FROM corner WINDOW w AS (PARTITION BY filename, part)) GROUP BY ALL),
crossing AS (SELECT filename, part, cut_y, x + (ex - x) * (cut_y - y) / (ey - y) AS hit, row_number() OVER (PARTITION BY filename, part ORDER BY x + (ex - x) * (cut_y - y) / (ey - y)) AS n FROM edge JOIN cut USING (filename, part) WHERE (y <= cut_y) <> (ey <= cut_y)),
stretch AS (SELECT filename, part, (n + 1) // 2 AS k, any_value(cut_y) AS py, min(hit) AS one, max(hit) AS two FROM crossing GROUP BY filename, part, (n + 1) // 2),
inner_point AS (SELECT filename, arg_min({{'px': (one + two) / 2, 'py': py}}, {{'w': one - two, 'part': part, 'k': k}}) AS p FROM stretch GROUP BY filename)"""


@query("g10_shape_interior", "frames", f"WITH {_INNER} SELECT filename, {r('p.px', 4)} AS px, {r('p.py', 4)} AS py FROM inner_point JOIN frames USING (filename) WHERE k % {len(KINDS)} <> 0")
def shapes_interior(spark, sf):
    f = _shaped(spark, sf).where((F.size("ring") > 0) & (F.col("k") % len(KINDS) != 0))
    return evaluate.interior_points(f).select("filename", R(F.col("px"), 4).alias("px"), R(F.col("py"), 4).alias("py"))


@query("e1_shaped_sample", "frames", f"""WITH {_INNER} SELECT filename AS point_id, {r('p.px', 4)} AS px, {r('p.py', 4)} AS py FROM (SELECT filename FROM frames WHERE camera = 'Color' AND k % 103 <> 0 AND k % 101 <> 0
 ORDER BY md5(filename || '42'), filename LIMIT 2000) JOIN inner_point USING (filename)""")  # fmt: skip
def shaped_sample(spark, sf):
    points = evaluate.sample_points(_shaped(spark, sf).where(F.size("ring") > 0))
    return points.select("point_id", R(F.col("px"), 4).alias("px"), R(F.col("py"), 4).alias("py"))


@query("q1_shaped_frames", "frames points", f"""WITH {_SHAPES}, near AS (SELECT p.point_id, p.px, p.py, b.filename FROM points p JOIN bounds b ON p.px BETWEEN b.xmin AND b.xmax AND p.py BETWEEN b.ymin AND b.ymax
  JOIN frames f ON f.filename = b.filename AND (f.camera = 'Color') = (p.want_azimuth IS NULL)),
held AS (SELECT point_id, filename, any_value(px) AS px, any_value(py) AS py, min({s.seg_dist('x', 'y', 'ex', 'ey', 'px', 'py')}) AS reach FROM near JOIN edge USING (filename) GROUP BY point_id, filename
 HAVING count(*) FILTER ((y > py) <> (ey > py) AND px < (ex - x) * (py - y) / (ey - y) + x) % 2 = 1 OR min({s.seg_dist('x', 'y', 'ex', 'ey', 'px', 'py')}) = 0)
SELECT point_id, filename, {r('list_distance([px, py], [cen_x, cen_y])', 3)} AS center_dist_ft, {r('reach / sqrt(area)', 5)} AS edge_frac FROM held JOIN total USING (filename) WHERE area > 0""")  # fmt: skip
def shaped_frames(spark, sf):
    c = select.candidates(domain.points(spark, sf), _shaped(spark, sf).where(F.col("sqrt_area") > 0))
    return c.select("point_id", "filename", R(F.col("center_dist_ft"), 3).alias("center_dist_ft"), R(F.col("edge_frac"), 5).alias("edge_frac"))


#: Edges of one outline that share no corner and properly cross, met edge by edge.
_CUT = f"""{_SHAPES}, cut AS (SELECT DISTINCT p.filename FROM edge p JOIN edge q ON q.filename = p.filename AND (q.part, q.ring, q.i) > (p.part, p.ring, p.i)
 WHERE NOT (p.part = q.part AND p.ring = q.ring AND (q.i - p.i) IN (1, p.n - 1))
 AND sign((p.ex - p.x) * (q.y - p.y) - (p.ey - p.y) * (q.x - p.x)) * sign((p.ex - p.x) * (q.ey - p.y) - (p.ey - p.y) * (q.ex - p.x)) < 0
 AND sign((q.ex - q.x) * (p.y - q.y) - (q.ey - q.y) * (p.x - q.x)) * sign((q.ex - q.x) * (p.ey - q.y) - (q.ey - q.y) * (p.ex - q.x)) < 0)"""


@query("n14_shape_health", "frames", f"""WITH {_CUT} SELECT 'frame without a footprint' AS rule, count(*) FILTER (k % 103 = 0) AS n_bad FROM frames UNION ALL SELECT 'empty footprint', count(*) FILTER (k % 101 = 0 AND k % 103 <> 0) FROM frames
UNION ALL SELECT 'invalid footprint', (SELECT count(*) FROM cut) + (SELECT count(*) FROM total WHERE area <= 0 AND filename NOT IN (SELECT filename FROM cut)) UNION ALL SELECT 'footprint in another reference system', 0 FROM (SELECT count(*) FROM frames)""")  # fmt: skip
def shape_health(spark, sf):
    return expect.outline_rules(_shaped(spark, sf))


@query("g13_shape_crossings", "frames", f"WITH {_CUT} SELECT filename FROM cut")
def shape_crossings(spark, sf):
    f = _shaped(spark, sf)
    return expect.crossing_shapes(f.where(F.size("ring") > 0), "filename", shapes.of_frame(f.columns))


@query("t14_shape_boxes", "frames", f"WITH {_SHAPES} SELECT filename, xmin, ymin, xmax, ymax FROM frames LEFT JOIN bounds USING (filename)")
def shape_boxes(spark, sf):
    rows = _shaped(spark, sf).drop("xmin", "ymin", "xmax", "ymax").withColumns({c: F.lit(None) for c in ("eo_ts", "tz_offset_h", "dup_rank", "fid")})
    return normalise.normalised(rows.drop("pass_id", "shot_prefix", "is_reflight", "track_heading_deg", "look_azimuth_deg", "kappa_err_deg", "kappa_flag")).select("filename", "xmin", "ymin", "xmax", "ymax")
