"""Queries over point clouds (C) and image levels (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.catalog import domain, domain_sql as s
from aerolens.catalog.registry import R, query, r
from aerolens.functions import rings
from aerolens.operators import imagery, pointcloud
from aerolens.session import stored


def _areas(spark, sf):
    """Areas within the size limit, on the grid."""
    return stored(spark, f"areas|{sf}", lambda: pointcloud.grid_areas(pointcloud.within_limit(domain.areas(spark, sf)).select("area_id", "ring")))


_GRID = f"ga AS (SELECT *, list_transform(ring, lambda c: {{'x': {s.grid_x('c.lon', 'c.lat')}, 'y': {s.grid_y('c.lon', 'c.lat')}}}) AS grid FROM areas), gs AS (SELECT *, {s.ring_area('grid')} / (5280e0 * 5280e0) AS sq_mi FROM ga)"
_LIM = f"""{_GRID}, lim AS (SELECT *, sqrt(4 / sq_mi) AS f, list_avg(list_transform(grid, lambda p: p.x)) AS mx, list_avg(list_transform(grid, lambda p: p.y)) AS my FROM gs),
 la AS (SELECT area_id, sq_mi, CASE WHEN sq_mi > 4 THEN list_transform(grid, lambda p: {{'x': mx + (p.x - mx) * f, 'y': my + (p.y - my) * f}}) ELSE grid END AS grid FROM lim),
 ab AS (SELECT *, list_min(list_transform(grid, lambda p: p.x)) AS ax0, list_min(list_transform(grid, lambda p: p.y)) AS ay0, list_max(list_transform(grid, lambda p: p.x)) AS ax1, list_max(list_transform(grid, lambda p: p.y)) AS ay1 FROM la)"""


@query("c1_c2_areas", "areas", f"WITH {_LIM} SELECT area_id, {r('sq_mi', 7)} AS sq_mi, sq_mi > 4 AS limited, {r(s.lon_of('grid[3].x', 'grid[3].y'), 7)} AS lon3, {r(s.lat_of('grid[3].x', 'grid[3].y'), 7)} AS lat3, {r('ax0', 3)} AS ax0, {r('ay1', 3)} AS ay1 FROM ab")
def c1(spark, sf):
    raw = stored(spark, f"raw_areas|{sf}", lambda: domain.areas(spark, sf))
    size = pointcloud.grid_areas(raw).select("area_id", R(F.col("sq_mi"), 7).alias("sq_mi"))
    lim = pointcloud.within_limit(raw).select("area_id", "limited", R(F.col("ring")[2]["lon"], 7).alias("lon3"), R(F.col("ring")[2]["lat"], 7).alias("lat3"))
    box = _areas(spark, sf).select("area_id", R(F.col("ax0"), 3).alias("ax0"), R(F.col("ay1"), 3).alias("ay1"))
    return size.join(lim, "area_id").join(box, "area_id")


@query("c3_area_geojson", "areas", """SELECT area_id, len(ring) + 1 AS n, round(ring[1].lon, 9) AS first_lon, round(ring[1].lat, 9) AS last_lat FROM areas""")
def c3(spark, sf):
    a = domain.areas(spark, sf).select("area_id", pointcloud.area_geojson(F.col("ring")).alias("j"))
    back = F.from_json("j", "type string, coordinates array<array<array<double>>>")
    a = a.withColumn("g", back["coordinates"][0])
    return a.select("area_id", F.size("g").alias("n"), F.round(F.col("g")[0][0], 9).alias("first_lon"), F.round(F.element_at("g", -1)[1], 9).alias("last_lat"))


_SAMP = f"sm AS (SELECT area_id, i, j, sx, sy FROM (SELECT *, ax0 + (i + 0.5e0) / 24 * (ax1 - ax0) AS sx, ay0 + (j + 0.5e0) / 24 * (ay1 - ay0) AS sy FROM ab, unnest(range(0, 24)) a(i), unnest(range(0, 24)) b(j)) WHERE {s.even_odd('grid', 'sx', 'sy')})"


@query("c4_area_samples", "areas", f"WITH {_LIM}, {_SAMP} SELECT area_id, i, j, {r('sx', 3)} AS sx, {r('sy', 3)} AS sy FROM sm")
def c4(spark, sf):
    out = pointcloud.area_samples(_areas(spark, sf))
    return out.select("area_id", "i", "j", R(F.col("sx"), 3).alias("sx"), R(F.col("sy"), 3).alias("sy"))


def _tiles(spark, sf):
    """Tiles of two phases: the newer one was not flown everywhere."""
    f = domain.cloud(spark, sf).select("file").distinct().withColumn("phase", F.explode(F.array(F.lit(2), F.lit(3)))).where("phase = 2 OR file % 3 <> 0")
    x, y = (4905000 + (F.col("file") % 5) * 5000).cast("double"), (3950000 + domain.idiv(F.col("file"), 5) * 5000).cast("double")
    return f.select(F.col("file").alias("tile_id"), "phase", x.alias("xmin"), y.alias("ymin"), (x + 5000).alias("xmax"), (y + 5000).alias("ymax"))


_SEGX = "(sign((b.x - a.x) * ({cy} - a.y) - (b.y - a.y) * ({cx} - a.x)) <> sign((b.x - a.x) * ({dy} - a.y) - (b.y - a.y) * ({dx} - a.x)) AND sign(({dx} - {cx}) * (a.y - {cy}) - ({dy} - {cy}) * (a.x - {cx})) <> sign(({dx} - {cx}) * (b.y - {cy}) - ({dy} - {cy}) * (b.x - {cx})))"


def _touch(ring: str, box: tuple[str, str, str, str]) -> str:
    x0, y0, x1, y1 = box
    q = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    cross = " OR ".join(_SEGX.format(cx=c[0], cy=c[1], dx=d[0], dy=d[1]) for c, d in zip(q, q[1:] + q[:1]))
    body = cross.replace("a.", "q[1].").replace("b.", "q[2].")
    return (f"(len(list_filter({ring}, lambda p: p.x BETWEEN {x0} AND {x1} AND p.y BETWEEN {y0} AND {y1})) > 0 OR " + " OR ".join(s.even_odd(ring, *c) for c in q)
            + f" OR len(list_filter(list_zip({ring}, {ring}[2:] || {ring}[:1]), lambda q: {body})) > 0)")


_TILES = "tl AS (SELECT file AS tile_id, phase, 4905000e0 + (file % 5) * 5000 AS xmin, 3950000e0 + (file // 5) * 5000 AS ymin, xmin + 5000 AS xmax, ymin + 5000 AS ymax FROM (SELECT DISTINCT file FROM cloud), (SELECT unnest([2, 3]) AS phase) WHERE phase = 2 OR file % 3 <> 0)"
_NODE_BOX = ("n.xmin", "n.ymin", "n.xmax", "n.ymax")
_CHOSEN = f"""{_LIM}, {_SAMP}, {_TILES}, tt AS (SELECT a.area_id, n.* FROM ab a, tl n WHERE {_touch('a.grid', _NODE_BOX)}), ht AS (SELECT sm.area_id, sm.i, sm.j, tt.tile_id, tt.phase FROM sm JOIN tt ON tt.area_id = sm.area_id AND sx BETWEEN xmin AND xmax AND sy BETWEEN ymin AND ymax),
 ch AS (SELECT area_id, tile_id, phase FROM tt WHERE phase = 3 UNION ALL SELECT DISTINCT area_id, tile_id, phase FROM ht WHERE phase = 2 AND (area_id, i, j) NOT IN (SELECT (area_id, i, j) FROM ht WHERE phase = 3))"""


@query("c5_tiles_for_areas", "areas cloud", f"WITH {_CHOSEN} SELECT area_id, tile_id, phase, count(*) OVER (PARTITION BY area_id) > 24 AS refused FROM ch")
def c5(spark, sf):
    return pointcloud.tiles_for_areas(_tiles(spark, sf), _areas(spark, sf))


@query("c6_node_boxes", "nodes", "SELECT file, key, xmin, ymin, xmax, ymax, spacing_ft FROM nodes")
def c6(spark, sf):
    return pointcloud.with_node_boxes(domain.nodes(spark, sf)).select("file", "key", "xmin", "ymin", "xmax", "ymax", "spacing_ft")


def _nodes(spark, sf):
    return stored(spark, f"nodes|{sf}", lambda: pointcloud.with_node_boxes(domain.nodes(spark, sf)))


def _over(spark, sf):
    return stored(spark, f"over|{sf}", lambda: pointcloud.nodes_over_areas(_nodes(spark, sf), _areas(spark, sf)))


_OVER = f"""nv AS (SELECT a.area_id, n.*, greatest(0, least(n.xmax, a.ax1) - greatest(n.xmin, a.ax0)) * greatest(0, least(n.ymax, a.ay1) - greatest(n.ymin, a.ay0)) / (side * side) AS share FROM ab a JOIN nodes n ON n.xmin <= a.ax1 AND n.xmax >= a.ax0 AND n.ymin <= a.ay1 AND n.ymax >= a.ay0 AND {_touch('a.grid', _NODE_BOX)})"""


@query("c7_nodes_over_areas", "areas nodes", f"WITH {_LIM}, {_OVER} SELECT area_id, file, key, depth, count, {r('share')} AS share FROM nv")
def c7(spark, sf):
    out = pointcloud.nodes_over_areas(_nodes(spark, sf), _areas(spark, sf))
    return out.select("area_id", "file", "key", "depth", "count", R(F.col("share")).alias("share"))


_PLAN = f"""{_LIM}, {_OVER}, lv AS (SELECT area_id, d AS depth, coalesce(sum(count * share), 0) AS p, coalesce(sum(length), 0) AS b FROM (SELECT DISTINCT area_id FROM nv) CROSS JOIN (SELECT unnest([0, 1, 2]) AS d) LEFT JOIN nv USING (area_id) WHERE nv.depth = d OR nv.depth IS NULL GROUP BY ALL),
 cu AS (SELECT *, sum(p) OVER w AS pp, sum(b) OVER w AS bb FROM lv WINDOW w AS (PARTITION BY area_id ORDER BY depth)),
 dp AS (SELECT area_id, (SELECT max(depth) FROM nv WHERE nv.area_id = cu.area_id) AS deepest, coalesce(min(depth) FILTER (WHERE depth > 0 AND (pp > 900 OR bb > 6000)) - 1, (SELECT max(depth) FROM nv WHERE nv.area_id = cu.area_id)) AS chosen, coalesce(bool_or(depth = 0 AND (pp > 900 OR bb > 6000)), false) AS "over" FROM cu GROUP BY area_id),
 pl AS (SELECT dp.area_id, chosen, deepest, "over", floor(coalesce(sum(p) FILTER (WHERE depth <= chosen), 0) + 0.5e0)::BIGINT AS points, coalesce(sum(b) FILTER (WHERE depth <= chosen), 0)::BIGINT AS bytes FROM dp JOIN lv USING (area_id) GROUP BY ALL)"""


def _plan(spark, sf):
    return pointcloud.depth_under_budget(_over(spark, sf), 900, 6000)


@query("c8_depth_under_budget", "areas nodes", f'WITH {_PLAN} SELECT area_id, chosen, deepest, "over", points, bytes FROM pl')
def c8(spark, sf):
    return _plan(spark, sf)


@query("c8_selected_nodes", "areas nodes", f"WITH {_PLAN} SELECT area_id, file, key, depth FROM nv JOIN pl USING (area_id) WHERE depth <= chosen")
def c8n(spark, sf):
    return pointcloud.selected_nodes(_over(spark, sf), _plan(spark, sf)).select("area_id", "file", "key", "depth")


def _screen(spark, sf):
    """Each area seen on a screen of 1000 by 700: its own scale, its middle a little off the screen's."""
    over = _over(spark, sf).join(_areas(spark, sf).select("area_id", "ax0", "ay0", "ax1", "ay1"), "area_id").withColumnRenamed("area_id", "view_id")
    k = (F.col("view_id") % 5 + 2) * 0.02
    cols = {"pa": k, "pb": F.lit(0.0), "pc": 480 - k * (F.col("ax0") + F.col("ax1")) / 2, "qa": F.lit(0.0), "qb": -k, "qc": 330 + k * (F.col("ay0") + F.col("ay1")) / 2, "pg": F.lit(0.0), "sw": F.lit(1000.0), "sh": F.lit(700.0)}
    return pointcloud.placed_on_screen(over.withColumns(cols))


_SCR = f"""{_LIM}, {_OVER}, sc AS (SELECT nv.*, nv.area_id AS view_id, kk, kk * side AS px, 480 + kk * (xmin - (ax0 + ax1) / 2) AS x0, 330 - kk * (ymax - (ay0 + ay1) / 2) AS y0 FROM (SELECT nv.*, (nv.area_id % 5 + 2) * 0.02e0 AS kk, ax0, ax1, ay0, ay1 FROM nv JOIN ab USING (area_id)) nv),
 pc AS (SELECT *, x0 + px / 2 AS mx, y0 + px / 2 AS my, x0 < 1150 AND x0 + px > -150 AND y0 < 805 AND y0 + px > -105 AS vis, 2 * px * (spacing_ft / side) > 3 AS fine FROM sc)"""


@query("c9_c10_placed", "areas nodes", f"WITH {_SCR} SELECT view_id, file, key, {r('px', 4)} AS side, {r('mx', 3)} AS centre_x, {r('my', 3)} AS centre_y, vis AS on_screen, fine FROM pc")
def c9(spark, sf):
    return _screen(spark, sf).select("view_id", "file", "key", R(F.col("side"), 4).alias("side"), R(F.col("centre_x"), 3).alias("centre_x"), R(F.col("centre_y"), 3).alias("centre_y"), "on_screen", pointcloud.fine_enough().alias("fine"))


_VIEWED = f"""{_SCR}, od AS (SELECT *, row_number() OVER w AS n, sum(count * share) OVER w AS pp, sum(length) OVER w AS bb FROM (SELECT *, sqrt((mx - 500)^2 + (my - 350)^2) AS dist FROM pc WHERE vis AND fine AND NOT (file % 5 = 2 AND depth = 0))
  WINDOW w AS (PARTITION BY view_id ORDER BY depth, dist, file, key ROWS UNBOUNDED PRECEDING))"""


@query("c11_nodes_for_view", "areas nodes", f"WITH {_VIEWED} SELECT view_id, n AS place, file, key, depth, {r('pp', 4)} AS points_upto FROM od WHERE n = 1 OR (pp <= 700 AND bb <= 5000)")
def c11(spark, sf):
    placed = _screen(spark, sf)
    read = placed.where("file % 5 = 2 AND depth = 0").select("view_id", "file", "key")
    out = pointcloud.nodes_for_views(placed, read, 700, 5000)
    return out.select("view_id", "place", "file", "key", "depth", R(F.col("points_upto"), 4).alias("points_upto"))


_CLIP = f"cl AS (SELECT a.area_id, c.* FROM cloud c JOIN ab a ON c.x BETWEEN a.ax0 AND a.ax1 AND c.y BETWEEN a.ay0 AND a.ay1 AND {s.even_odd('a.grid', 'c.x', 'c.y')})"


def _chunks(spark, sf):
    """Points and height range of each node under each area."""
    return stored(spark, f"chunks|{sf}", lambda: pointcloud.clipped_chunks(domain.cloud(spark, sf).select("file", "key", "x", "y", "z"), _areas(spark, sf)))


@query("c12_clipped_chunks", "areas cloud", f"WITH {_LIM}, {_CLIP} SELECT area_id, file, key, count(*) AS count, min(z) AS z_min, max(z) AS z_max FROM cl GROUP BY ALL")
def c12(spark, sf):
    return _chunks(spark, sf)


@query("c13_height_ranges", "cloud", """WITH o AS (SELECT file, list_sort(list(z)) AS v FROM cloud GROUP BY file) SELECT file, v[1 + floor(0.02e0 * (len(v) - 1))::INT] AS lo,
 CASE WHEN v[1 + floor(0.98e0 * (len(v) - 1))::INT] > v[1 + floor(0.02e0 * (len(v) - 1))::INT] THEN v[1 + floor(0.98e0 * (len(v) - 1))::INT] ELSE v[1 + floor(0.02e0 * (len(v) - 1))::INT] + 1 END AS hi FROM o""")  # fmt: skip
def c13(spark, sf):
    return pointcloud.height_ranges(domain.cloud(spark, sf), ["file"])


@query("c14_stride_sample", "", "SELECT l_orderkey % 25 AS file, count(*) AS n, sum(i)::BIGINT AS s FROM (SELECT l_orderkey, (l_orderkey * 7 + l_linenumber) % 5000 AS i, 400 + l_orderkey % 25 * 90 AS c FROM lineitem) WHERE i % greatest(1, c // 400) = 0 GROUP BY 1")
def c14(spark, sf):
    k = F.col("l_orderkey")
    numbered = domain.table(spark, sf, "lineitem").select((k % 25).alias("file"), ((k * 7 + F.col("l_linenumber")) % 5000).alias("index"), (400 + (k % 25) * 90).alias("count"))
    return pointcloud.stride_sample(numbered).groupBy("file").agg(F.count("*").alias("n"), F.sum("index").alias("s"))


@query("c15_ramp", "", """WITH t AS (SELECT o_orderkey AS k, least(greatest((o_orderkey * 37 % 1301 - 150) / 1000e0, 0), 1) * 4 AS x FROM orders), u AS (SELECT *, least(floor(x), 3)::INT AS i FROM t)
SELECT k, """ + ", ".join(f"round([{a}][i + 1] + ([{a}][i + 2] - [{a}][i + 1]) * (x - i), 6) AS {n}" for n, a in (("red", "68, 59, 33, 94, 253"), ("green", "1, 82, 145, 201, 231"), ("blue", "84, 139, 140, 98, 37"))) + " FROM u")  # fmt: skip
def c15(spark, sf):
    k = F.col("o_orderkey")
    red, green, blue = pointcloud.ramp_colour(((k * 37) % 1301 - 150) / 1000.0)
    return domain.table(spark, sf, "orders").select(k.alias("k"), R(red).alias("red"), R(green).alias("green"), R(blue).alias("blue"))


@query("c16_evictions", "areas nodes", f"""WITH {_SCR}, fr AS (SELECT view_id, file || '/' || key AS block, count, sqrt((mx - 500)^2 + (my - 350)^2) AS d FROM pc WHERE NOT vis AND depth > 0),
 o AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY view_id ORDER BY d DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(count) OVER (PARTITION BY view_id) AS tot FROM fr)
SELECT view_id, block, tot >= view_id % 40 AS feasible FROM o WHERE bf < view_id % 40""")  # fmt: skip
def c16(spark, sf):
    held = _screen(spark, sf).select("view_id", F.concat_ws("/", "file", "key").alias("block"), "count", pointcloud.from_middle().alias("distance"), "on_screen", (F.col("depth") == 0).alias("keep"))
    need = domain.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("view_id"), (F.col("s_suppkey") % 40).alias("need"))
    return pointcloud.evictions(held, need)


@query("c17_room", "", "SELECT o_orderkey AS k, least(12000000 - o_orderkey * 997 % 13000000, 4000000) AS budget, 12000000 - o_orderkey * 997 % 13000000 >= 50000 AS room FROM orders")
def c17(spark, sf):
    k = F.col("o_orderkey")
    budget, room = pointcloud.room_budget((k * 997) % 13000000)
    return domain.table(spark, sf, "orders").select(k.alias("k"), budget.cast("long").alias("budget"), room.alias("room"))


@query("c18_load_summary", "areas nodes", f"""WITH {_PLAN.replace(_LIM, _CHOSEN)}, {_CLIP} SELECT pl.area_id, (SELECT count(*) FROM ch WHERE ch.area_id = pl.area_id AND phase = 3) AS phase3, (SELECT count(*) FROM ch WHERE ch.area_id = pl.area_id AND phase = 2) AS phase2,
 chosen AS depth, deepest, (SELECT count(*) FROM cl WHERE cl.area_id = pl.area_id) AS loaded, bytes, "over" FROM pl""")  # fmt: skip
def c18(spark, sf):
    return pointcloud.load_summary(_plan(spark, sf), pointcloud.tiles_for_areas(_tiles(spark, sf), _areas(spark, sf)), _chunks(spark, sf))


def _levels(spark, sf):
    """Made where they are read, so that a query without need of the long tile lists never makes them, and none writes them."""
    return domain.levels(spark, sf)


_SPAN = "sp AS (SELECT *, list_min(offsets) AS start, list_max(list_transform(list_zip(offsets, byte_counts), lambda q: q[1] + q[2])) AS stop FROM levels)"


@query("i1_tile_range", "levels", f'WITH {_SPAN} SELECT photo, level, start, stop AS "end" FROM sp')
def i1(spark, sf):
    return imagery.with_span(_levels(spark, sf)).select("photo", "level", "start", "end")


@query("i2_pick_level", "levels", f"""WITH {_SPAN}, k AS (SELECT *, stop - start <= 3000000 AS ok, width >= least(900, 500 * (width / height)) * 2 AS enough FROM sp)
SELECT photo, coalesce(arg_min(level, width) FILTER (WHERE ok AND enough), arg_max(level, width) FILTER (WHERE ok), arg_min(level, width)) AS level FROM k GROUP BY photo""")  # fmt: skip
def i2(spark, sf):
    return imagery.picked_level(_levels(spark, sf), 900, 500, 2, 3000000)


@query("i2_level_by_long_side", "levels", f"""WITH {_SPAN}, k AS (SELECT *, greatest(width, height) AS side FROM sp WHERE stop - start <= 12000000)
SELECT photo, coalesce(arg_min(level, side) FILTER (WHERE side >= 1200), arg_max(level, side)) AS level FROM k GROUP BY photo""")  # fmt: skip
def i2b(spark, sf):
    return imagery.level_by_long_side(_levels(spark, sf))


_REGIONS = "rg AS (SELECT p_partkey AS photo, (p_partkey * 37 % 9000 - 200)::DOUBLE AS x0, (p_partkey * 53 % 7000 - 100)::DOUBLE AS y0, x0 + 300 + p_partkey * 11 % 6000 AS x1, y0 + 200 + p_partkey * 13 % 5000 AS y1, 0.02e0 + (p_partkey % 50) / 50e0 AS need FROM part)"
_REGION_PLAN = f"""{_REGIONS}, fl AS (SELECT photo, max(width) AS fw, max(height) AS fh FROM levels GROUP BY photo), c AS (SELECT rg.photo, need, fw, fh, greatest(0, x0) AS a0, greatest(0, y0) AS b0, least(fw, x1) AS a1, least(fh, y1) AS b1 FROM rg JOIN fl USING (photo)),
 d AS (SELECT c.*, level, width, height, width / fw AS sx, height / fh AS sy, ceil(width / 512e0) AS across, ceil(height / 512e0) AS down FROM c JOIN levels USING (photo) WHERE a1 > a0 AND b1 > b0),
 e AS (SELECT *, least(across - 1, floor(a0 * sx / 512)) AS col0, least(down - 1, floor(b0 * sy / 512)) AS row0 FROM d), f AS (SELECT *, least(across - 1, greatest(col0, ceil(a1 * sx / 512) - 1)) AS col1, least(down - 1, greatest(row0, ceil(b1 * sy / 512) - 1)) AS row1 FROM e),
 g AS (SELECT *, least((col1 + 1) * 512, width) - col0 * 512 AS rw, least((row1 + 1) * 512, height) - row0 * 512 AS rh, (col1 - col0 + 1) * (row1 - row0 + 1) AS tiles, coalesce(min(width) FILTER (WHERE sx >= need * 0.9e0) OVER (PARTITION BY photo), fw) AS start, min(width) OVER (PARTITION BY photo) AS small FROM f),
 pl AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY width DESC) AS n FROM g WHERE width <= start AND ((tiles <= 30 AND rw <= 4096 AND rh <= 4096) OR width = small))"""


def _region_plans(spark, sf):
    k = F.col("p_partkey")
    rg = domain.table(spark, sf, "part").select(k.alias("photo"), ((k * 37) % 9000 - 200).cast("double").alias("x0"), ((k * 53) % 7000 - 100).cast("double").alias("y0"), (0.02 + (k % 50) / 50.0).alias("need"))
    rg = rg.withColumns({"x1": F.col("x0") + 300 + (F.col("photo") * 11) % 6000, "y1": F.col("y0") + 200 + (F.col("photo") * 13) % 5000})
    return imagery.planned_regions(rg, _levels(spark, sf))


@query("i3_region_plan", "levels", f"WITH {_REGION_PLAN} SELECT photo, level, tiles::BIGINT AS tiles, (col0 * 512)::BIGINT AS rect_x, (row0 * 512)::BIGINT AS rect_y, rw::BIGINT AS rect_w, rh::BIGINT AS rect_h FROM pl WHERE n = 1")
def i3(spark, sf):
    return _region_plans(spark, sf).select("photo", "level", "tiles", "rect_x", "rect_y", "rect_w", "rect_h")


@query("i4_plan_tiles", "levels", f"WITH {_REGION_PLAN} SELECT photo, level, c AS col, w AS row, (w * across + c)::BIGINT AS index FROM (SELECT * FROM pl WHERE n = 1), unnest(range(col0::BIGINT, col1::BIGINT + 1)) a(c), unnest(range(row0::BIGINT, row1::BIGINT + 1)) b(w)")
def i4(spark, sf):
    return imagery.plan_tiles(_region_plans(spark, sf), ["photo"])


@query("i5_byte_chunks", "levels", f'WITH {_SPAN} SELECT photo, level, c AS start, least(c + 262144, stop) AS "end" FROM sp, unnest(range(start, stop, 262144)) u(c)')
def i5(spark, sf):
    return imagery.byte_chunks(imagery.with_span(_levels(spark, sf)), 262144, ["photo", "level"])


@query("i6_tile_shares", "", "SELECT l_orderkey AS view_id, greatest(6, 40 // count(*)) AS per_frame FROM lineitem GROUP BY 1")
def i6(spark, sf):
    return imagery.tile_shares(domain.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("view_id")), ["view_id"])


@query("i7_shared_boxes", "views", "SELECT DISTINCT round(floor(west / 0.002e0) * 0.002e0, 6) AS west, round(floor(south / 0.002e0) * 0.002e0, 6) AS south, round(ceil(east / 0.002e0) * 0.002e0, 6) AS east, round(ceil(north / 0.002e0) * 0.002e0, 6) AS north FROM views")
def i7(spark, sf):
    return imagery.shared_boxes(domain.views(spark, sf)).select(*[R(F.col(c)).alias(c) for c in ("west", "south", "east", "north")]).distinct()


@query("i8_fit_inside", "levels", "SELECT photo, level, greatest(1, floor(width * least(1, 120e0 / width, 90e0 / height) + 0.5e0))::BIGINT AS w, greatest(1, floor(height * least(1, 120e0 / width, 90e0 / height) + 0.5e0))::BIGINT AS h FROM levels")
def i8(spark, sf):
    w, h = imagery.fit_inside(F.col("width"), F.col("height"), F.lit(120.0), F.lit(90.0))
    return _levels(spark, sf).select("photo", "level", w.cast("long").alias("w"), h.cast("long").alias("h"))
