"""The forms made for large tables give the answers of the plain ones, with every splitting rule forced on."""

import numpy as np
from pyspark.sql import Window, functions as F

from aerolens.catalog import domain, load
from aerolens.functions import quads
from aerolens.operators import select, skew
from aerolens.operators.gridjoin import boxes_meet, points_in_shapes, points_in_single_shapes

QUERIES = load()[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grid_join_equals_brute_force_with_hot_cells_split(spark, sf):
    pts = domain.points(spark, sf).select("point_id", "px", "py")
    hot = spark.range(600).select((F.col("id") + 10**6).alias("point_id"), F.lit(4908123.0).alias("px"), (F.col("id") % 7 + 3960011.0).alias("py"))
    pts = pts.unionByName(hot)
    f = domain.frames(spark, sf).select("filename", *[f"{a}{n}" for n in range(4) for a in "xy"], "xmin", "ymin", "xmax", "ymax")
    inside = quads.covers(quads.corners(), F.col("px"), F.col("py"))
    brute = pts.join(f, inside).select("point_id", "filename")
    for split, floor in ((False, 1), (True, 5)):
        got = points_in_shapes(pts, f, ["point_id"], ["filename"], inside, split=split, floor=floor).select("point_id", "filename")
        assert rows(got) == rows(brute)


def test_levels_find_small_and_huge_shapes_once(spark):
    pts = spark.range(300).select("id", (F.col("id") * 977.0).alias("px"), (F.col("id") * 1313.0 % 90000).alias("py"))
    shapes = spark.range(40).select(
        F.col("id").alias("s"), (F.col("id") * 3000.0).alias("xmin"), (F.col("id") * 1500.0).alias("ymin"),
        (F.col("id") * 3000.0 + F.pow(F.lit(2.0), F.col("id") % 17)).alias("xmax"), (F.col("id") * 1500.0 + 50000).alias("ymax"),
    )
    inbox = F.col("px").between(F.col("xmin"), F.col("xmax")) & F.col("py").between(F.col("ymin"), F.col("ymax"))
    got = points_in_shapes(pts, shapes, ["id"], ["s"], F.lit(True), cell=500.0, levels=(0, 2, 4, 6)).select("id", "s")
    assert rows(got) == rows(pts.join(shapes, inbox).select("id", "s"))


def test_single_shapes_meet_copied_points_once(spark):
    pts = spark.range(300).select("id", (F.col("id") * 500.0 - 20000).alias("px"), (F.col("id") * 1313.0 % 90000 - 30000).alias("py"))
    shapes = spark.range(60).select(
        F.col("id").alias("s"), (F.col("id") * 3000.0 - 40000).alias("xmin"), (F.col("id") * 1500.0 - 50000).alias("ymin"),
        (F.col("id") * 3000.0 - 40000 + F.pow(F.lit(2.0), F.col("id") % 17) * (F.col("id") % 3)).alias("xmax"), (F.col("id") * 1500.0 - (F.col("id") % 2) * 50000).alias("ymax"),
    )
    inbox = F.col("px").between(F.col("xmin"), F.col("xmax")) & F.col("py").between(F.col("ymin"), F.col("ymax"))
    brute = rows(pts.join(shapes, inbox).select("id", "s"))
    for floor in (1, 100_000):
        assert rows(points_in_single_shapes(pts, shapes, ["id"], ["s"], F.lit(True), cell=500.0, floor=floor).select("id", "s")) == brute
    assert len(brute) > 100


def test_frames_are_not_copied_to_cells(spark, sf, capsys):
    """A frame is a wide row: the points are copied, so nothing multiplies the frames before they are shuffled."""
    f = domain.frames(spark, sf)
    select.covering_pairs(domain.points(spark, sf), f, ["point_id"]).explain("formatted")
    assert "sequence(" not in capsys.readouterr().out.split("AdaptiveSparkPlan")[-1].replace("sequence(0,", "")


def test_source_rows_are_dealt_to_tasks(spark, sf):
    whole, dealt = domain.table(spark, sf, "part").select("p_partkey"), domain.spread(spark, sf, "part", "p_partkey", each=40)
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert rows(dealt) == rows(whole) and len(parts) == -(-whole.count() // 40) and max(p["count"] for p in parts) <= 60


def test_sizes_of_pictures_make_no_tile_lists(spark, sf, capsys):
    QUERIES["i8_fit_inside"](spark, sf).explain("formatted")
    out = capsys.readouterr().out
    assert "transform(" not in out and "offsets" not in out


def test_compressible_tables_are_not_gathered_in_the_driver(spark, sf, capsys):
    for name in ("p10_ground_or_plane", "p20_ortho_pixels", "s13_detail_json"):
        QUERIES[name](spark, sf).explain("formatted")
        out = capsys.readouterr().out
        assert "SortMergeJoin" in out and "BroadcastHashJoin" not in out, name


def test_boxes_meet_reports_a_pair_once(spark):
    box = lambda k, w: (spark.range(80).select(F.col("id").alias(k), (F.col("id") * 731 % 9000).cast("double").alias(k + "x0"), (F.col("id") * 389 % 7000).cast("double").alias(k + "y0"))
                        .withColumns({k + "x1": F.col(k + "x0") + w, k + "y1": F.col(k + "y0") + w}))
    a, b = box("a", 900.0), box("b", 400.0)
    names = lambda k: [f"{k}{c}" for c in ("x0", "y0", "x1", "y1")]
    got = boxes_meet(a, b, ["a"], ["b"], names("a"), names("b"), cell=700.0, floor=1).select("a", "b")
    cond = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    assert rows(got) == rows(a.join(b, cond).select("a", "b"))


def test_concave_footprints_are_found(spark, sf):
    f = domain.frames(spark, sf).where("cam = 0").drop("turning", "cen_x", "cen_y", "sqrt_area", "z_mid", "xmin", "ymin", "xmax", "ymax")
    dented = f.withColumns({"x2": F.col("x") - 500, "y2": F.col("y") + 500})
    pts = domain.points(spark, sf).withColumn("want_azimuth", F.lit(None).cast("double"))
    got = select.candidates(pts, dented).select("point_id", "filename", F.round("edge_frac", 6))
    q, px, py = quads.corners(), F.col("px"), F.col("py")
    frac = quads.edge_distance(q, px, py) / F.sqrt(quads.area(q))
    want = pts.join(dented, quads.covers(q, px, py)).select("point_id", "filename", F.round(frac, 6))
    assert rows(got) == rows(want) and got.count() > 0


def test_rank_within_buckets(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"), (F.col("id") * 7 % 1000).alias("fid"), F.lit("s").alias("season"))
    w = Window.partitionBy("name")
    want = df.select("name", "fid", F.row_number().over(w.orderBy("fid")).cast("long"), F.count("*").over(w))
    got = skew.with_rank(df, ["name"], "fid", ["season"], "r", "c", bucket=16).select("name", "fid", "r", "c")
    assert rows(got) == rows(want)


def test_neighbours_across_chunks(spark):
    df = spark.range(500).where("id % 11 <> 3 AND id % 97 > 6").select(F.lit("p").alias("p"), F.col("id").alias("shot"), (F.col("id") * 3).alias("v"))
    w = Window.partitionBy("p").orderBy("shot")
    nxt, prv = F.lead("shot").over(w), F.lag("shot").over(w)
    want = df.select("shot", F.when(nxt - F.col("shot") <= 5, nxt).alias("n"), F.when(F.col("shot") - prv <= 5, prv).alias("q"))
    got = skew.with_neighbours(df, ["p"], "shot", 5, ["v"], chunk=8).select("shot", F.col("nxt.shot").alias("n"), F.col("prv.shot").alias("q"))
    assert rows(got) == rows(want)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=777), "b": np.repeat([1.0, 2.0, 1e9], [300, 5, 1]), "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r for r in skew.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.99}, bins=8).collect()}
    low = {r.k: r for r in skew.exact_quantiles(df, ["k"], "v", {"m": 0.02}, interpolate=False, bins=8).collect()}
    for k, vs in values.items():
        assert abs(got[k].m - np.quantile(vs, 0.5)) < 1e-9 * max(1, abs(got[k].m))
        assert abs(got[k].p - np.quantile(vs, 0.99)) < 1e-9 * max(1, abs(got[k].p))
        assert low[k].m == np.sort(vs)[int(0.02 * (len(vs) - 1))]


def test_selection_cuts_before_the_shuffle(spark, sf):
    plan = select.frames_at_points(domain.points(spark, sf), domain.frames(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
