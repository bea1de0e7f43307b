"""Data-quality rules: each is one row (rule, n_bad); the runner raises on any that is not zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.functions import quads, rings, shapes
from aerolens.functions.angles import full_turn, half_turn
from aerolens.functions.rings import settle
from aerolens.operators.gridjoin import edge_cells

CAMERAS = ["Color", "Fwd", "Bwd", "Left", "Right"]
#: Vertices up to which all pairs of a shape's edges are compared.
ALL_PAIRS = 64


class RuleBroken(Exception):
    """A rule that had to hold found rows against it."""


def rule(name: str, bad: DataFrame) -> DataFrame:
    """The number of rows of `bad` as one rule row."""
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")


def rules(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Several row rules in one pass: a row is bad where its condition is true (NULL is not)."""
    counts = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("n_bad")) for i, name in enumerate(conditions)]
    return counts.select(F.inline(F.array(*pairs)))


def gather(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def enforce(report: DataFrame) -> None:
    """Raise when any rule found rows. Only the handful of broken rules reaches the driver."""
    broken = report.where(F.col("n_bad") > 0).orderBy("rule").collect()
    if broken:
        raise RuleBroken("; ".join(f"{r['rule']} ({r['n_bad']} rows)" for r in broken))


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def keys_missing(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys of one table that the other does not have."""
    return rule(name, left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti"))


def counts_equal(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys with different numbers of rows on the two sides."""
    a = left.groupBy(*keys).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("b"))
    return rule(name, a.join(b, keys, "full").where(distinct_from(F.col("a"), F.col("b"))))


def pairs_agree(frames: DataFrame, eo: DataFrame, name: str) -> DataFrame:
    """Paired rows whose orientation row names another photo."""
    pairs = frames.alias("r").join(eo.alias("e"), (F.col("r.season_key") == F.col("e.season_key")) & (F.col("r.rn") == F.col("e.fid")))
    return rule(name, pairs.where(distinct_from(F.col("e.ID"), F.regexp_replace(F.col("r.Filename"), r"\.tif$", ""))))


def partnerless(frames: DataFrame, eo: DataFrame, name: str) -> DataFrame:
    """Frame rows without an orientation row."""
    partners = eo.select("season_key", F.col("fid").alias("rn"))
    return rule(name, frames.select("season_key", "rn").join(partners, ["season_key", "rn"], "left_anti"))


def address_rules(base: str, prefix: str, suffix: str) -> dict[str, Column]:
    """Address, folder and camera. A NULL camera is not outside the list, as in SQL."""
    folder = F.concat(F.lit(prefix), F.col("season_key"), F.lit(suffix + "/"))
    return {
        "address is not the base plus the name": distinct_from(F.col("S3URL"), F.concat(F.lit(base), F.col("Filename"))),
        "name is not under its season folder": ~F.startswith(F.col("Filename"), folder),
        "unexpected camera": ~F.col("CameraID").isin(CAMERAS),
    }


def shot_grammar() -> Column:
    """ShotID is not camera_[date_]line_shot, or does not match line, camera and name."""
    shot = F.col("ShotID")
    return (
        distinct_from(F.regexp_extract(shot, r"_(\d+)_\d+$", 1), F.col("FL"))
        | F.regexp_extract(shot, r"_(\d+)$", 1).try_cast("bigint").isNull()
        | distinct_from(F.split_part(shot, F.lit("_"), F.lit(1)), F.col("CameraID"))
        | distinct_from(F.concat(shot, F.lit(".tif")), F.regexp_replace("Filename", r"^.*/", ""))
    )


def clock_of(text: Column) -> Column:
    """Seconds since midnight of a time of day, to the microsecond; NULL when it is none.

    One or two digits of hours, minutes and, if given, seconds, with or without a fraction; blanks around it do not matter.
    """
    form = r"^\s*([01]?\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d)(?:\.(\d*))?)?\s*\z"
    part = lambda k: F.coalesce(F.regexp_extract(text, form, k).try_cast("int"), F.lit(0))
    fraction = F.rpad(F.substring(F.regexp_extract(text, form, 4), 1, 6), 6, "0")
    seconds = F.concat_ws(".", part(1) * 3600 + part(2) * 60 + part(3), fraction).cast("decimal(18,6)")
    return F.when(text.rlike(form), seconds)


def zone_hours(label: Column) -> Column:
    """Hours in parentheses of a zone label such as `EDT (-4)`; NULL without them."""
    return F.regexp_extract(label, r"\((-?\d+)\)", 1).try_cast("int")


def unparsed_time() -> Column:
    return zone_hours(F.col("TimeZone")).isNull() | clock_of(F.col("FlightTime")).isNull() | F.col("FlightDate").isNull()


def unique(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows beyond the first of each value (NULLs count as rows without a value)."""
    return df.agg((F.count("*") - F.countDistinct(column)).alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")


def conserved(kept: DataFrame, aside: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """Kept plus set aside minus source."""
    one = lambda d, w: d.agg((F.count("*") * w).alias("n"))
    total = gather(one(kept, F.lit(1)), one(aside, F.lit(1)), one(source, F.lit(-1)))
    return total.agg(F.sum("n").alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")


def incomplete_groups(df: DataFrame, group: str, member: str, size: int, name: str) -> DataFrame:
    """Groups that do not have exactly `size` distinct members."""
    per = df.groupBy(group).agg(F.countDistinct(member).alias("n"))
    return rule(name, per.where(F.col("n") != size))


def outline_health(ring: Column | None = None) -> dict[str, Column]:
    """Footprints that cross themselves or have no area, and rows without one, told from the corner columns.

    With the decoded `ring` an empty outline is told from a missing one; corner columns alone cannot tell them apart. Outlines that
    are no quads are judged by `outline_rules`.
    """
    q = quads.corners()
    missing = reduce(lambda a, b: a | b, [c.isNull() for xy in q for c in xy])
    return {
        "frame without a footprint": missing if ring is None else ring.isNull(),
        "invalid footprint": ~missing & (crossed(q) | (quads.area(q) == 0)),
        "empty footprint": missing if ring is None else ring.isNotNull() & (F.size(ring) == 0),
    }


def with_validity(frames: DataFrame, key: str = "filename", srid: int = 3089) -> DataFrame:
    """`frames` with `outline_state`: missing, empty, invalid or valid; and whether it is in another reference system.

    An outline is invalid if two of its edges cross, within a ring or between rings, if a ring has under three corners, or if it
    has no area. Quads are judged by their corners, others edge by edge (`crossing_shapes`); `key` is unique.
    """
    q, shape = quads.corners(), shapes.of_frame(frames.columns)
    quad = F.col("x0").isNotNull()
    df = settle(frames.withColumn("__shape", F.when(~quad, shape)), "__shape")
    df = settle(df.withColumn("__area", F.when(quad, quads.area(q)).otherwise(shapes.area(F.col("__shape")))), "__area")
    short = F.exists(F.flatten("__shape"), lambda r: F.size(rings.opened(r)) < 3)
    others = df.where(F.col("__shape").isNotNull()).select(key, "__shape")
    long = F.coalesce(F.size(shapes.vertices(F.col("__shape"))) > ALL_PAIRS, F.lit(False))
    # Outlines of a few corners are told on their own rows; only long ones are brought together with what their edges say.
    cut = crossing_shapes(others.where(long), key, F.col("__shape")).withColumn("__cut", F.lit(True))
    few = settle(df.where(~long).withColumn("__edges", shapes.edge_list(F.col("__shape"))), "__edges")
    few = few.withColumn("__cut", F.col(key).isNotNull() & shapes.crosses_itself(F.col("__edges"))).drop("__edges")
    df = few.unionByName(df.where(long).join(cut.hint("merge"), key, "left"))
    bad = F.coalesce(F.when(quad, crossed(q)).otherwise(F.col("__cut") | short), F.lit(False)) | (F.col("__area") <= 0)
    state = F.when(F.col("ring").isNull(), "missing").when(F.size("ring") == 0, "empty").when(bad, "invalid").otherwise("valid")
    other = F.col("srid") != srid if "srid" in frames.columns else F.lit(False)
    return df.withColumns({"outline_state": state, "other_srid": F.coalesce(other, F.lit(True))}).drop("__shape", "__area", "__cut")


def crossing_shapes(df: DataFrame, key: str, shape: Column) -> DataFrame:
    """The keys of shapes with two edges that properly cross.

    All pairs of edges of a shape of at most `ALL_PAIRS` vertices are compared on its own row, and nothing of it is shuffled. A
    longer one has cells of its own, about as many as edges; an edge goes to the cells that it runs through, and only edges that
    meet in a cell are compared, so that a long outline is spread over tasks and no pair of far edges is formed.
    """
    df = settle(df.where(F.col(key).isNotNull()).select(key, shape.alias("__shape")), "__shape")
    long = F.size(shapes.vertices(F.col("__shape"))) > ALL_PAIRS
    few = settle(df.where(~long).select(key, shapes.edge_list(F.col("__shape")).alias("__edges")), "__edges")
    few = few.where(shapes.crosses_itself(F.col("__edges"))).select(key)
    return few.unionByName(_crossing_in_cells(df.where(long), key, F.col("__shape"))).distinct()


def _crossing_in_cells(df: DataFrame, key: str, shape: Column) -> DataFrame:
    """The keys of shapes with two edges that meet in a cell and properly cross."""
    spread = lambda a: F.array_max(F.transform(shapes.vertices(shape), lambda p: p[a])) - F.array_min(F.transform(shapes.vertices(shape), lambda p: p[a]))
    count = F.greatest(F.ceil(F.sqrt(F.size(shapes.vertices(shape)).cast("double"))), F.lit(1))
    pitch = df.select(key, (F.greatest(spread("x"), spread("y")) / count).alias("pitch")).where("pitch > 0")
    e = edge_cells(shapes.numbered_edges(df, key, shape).join(pitch.hint("merge"), key), F.col("pitch"), names=("column", "row"))
    names = ("ring", "i", "n", "ax", "ay", "bx", "by")
    a, b = (e.select(key, "row", "column", *[F.col(c).alias(s + c) for c in names]) for s in "pq")
    ordered = (F.col("pring") < F.col("qring")) | ((F.col("pring") == F.col("qring")) & (F.col("pi") < F.col("qi")))
    near = (F.col("pring") == F.col("qring")) & ((F.col("qi") - F.col("pi") == 1) | ((F.col("pi") == 0) & (F.col("qi") == F.col("qn") - 1)))
    side = lambda s, t, u: rings.side(F.col(s + "ax"), F.col(s + "ay"), F.col(s + "bx"), F.col(s + "by"), F.col(t + u + "x"), F.col(t + u + "y"))
    cross = (side("p", "q", "a") * side("p", "q", "b") < 0) & (side("q", "p", "a") * side("q", "p", "b") < 0)
    return a.join(b.hint("merge"), [key, "row", "column"]).where(ordered & ~near & cross).select(key).distinct()


def outline_rules(frames: DataFrame, key: str = "filename") -> DataFrame:
    """(rule, n_bad) over outlines of any kind."""
    state = F.col("outline_state")
    return rules(
        with_validity(frames, key),
        {"frame without a footprint": state == "missing", "empty footprint": state == "empty", "invalid footprint": state == "invalid", "footprint in another reference system": F.col("other_srid")},
    )


def crossed(q) -> Column:
    """Whether two opposite sides of a quad properly cross."""

    def side(a, b, c):
        return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    def cut(a, b, c, d):
        return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)

    return cut(q[0], q[1], q[2], q[3]) | cut(q[1], q[2], q[3], q[0])


def misdirected(columns=()) -> Column:
    """Footprints that do not lie where the photo looks: bearing within 3 degrees and 3,000 to 7,000 ft away, nadir within 60 ft.

    A quad's place is the mean of its corners, another outline's its centroid (`cen_x`, `cen_y`), where `columns` names these.
    """
    q = quads.corners()
    mx, my = sum(c[0] for c in q) / 4, sum(c[1] for c in q) / 4
    if "cen_x" in columns:
        mx, my = F.coalesce(mx, F.col("cen_x")), F.coalesce(my, F.col("cen_y"))
    away = quads.distance(F.col("x"), F.col("y"), mx, my)
    bearing = full_turn(F.degrees(F.atan2(mx - F.col("x"), my - F.col("y"))))
    off = F.abs(half_turn(bearing - F.col("look_azimuth_deg")))
    return F.when(F.col("look_azimuth_deg").isNull(), away > 60).otherwise((off > 3) | (away < 3000) | (away > 7000))
