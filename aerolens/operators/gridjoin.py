"""Spatial joins as equi-joins on grid cells.

Spark has no index for "point in outline": as a plain predicate it becomes a nested loop over all pairs. Here every
point has one cell per grid level and every shape is copied to the cells its box touches, so candidates come from an
ordinary shuffled equi-join that spills and retries like any other. Exact geometry runs on the candidates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.operators.skew import HOT_FLOOR, spread_join

CELL_FT = 3000.0


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size)


def _size(level: Column, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), level)


def point_cells(points: DataFrame, x: str, y: str, cell: float, levels: Sequence[int]) -> DataFrame:
    """One row per point and grid level."""
    if len(levels) == 1:
        lv = points.withColumn("__lv", F.lit(levels[0]))
    else:
        lv = points.withColumn("__lv", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = _size(F.col("__lv"), cell)
    return lv.withColumns({"__cx": _cell(F.col(x), size), "__cy": _cell(F.col(y), size)})


def shape_cells(shapes: DataFrame, box: Sequence[str], cell: float, levels: Sequence[int]) -> DataFrame:
    """One row per cell the box touches, on the finest level where that is at most about four cells a side."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    extent = F.greatest(x1 - x0, y1 - y0)
    lv = F.lit(levels[-1])
    for v in reversed(levels[:-1]):
        lv = F.when(extent <= 3 * cell * 2**v, F.lit(v)).otherwise(lv)
    size = _size(F.col("__lv"), cell)
    out = shapes.where(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()).withColumn("__lv", lv)
    out = out.withColumn("__cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size))))
    return out.withColumn("__cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))


def edge_cells(edges: DataFrame, cell: Column | float, pad: float = 0.0, names: tuple[str, str] = ("__cx", "__cy")) -> DataFrame:
    """One row per cell that an edge (ax, ay, bx, by), widened by `pad` on all sides, runs through.

    Rows of cells are walked one by one, and of each only the columns over the edge's own stretch are taken, so that a long
    slanting edge has about as many cells as it crosses, not those of its box.
    """
    size = cell if isinstance(cell, Column) else F.lit(float(cell))
    cx, cy = names
    # A little more on all sides, so that rounding never parts what meets at a cell's edge.
    reach = F.lit(float(pad)) + size * 1e-9
    out = edges.withColumn(cy, F.explode(F.sequence(_cell(F.least("ay", "by") - reach, size), _cell(F.greatest("ay", "by") + reach, size))))
    part = lambda y: F.least(F.greatest((y - F.col("ay")) / F.when(F.col("by") != F.col("ay"), F.col("by") - F.col("ay")), F.lit(0.0)), F.lit(1.0))
    at = lambda y, level: F.when(F.col("ay") == F.col("by"), level).otherwise(F.col("ax") + (F.col("bx") - F.col("ax")) * part(y))
    low, high = F.col(cy) * size - reach, (F.col(cy) + 1) * size + reach
    one, two = at(low, F.col("ax")), at(high, F.col("bx"))
    return out.withColumn(cx, F.explode(F.sequence(_cell(F.least(one, two) - reach, size), _cell(F.greatest(one, two) + reach, size))))


#: Levels of the cells of edges: on each, an edge runs through at most about this many cells a side, but for the coarsest.
EDGE_LEVELS, EDGE_STEP, EDGE_CELLS = 3, 8, 64


def points_near_edges(points: DataFrame, edges: DataFrame, pad: float, at: tuple[str, str] = ("px", "py"), cell: float = CELL_FT) -> DataFrame:
    """Pairs of a point and an edge (ax, ay, bx, by) whose box, widened by `pad`, holds it, found through single edges in cells.

    `cell` should be a few times `pad`: a point meets all edges of its cell, so wide cells make the pairs grow with the square of how
    densely things lie. Long edges lie in wider cells, of which there are few levels, and a point has one cell on each.
    """
    x, y = at
    size = lambda lv: F.lit(float(cell)) * F.pow(F.lit(float(EDGE_STEP)), lv)
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    level = F.lit(EDGE_LEVELS - 1)
    for v in reversed(range(EDGE_LEVELS - 1)):
        level = F.when(extent <= EDGE_CELLS * cell * EDGE_STEP**v, F.lit(v)).otherwise(level)
    placed = points.withColumn("__lv", F.explode(F.array(*[F.lit(v) for v in range(EDGE_LEVELS)])))
    placed = placed.withColumns({"__cx": _cell(F.col(x), size(F.col("__lv"))), "__cy": _cell(F.col(y), size(F.col("__lv")))})
    lying = edge_cells(edges.withColumn("__lv", level), size(F.col("__lv")), pad)
    # Copies to cells are left out of Spark's sizes: neither side goes to the driver. Rows sort fastest by a key that tells them apart.
    met = placed.join(lying.hint("merge"), ["__cx", "__cy", "__lv"]).drop("__lv", "__cx", "__cy")
    # Four comparisons leave few pairs to the formulas that follow. A little more on all sides, against rounding.
    reach = pad + cell * 1e-6
    across = F.col(x).between(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach)
    return met.where(across & F.col(y).between(F.least("ay", "by") - reach, F.greatest("ay", "by") + reach))


def points_in_shapes(
    points: DataFrame,
    shapes: DataFrame,
    point_id: Sequence[str],
    shape_id: Sequence[str],
    inside: Column,
    at: tuple[str, str] = ("px", "py"),
    box: Sequence[str] = ("xmin", "ymin", "xmax", "ymax"),
    also_on: Sequence[str] = (),
    cell: float = CELL_FT,
    levels: Sequence[int] = (0,),
    floor: int = HOT_FLOOR,
    split: bool = True,
) -> DataFrame:
    """All pairs of a point and a shape whose box holds it and for which `inside` is true.

    A point has one cell per level and a shape lives on one level, so a pair meets once: no distinct is needed.
    `also_on` names further columns, present on both sides, that must be equal. Column names must not clash otherwise.
    """
    left = point_cells(points, *at, cell, levels)
    right = shape_cells(shapes, box, cell, levels)
    keys = [*also_on, "__lv", "__cx", "__cy"] if len(levels) > 1 else [*also_on, "__cx", "__cy"]
    if len(levels) == 1:
        left, right = left.drop("__lv"), right.drop("__lv")
    x, y = F.col(at[0]), F.col(at[1])
    x0, y0, x1, y1 = (F.col(c) for c in box)
    hit = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1) & inside
    pairs = spread_join(left, right, keys, point_id, shape_id, hit, floor, split)
    return pairs.drop("__lv", "__cx", "__cy")


def points_in_single_shapes(
    points: DataFrame,
    shapes: DataFrame,
    point_id: Sequence[str],
    shape_id: Sequence[str],
    inside: Column,
    at: tuple[str, str] = ("px", "py"),
    box: Sequence[str] = ("xmin", "ymin", "xmax", "ymax"),
    also_on: Sequence[str] = (),
    cell: float = CELL_FT,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """The pairs of `points_in_shapes`, found by copying points: for shapes that are many and wide rows, and points that are slim.

    A shape is shuffled once, in the cell of its lower-left corner on the first level whose cells are wider than it; so it
    reaches into the next cell at most, and a point asks four cells on each level that any shape is on. Which these are is
    read from the shapes; there are few, as each level's cells are twice as wide as the last one's.
    """
    x, y = F.col(at[0]), F.col(at[1])
    x0, y0, x1, y1 = (F.col(c) for c in box)
    # A little under the cell's width, so that rounding never makes a shape reach over two edges.
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(x1 - x0, y1 - y0) / F.lit(cell * 0.999)))).cast("int")
    right = shapes.where(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()).withColumn("__lv", F.coalesce(level, F.lit(0)))
    levels = sorted(r["__lv"] for r in right.select("__lv").distinct().collect()) or [0]
    size = _size(F.col("__lv"), cell)
    right = right.withColumns({"__cx": _cell(x0, size), "__cy": _cell(y0, size)})
    left = point_cells(points, *at, cell, levels)
    for name in ("__cx", "__cy"):
        left = left.withColumn(name, F.explode(F.array(F.col(name) - 1, F.col(name))))
    hit = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1) & inside
    pairs = spread_join(left, right, [*also_on, "__lv", "__cx", "__cy"], point_id, shape_id, hit, floor)
    return pairs.drop("__lv", "__cx", "__cy")


def boxes_meet(
    left: DataFrame,
    right: DataFrame,
    left_id: Sequence[str],
    right_id: Sequence[str],
    left_box: Sequence[str],
    right_box: Sequence[str],
    also_on: Sequence[str] = (),
    cell: float = CELL_FT,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """All pairs whose boxes share at least a boundary point.

    Both sides are copied to the cells they touch; a pair is kept only in the cell that holds the larger of the two
    lower-left corners, so it is reported once. `cell` should be about the size of the larger side's boxes.
    """
    a = shape_cells(left, left_box, cell, (0,)).drop("__lv")
    b = shape_cells(right, right_box, cell, (0,)).drop("__lv")
    lx0, ly0, lx1, ly1 = (F.col(c) for c in left_box)
    rx0, ry0, rx1, ry1 = (F.col(c) for c in right_box)
    size = F.lit(cell)
    meet = (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1)
    home = (F.col("__cx") == _cell(F.greatest(lx0, rx0), size)) & (F.col("__cy") == _cell(F.greatest(ly0, ry0), size))
    pairs = spread_join(a, b, [*also_on, "__cx", "__cy"], left_id, right_id, meet & home, floor)
    return pairs.drop("__cx", "__cy")
