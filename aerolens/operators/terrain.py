"""Ground heights from elevation patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Cells of a block, each way.
BLOCK = 16


def headers(patches: DataFrame) -> DataFrame:
    """Placement and size of each patch."""
    return patches.select(
        "patch_id",
        F.col("cellSize").alias("cell"),
        F.col("lowerLeftX").alias("left"),
        F.col("lowerLeftY").alias("low"),
        F.size(F.col("value")[0]).alias("cols"),
        F.size("value").alias("rows"),
        F.col("noDataValue").alias("none"),
    )


def _known(z: Column, no_data: Column) -> Column:
    finite = ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))
    return F.when(finite & (z != no_data), z)


def cells(patches: DataFrame) -> DataFrame:
    """Long form (patch_id, i, j, z); cells without data are NULL."""
    by_row = patches.select("patch_id", "noDataValue", F.posexplode("value").alias("j", "__row"))
    return by_row.select("patch_id", "j", "noDataValue", F.posexplode("__row").alias("i", "__z")).select(
        "patch_id", "i", "j", _known(F.col("__z"), F.col("noDataValue")).alias("z")
    )


def blocks(patches: DataFrame, side: int = BLOCK) -> DataFrame:
    """Patches cut into blocks of `side` cells each way (patch_id, bi, bj, width, z): heights in rows one after another.

    A block also has the first column and row of the next one, so that a lookup reads a single block.
    """
    steps = lambda n: F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / side), F.lit(0)).cast("int"))
    cut = patches.withColumn("bj", F.explode(steps(F.size("value"))))
    cut = cut.select("patch_id", "bj", F.slice("value", F.col("bj") * side + 1, F.lit(side + 1)).alias("v"), F.size(F.col("value")[0]).alias("cols"))
    cut = cut.withColumn("bi", F.explode(steps(F.col("cols"))))
    rows = F.transform("v", lambda r: F.slice(r, F.col("bi") * side + 1, F.lit(side + 1)))
    return cut.select("patch_id", "bi", "bj", F.least(F.col("cols") - F.col("bi") * side, F.lit(side + 1)).alias("width"), F.flatten(rows).alias("z"))


def with_heights(places: DataFrame, patches: DataFrame, x: str = "x", y: str = "y", name: str = "height", asked: DataFrame | None = None, side: int = BLOCK) -> DataFrame:
    """Bilinear height between cell centres at each (patch_id, x, y); NULL off the patch or without data.

    Positions are held half a cell inside the edge. Missing corners are left out and the others take a little weight
    each, so that there is an answer right at a missing cell. Only patches that are asked for are cut into blocks, a place meets
    the one block it lies in, and the four heights around it are read from there by their index. `asked` names these patches
    where that is cheaper than to list the places. Heights compress so well on disk that Spark would take large tables of them
    for small ones and gather them in the driver, so these joins are always merged.
    """
    px, py = F.col(x), F.col(y)
    asked = patches.join((places if asked is None else asked).select("patch_id").distinct().hint("merge"), "patch_id", "left_semi")
    df = places.join(headers(asked).hint("merge"), "patch_id", "left")
    width, height = F.col("cols") * F.col("cell"), F.col("rows") * F.col("cell")
    within = (px >= F.col("left")) & (px <= F.col("left") + width) & (py >= F.col("low")) & (py <= F.col("low") + height)
    place = lambda v, first, n: F.least(
        F.greatest((v - F.col(first)) / F.col("cell") - F.lit(0.5), F.lit(0.0)), (F.col(n) - 1).cast("double")
    )
    df = df.withColumns({"__u": F.when(within, place(px, "left", "cols")), "__v": F.when(within, place(py, "low", "rows"))})
    first = lambda at, n: F.greatest(F.least(F.floor(at), F.col(n) - 2), F.lit(0)).cast("int")
    df = df.withColumns({"i": first("__u", "cols"), "j": first("__v", "rows")})
    df = df.withColumns({"bi": F.floor(F.col("i") / side).cast("int"), "bj": F.floor(F.col("j") / side).cast("int")})
    df = df.join(blocks(asked, side).hint("merge"), ["patch_id", "bi", "bj"], "left")
    fu, fv = F.col("__u") - F.col("i"), F.col("__v") - F.col("j")
    one = F.lit(1.0)
    # At the last column or row the cell stands in for the missing neighbour.
    i1, j1 = F.least(F.col("i") + 1, F.col("cols") - 1), F.least(F.col("j") + 1, F.col("rows") - 1)
    read = lambda i, j: _known(F.get("z", (j - F.col("bj") * side) * F.col("width") + i - F.col("bi") * side), F.col("none"))
    corners = {"z00": read(F.col("i"), F.col("j")), "z10": read(i1, F.col("j")), "z01": read(F.col("i"), j1), "z11": read(i1, j1)}
    df = df.withColumns(corners)
    weights = {"z00": (one - fu) * (one - fv), "z10": fu * (one - fv), "z01": (one - fu) * fv, "z11": fu * fv}
    missing = sum(F.col(c).isNull().cast("int") for c in weights) > 0
    extra = F.when(missing, 0.05).otherwise(0.0)
    total = sum(F.coalesce(F.col(c) * (w + extra), F.lit(0.0)) for c, w in weights.items())
    weight = sum(F.when(F.col(c).isNotNull(), w + extra).otherwise(0.0) for c, w in weights.items())
    out = F.when(weight > 1e-9, total / weight)
    return df.select(*places.columns, out.alias(name))


def cut_out(boxes: DataFrame, patches: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
    """`boxes` with the part of their patch (patch_id) that heights within a box depend on, for `heights_within`.

    Adds the patch's placement (`headers`), the first column and row of the part, its number of columns, and its heights in rows
    one after another; NULL where there is no patch. A patch is copied to no row whole, but for boxes as large as it.
    """
    own = headers(patches).columns
    known = patches.select(*headers(patches).columns[:1], "cellSize", "lowerLeftX", "lowerLeftY", F.size(F.col("value")[0]).alias("cols"), F.size("value").alias("rows"), "noDataValue", "value").toDF(*own, "__value")
    df = boxes.join(known.hint("merge"), "patch_id", "left")
    x0, y0, x1, y1 = (F.col(c) for c in box)
    # A cell more on each side, so that rounding leaves none out.
    at = lambda v, first, n, more: F.floor(F.least(F.greatest((v - F.col(first)) / F.col("cell") + F.lit(more), F.lit(0.0)), (F.col(n) - 1).cast("double"))).cast("int")
    df = df.withColumns({"i0": at(x0, "left", "cols", -2.0), "i1": at(x1, "left", "cols", 2.0), "j0": at(y0, "low", "rows", -2.0), "j1": at(y1, "low", "rows", 2.0)})
    wide = F.col("i1") - F.col("i0") + 1
    part = F.transform(F.slice("__value", F.col("j0") + 1, F.col("j1") - F.col("j0") + 1), lambda r: F.slice(r, F.col("i0") + 1, wide))
    return df.withColumns({"wide": wide, "part": F.flatten(part)}).drop("__value", "i1", "j1")


def heights_within(x: np.ndarray, y: np.ndarray, cut: dict) -> np.ndarray:
    """The heights of `with_heights` at places within the box of one row of `cut_out`; not a number where there is none."""
    if cut["part"] is None or cut["none"] is None or any(cut[c] is None for c in ("cell", "left", "low", "cols", "rows")):
        return np.full(len(x), np.nan)
    cell, left, low, cols, rows = (cut[c] for c in ("cell", "left", "low", "cols", "rows"))
    z = np.asarray(cut["part"], float).reshape(-1, cut["wide"])
    z = np.where(np.isfinite(z) & (z != cut["none"]), z, np.nan)
    within = (x >= left) & (x <= left + cols * cell) & (y >= low) & (y <= low + rows * cell)
    u, v = np.clip((x - left) / cell - 0.5, 0.0, cols - 1.0), np.clip((y - low) / cell - 0.5, 0.0, rows - 1.0)
    i, j = (np.maximum(np.minimum(np.floor(at), n - 2), 0) for at, n in ((u, cols), (v, rows)))
    fu, fv = u - i, v - j
    # Places off the patch read some cell, and have no height.
    hold = lambda at, first, n: np.clip(np.nan_to_num(at) - first, 0, n - 1).astype(np.int64)
    i, i1 = hold(i, cut["i0"], z.shape[1]), hold(np.minimum(i + 1, cols - 1), cut["i0"], z.shape[1])
    j, j1 = hold(j, cut["j0"], z.shape[0]), hold(np.minimum(j + 1, rows - 1), cut["j0"], z.shape[0])
    corners = [z[j, i], z[j, i1], z[j1, i], z[j1, i1]]
    weights = [(1 - fu) * (1 - fv), fu * (1 - fv), (1 - fu) * fv, fu * fv]
    gaps = [np.isnan(c) for c in corners]
    extra = np.where(gaps[0] | gaps[1] | gaps[2] | gaps[3], 0.05, 0.0)
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for c, w, gap in zip(corners, weights, gaps):
        total += np.where(gap, 0.0, np.nan_to_num(c) * (w + extra))
        weight += np.where(gap, 0.0, w + extra)
    return np.where(within & (weight > 1e-9), total / np.where(weight > 1e-9, weight, 1.0), np.nan)
