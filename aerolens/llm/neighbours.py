"""Approximate nearest neighbours: probed lists, scanned by an adaptive number of dimensions.

Centres are fitted on a bounded sample (`sample` vectors); every vector is put into the list of its nearest centre. All vectors
are turned by one random rotation, so that the first d of D dimensions hold about d / D of any squared distance. A query
scans the lists of its `probes` share of nearest centres. A list's vectors lie in column blocks: after each block of dimensions
a hypothesis test compares the partial distance, scaled up to all dimensions, with the query's k-th best so far, and abandons
the candidates for which a distance below it is improbable (by `epsilon` standard deviations). Those that remain to the last
block are measured exactly, in double precision on the original vectors, and the best k of all lists are kept.

Equal vectors are one candidate, which keeps the k + 1 smallest ids (a query drops its own), and equal query vectors are one
query; so a vector that a third of all rows share is scanned once. Lists are cut into pieces of at most about `piece` vectors
by a hash, and a query meets the pieces of its lists, so a task's group is bounded however large a list is.

The vectors without structure that this was measured on need a large share of the lists for a recall of 0.9; `probes` is a
share, so the recall holds at every size, and the lists grow with the square root of the rows. A query whose lists hold too few
vectors for k answers probes further ones.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
as query or candidate; a null id takes no part; repeated ids count once per id and vector; with fewer than k candidates all
are returned; equal distances go to the smaller id; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from aerolens.llm import common


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): vectors that take part, in double precision."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def centres(rows: DataFrame, dims: int, lists: int, sample: int, seed: int) -> np.ndarray:
    """Centres from a sample of at most `sample` vectors, the first in the order of a hash."""
    taken = rows.orderBy(F.xxhash64(F.lit(seed), "group"), "group").limit(sample).select("v").toPandas()
    x = np.stack(taken["v"].to_numpy()).astype(float)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(10):
        near = _squared(x, c).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0.0)


def scan(queries: np.ndarray, turned_queries: np.ndarray, x: np.ndarray, turned: np.ndarray, k: int, block: int, epsilon: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates that may be among its k nearest, and their exact squared distances.

    The first k candidates are measured in full and give the threshold; the others are tested after each block of columns.
    """
    n, dims = turned.shape
    out = []
    columns = [np.ascontiguousarray(turned[:, a : a + block]) for a in range(0, dims, block)]
    for q, tq in zip(queries, turned_queries):
        alive = np.arange(n)
        partial = np.zeros(n)
        limit = math.inf
        if n > k:
            first = ((columns[0] - tq[:block]) ** 2).sum(axis=1)
            near = np.argpartition(first, k - 1)[:k]
            limit = float(((x[near] - q) ** 2).sum(axis=1).max()) * (1 + 1e-12)
        done = 0
        for part in columns:
            width = part.shape[1]
            partial = partial + ((part[alive] - tq[done : done + width]) ** 2).sum(axis=1)
            done += width
            # With d dimensions seen the scaled distance strays from the true one by about epsilon / sqrt(d).
            bound = limit * (done / dims) * (1 + epsilon / math.sqrt(done)) ** 2 if done < dims else limit * (1 + 1e-9)
            stay = partial <= bound
            alive, partial = alive[stay], partial[stay]
        exact = ((x[alive] - q) ** 2).sum(axis=1)
        if len(alive) > k:
            kth = np.partition(exact, k - 1)[k - 1]
            near = exact <= kth
            alive, exact = alive[near], exact[near]
        out.append((alive, exact))
    return out


def search(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    probes: float = 0.6,
    list_rows: float = 2.0,
    sample: int = 20_000,
    piece: int = 4096,
    block: int = 16,
    epsilon: float = 2.1,
    seed: int = 42,
    id_col: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the k nearest found of every row that `is_query` (of `id`) marks."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, column)
    usual = common.stored(rows, "vectors")
    lengths = usual.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out_schema)
    dims = lengths[0].d
    usual = usual.where(F.size("v") == dims)
    # One group for each distinct vector, named by its smallest id; -0.0 and 0.0 are the same number.
    usual = usual.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    ordered = Window.partitionBy("v").orderBy("id")
    firsts = usual.distinct().withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= k + 1)
    groups = firsts.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("group"), "ids", "v")
    groups = common.stored(groups, "vector-groups")
    asked = usual.where(is_query(F.col("id"))).select("id", "v").distinct()
    asked = common.stored(asked.join(groups.select("group", "v"), "v").select("id", "group"), "asked")
    n = groups.count()
    lists = max(1, min(sample, round(list_rows * math.sqrt(n))))
    c = centres(groups, dims, lists, sample, seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    probed = max(1, math.ceil(probes * len(c)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, dims))
            yield pd.DataFrame({"list": _squared(x, c).argmin(axis=1).astype("int32"), "group": b["group"], "v": b["v"]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, dims))
            order = np.argsort(_squared(x, c), axis=1, kind="stable")
            # The probed share, and on until the lists hold enough.
            enough = (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1) + 1
            yield pd.DataFrame({"list": [o[: max(probed, n)].astype("int32") for o, n in zip(order, enough.tolist())], "group": b["group"], "v": b["v"]})

    listed = common.stored(groups.select("group", "v").mapInPandas(assign, "list int, group long, v array<double>"), "lists")
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))  # one row for each centre
    held = np.zeros(len(c), np.int64)
    for row in listed.groupBy("list").count().collect():  # one row for each centre
        held[row["list"]] = row["count"]
    sizes = F.broadcast(sizes) if len(c) <= common.BROADCAST_ROWS else sizes
    pieces = listed.join(sizes, "list").withColumn("piece", F.pmod(F.xxhash64("group"), F.col("pieces")).cast("int")).drop("pieces")
    heads = asked.select("group").distinct().join(groups.select("group", "v"), "group")
    wanted = heads.mapInPandas(probe, "list array<int>, group long, v array<double>").select(F.explode("list").alias("list"), "group", "v")
    wanted = wanted.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "group", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asker": [], "group": [], "squared": []})
        q, x = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        ids = right["group"].to_numpy()
        found = scan(q, q @ rotation, x, x @ rotation, k + 1, block, epsilon)
        return pd.DataFrame(
            {
                "asker": np.repeat(left["group"].to_numpy(), [len(f) for f, _ in found]),
                "group": np.concatenate([ids[f] for f, _ in found]),
                "squared": np.concatenate([d for _, d in found]),
            }
        )

    near = wanted.groupBy("list", "piece").cogroup(pieces.groupBy("list", "piece")).applyInPandas(compare, "asker long, group long, squared double")
    best = Window.partitionBy("asker").orderBy("squared", "group")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    near = common.stored(near.join(groups.select("group", "ids"), "group").select("asker", "squared", F.explode("ids").alias("vec_id")), "near")
    # Of the ids of k + 1 vectors the first k + 1, so that k remain without the query's own.
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy("squared", "vec_id"))).where(F.col("r") <= k + 1)
    found = asked.join(near.withColumnRenamed("asker", "group"), "group").where("id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("squared", "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("id").alias("query_id"), "rank", "vec_id", F.sqrt("squared").alias("score"))
