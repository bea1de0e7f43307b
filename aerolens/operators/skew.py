"""Joins, ranks and quantiles that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.session import staged

# A key is hot when it holds more than this share of all rows (and more than the floor), so there can be at most
# 1 / HOT_SHARE hot keys: that bound is what makes broadcasting their list safe at any table size.
HOT_SHARE = 0.001
HOT_FLOOR = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], parts: str, floor: int = HOT_FLOOR) -> DataFrame:
    """At most 1,000 rows: the hot keys and into how many parts each is to be split."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    limit = F.greatest(counts.agg(F.sum("__n")).scalar() * F.lit(HOT_SHARE), F.lit(float(floor)))
    return counts.where(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias(parts))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    condition: Column | None = None,
    floor: int = HOT_FLOOR,
    split: bool = True,
) -> DataFrame:
    """Inner equi-join in which a hot key is cut into a grid of parts, from both sides.

    Rows of a hot key are dealt to parts by a hash of their identity and copied to every part of the other side, so
    each pair still meets exactly once. Other keys are left alone. Nothing is dropped and no group meets in one task.
    Which keys are hot is counted on the rows at every size; `split=False` asks for the plain join.
    """
    if not split:
        out = left.join(right, list(keys))
        return out if condition is None else out.where(condition)
    hot = hot_keys(left, keys, "__lp", floor).join(hot_keys(right, keys, "__rp", floor), list(keys), "full")
    # Written once: both sides read the list, and a plan that held the counting for each would repeat the sides in it.
    hot = F.broadcast(staged(hot))

    def deal(df: DataFrame, own: str, other: str, ids: Sequence[str], own_part: str, other_part: str) -> DataFrame:
        names = df.columns
        df = df.join(hot, list(keys), "left")
        dealt = F.pmod(F.xxhash64(*[F.col(c) for c in ids]), F.coalesce(F.col(own), F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return df.select(*names, dealt.alias(own_part), F.explode(copies).alias(other_part))

    left = deal(left, "__lp", "__rp", left_id, "__l", "__r")
    right = deal(right, "__rp", "__lp", right_id, "__r", "__l")
    # Copies to cells and parts are left out of Spark's sizes, as is how well a table compresses: neither side goes to the driver.
    out = left.join(right.hint("merge"), [*keys, "__l", "__r"])
    if condition is not None:
        out = out.where(condition)
    return out.drop("__l", "__r")


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: str, reach: int, carry: Sequence[str], chunk: int = 4096
) -> DataFrame:
    """Add `nxt` and `prv`: the carried columns of the nearest later and earlier row, at most `reach` steps away.

    `order` is a whole number. The series of a key is cut into chunks, and rows within reach of a chunk's end are also
    given to the next chunk, so a key of any length is worked on in many tasks and no answer changes.
    """
    o = F.col(order)
    home = F.floor(o / F.lit(chunk))
    homes = F.array_distinct(F.array(home, F.floor((o - reach) / F.lit(chunk)), F.floor((o + reach) / F.lit(chunk))))
    spread = df.withColumns({"__home": home, "__chunk": F.explode(homes)})
    w = Window.partitionBy(*keys, "__chunk").orderBy(order)
    row = F.struct(order, *carry)
    found = spread.withColumns(
        {"nxt": F.min(row).over(w.rangeBetween(1, reach)), "prv": F.max(row).over(w.rangeBetween(-reach, -1))}
    )
    return found.where(F.col("__home") == F.col("__chunk")).drop("__home", "__chunk")


def with_rank(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], rank: str, count: str, bucket: int = 65536
) -> DataFrame:
    """row_number() and count() within `keys`, ordered by a whole number, without gathering a key in one task.

    Rows are ranked within buckets of the order column. Only keys that reach over several buckets need an offset per
    bucket, and that table (one row per key and bucket of those keys) is joined back.
    """
    df = df.withColumn("__b", F.floor(F.col(order) / F.lit(bucket)))
    part = Window.partitionBy(*keys, "__b")
    local = df.withColumns(
        {"__r": F.row_number().over(part.orderBy(order, *ties)).cast("long"), "__c": F.count("*").over(part)}
    )
    buckets = local.where(F.col("__r") == 1).select(*keys, "__b", "__c")
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"),
        F.sum("__c").over(per_key).alias("__t"),
        F.count("*").over(per_key).alias("__k"),
    )
    offsets = offsets.where(F.col("__k") > 1).drop("__k")
    out = local.join(offsets, [*keys, "__b"], "left")
    return out.withColumns(
        {
            rank: F.col("__r") + F.coalesce(F.col("__o"), F.lit(0)),
            count: F.coalesce(F.col("__t"), F.col("__c")),
        }
    ).drop("__b", "__r", "__c", "__o", "__t")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], interpolate: bool = True, bins: int = 65536
) -> DataFrame:
    """Exact quantiles per key; `fractions` names the output columns. NULL values are left out.

    Equal values are counted together first. An equal-width histogram (at most `bins` rows per key and rank) then finds
    the narrow bin that holds each wanted rank, and only the distinct values of those bins are put in order. With
    `interpolate` off the value at floor(p (n - 1)) is returned, otherwise the usual linear mix.
    """
    names = list(keys)
    values = df.where(F.col(value).isNotNull()).groupBy(*names, F.col(value).cast("double").alias("__v")).agg(
        F.count("*").alias("__n")
    )
    span = values.groupBy(*names).agg(
        F.sum("__n").alias("__total"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    ranks = []
    for name, p in fractions.items():
        at = F.lit(p) * (F.col("__total") - 1)
        ranks.append(F.struct(F.lit(name).alias("name"), F.lit(0).alias("end"), F.floor(at).alias("rank")))
        if interpolate:
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(1).alias("end"), F.ceil(at).alias("rank")))
    wanted = span.select(*names, "__total", "__lo", "__hi", F.lit(0).cast("long").alias("__base"), F.explode(F.array(*ranks)).alias("__w"))
    rank_id = [*names, "__total", "__w"]

    def within(ranges: DataFrame) -> DataFrame:
        joined = values.join(ranges, names) if names else values.join(ranges, F.lit(True))
        return joined.where(F.col("__v").between(F.col("__lo"), F.col("__hi")))

    def holding(rows: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy(*rank_id).orderBy(order)
        rows = rows.withColumn("__upto", F.col("__base") + F.sum("__n").over(w))
        rows = rows.withColumn("__from", F.col("__upto") - F.col("__n"))
        return rows.where((F.col("__w.rank") >= F.col("__from")) & (F.col("__w.rank") < F.col("__upto")))

    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    slot = F.least(F.coalesce(F.floor((F.col("__v") - F.col("__lo")) / width * F.lit(bins)), F.lit(0)), F.lit(bins - 1))
    hist = (
        within(wanted)
        .groupBy(*rank_id, "__base", slot.alias("__bin"))
        .agg(F.sum("__n").alias("__n"), F.min("__v").alias("__nlo"), F.max("__v").alias("__nhi"))
    )
    narrow = holding(hist, "__bin").select(
        *rank_id, F.col("__nlo").alias("__lo"), F.col("__nhi").alias("__hi"), F.col("__from").alias("__base")
    )
    found = holding(within(narrow), "__v")
    pick = lambda name, end: F.max(F.when((F.col("__w.name") == name) & (F.col("__w.end") == end), F.col("__v")))
    out = []
    for name, p in fractions.items():
        lo = pick(name, 0)
        if interpolate:
            at = F.lit(p) * (F.max("__total") - 1)
            out.append((lo + (pick(name, 1) - lo) * (at - F.floor(at))).alias(name))
        else:
            out.append(lo.alias(name))
    return found.groupBy(*names).agg(*out)
