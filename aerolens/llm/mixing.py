"""Mixing sources to target weights: whole numbers of equal blocks per source and shard, then a seeded choice of blocks.

Sources share a budget by weight, none above a multiple of its own size. Each source's documents are dealt to shards by a
hash of their id, the words of a shard form one sequence, and that is cut into blocks of (nearly) equal size. Sainte-Lague
apportionment gives every source, and within it every shard, a whole number of blocks: seats go to the highest quotients
votes / (2 s - 1). A shard then takes all its blocks as often as the quota covers all of them, and the rest of the quota
by a seeded permutation of its blocks.

Nothing runs per block: the seats that are certain come from the water level of the votes, only about three doubtful
seats for each source or shard are ranked, and a document works out its own overlap with the chosen blocks. Windows run
over one row per source, at most `shards` rows of a source, or the documents of one shard.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own and comes last; repeated
rows are documents of their own; without any words all targets are 0; an empty table gives no rows. Other columns of the
input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.llm import common

#: A prime above any number of blocks in a shard, so that j -> (j * STRIDE + c) mod m is a permutation of the blocks.
STRIDE = 2147483647


def water_level(groups: Sequence[str], weight: Column, cap: Column, total: Column, tie: Sequence[str]) -> Column:
    """The level x at which least(cap, x * weight) sums to `total` in each group; above all caps if they sum to less."""
    everything = Window.partitionBy(*groups)
    before = everything.orderBy(cap / weight, *tie).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    open_weight = F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    # With the rows in order of cap / weight this rises until the first row that stays below its cap, then falls.
    return (total - capped) / open_weight


def apportioned(rows: DataFrame, groups: Sequence[str], ids: Sequence[str], votes: str, cap: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: `seats` of each group go to the highest votes / (2 s - 1), no row above `cap`. Adds column `out`.

    Rows have positive votes and a positive whole cap; `seats` is the same within a group and at most the caps' sum.
    """
    whole = Window.partitionBy(*groups)
    v, c = F.col(votes), F.col(cap).cast("double")
    n = F.count("*").over(whole)
    rows = rows.withColumns(
        {
            "__lo": water_level(groups, v, c, F.greatest(F.lit(0.0), F.col(seats) - n / 2), ids),
            "__hi": water_level(groups, v, c, F.col(seats) + n / 2, ids),
        }
    )
    rows = rows.withColumns({"__lo": F.max("__lo").over(whole), "__hi": F.max("__hi").over(whole)})
    # Rounding moves each row by half a seat at most: seats below __lo are certain, seats above __hi are out of reach.
    rows = rows.withColumns(
        {
            "__base": F.least(F.greatest(F.lit(0), F.floor(F.col("__lo") * v - 0.5)), F.col(cap)).cast("long"),
            "__top": F.least(F.ceil(F.col("__hi") * v + 0.5) + 1, F.col(cap)).cast("long"),
        }
    )
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__base").over(whole))
    doubtful = rows.where(F.col("__top") > F.col("__base")).select(
        *groups, *ids, "__left", v.alias("__v"), F.explode(F.sequence(F.col("__base") + 1, F.col("__top"))).alias("__s")
    )
    order = whole.orderBy((F.col("__v") / (2 * F.col("__s") - 1)).desc(), *ids, "__s")
    won = doubtful.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= F.col("__left"))
    won = won.groupBy(*groups, *ids).agg(F.count("*").alias("__won"))
    keys = list(dict.fromkeys([*groups, *ids]))
    out_rows = rows.join(won, keys, "left").withColumn(out, F.col("__base") + F.coalesce("__won", F.lit(0)))
    return out_rows.drop("__lo", "__hi", "__base", "__top", "__left", "__won")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """source_no, source, source_size, target of every source; `sizes` has one row per source.

    The windows without partitions see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"weight": weight, "__cap": F.col("source_size") * F.lit(float(limit))})
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    rows = rows.withColumn("__level", water_level([], F.col("weight"), F.col("__cap"), total, ["source_no"]))
    rows = rows.withColumn("__level", F.max("__level").over(whole))
    target = F.least(F.col("__cap"), F.col("__level") * F.col("weight"))
    return rows.select("source_no", "source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    block: int = 64,
    shards: int = 4096,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every document with source_size, target, and what the mix takes of it.

    `taken` counts words, repeats included; `passes` is how often the whole text is taken, `picked` the ranges of words
    (first, count) taken once more. `carry` names input columns to hand on, as fields of a struct `row`. A source has one
    shard for each 64 blocks, at most `shards`, which bounds the rows of its apportionment.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id"),
        F.col("source"),
        common.word_count(F.col("text")).alias("size"),
        *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []),
    )
    if not carry:
        sized = common.stored(sized, "sizes")
    sources = common.stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "sources")
    n_sources = sources.count()
    per_source = F.least(F.lit(shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / (64 * block)))).cast("long")
    known = sources.select(F.col("source").alias("__source"), "source_no", "source_size", "target", per_source.alias("__shards"))
    rows = sized.join(common.small(known, n_sources), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    deal = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = rows.withColumns({"__deal": deal, "shard": F.pmod(deal, F.col("__shards"))})

    cells = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = cells.where("words > 0").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    cells = common.stored(cells, "cells")
    per = cells.groupBy("source_no").agg(F.sum("blocks").alias("blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    per = per.where("target > 0").withColumns({"votes": F.col("target") * F.col("blocks") / F.col("source_size"), "cap": F.floor(F.col("blocks") * limit)})
    per = per.withColumn("seats", F.least(F.round(F.sum("votes").over(Window.partitionBy())), F.sum("cap").over(Window.partitionBy())))
    quotas = apportioned(per, [], ["source_no"], "votes", "cap", "seats", "source_blocks")
    cells = cells.join(common.small(quotas.select("source_no", "source_blocks"), n_sources), "source_no")
    cells = cells.withColumns({"votes": F.col("blocks").cast("double"), "cap": F.floor(F.col("blocks") * limit), "seats": F.col("source_blocks").cast("double")})
    # Shard caps can lose a fraction of a block each when the limit is no whole number.
    cells = cells.withColumn("seats", F.least("seats", F.sum("cap").over(Window.partitionBy("source_no"))))
    quota = common.stored(apportioned(cells, ["source_no"], ["shard"], "votes", "cap", "seats", "quota").select("source_no", "shard", "words", "blocks", "quota"), "quotas")

    rows = rows.join(quota.hint("merge"), ["source_no", "shard"], "left")
    line = Window.partitionBy("source_no", "shard").orderBy("__deal", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(line), F.lit(0))
    rows = rows.withColumns(
        {
            "__start": start,
            "passes": F.coalesce(F.expr("quota div blocks"), F.lit(0)),
            "__rest": F.coalesce(F.col("quota") % F.col("blocks"), F.lit(0)),
            "__turn": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("source_no"), F.col("shard")), F.col("blocks")),
        }
    )
    chosen = F.expr(
        f"""CASE WHEN size > 0 AND __rest > 0 THEN transform(
            filter(sequence(((__start + 1) * blocks - 1) div words, ((__start + size) * blocks - 1) div words),
                   j -> pmod(j * {STRIDE} + __turn, blocks) < __rest),
            j -> named_struct('first', greatest((j * words) div blocks, __start) - __start,
                              'count', least(((j + 1) * words) div blocks, __start + size) - greatest((j * words) div blocks, __start)))
        ELSE array() END"""
    )
    rows = rows.withColumn("picked", chosen)
    taken = F.col("passes") * F.col("size") + F.aggregate("picked", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "passes", "picked", *(["row"] if carry else [])
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents, with the columns of `docs`: whole texts as often as they are taken, then a text of the picked words.

    A document of which nothing is taken is left out. n_chars, where it is a column, follows the text.
    """
    rows = mix(docs, carry=docs.columns, **settings)
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit("[\\x20\\x09-\\x0D]*" + common.WORD), F.lit(0))
    part = F.when(
        F.size("picked") > 0,
        F.array(F.array_join(F.flatten(F.transform("picked", lambda p: F.slice(F.col("__words"), (p["first"] + 1).cast("int"), p["count"].cast("int")))), "")),
    ).otherwise(F.array().cast("array<string>"))
    rows = rows.where("taken > 0").withColumn("__words", F.when(F.size("picked") > 0, pieces))
    rows = rows.withColumn("__text", F.explode(F.concat(F.array_repeat(F.col("row.text"), F.col("passes").cast("int")), part)))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
