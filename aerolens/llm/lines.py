"""Line deduplication: repeated runs of lines, found by prefix doubling over line numbers, are deleted from later documents.

Every line that has a word gets a number, the same for equal lines; lines that occur once have none, and end every run. In
round k each place that starts 2^k repeated lines gets the number of that run: the sorted pair of the numbers of its two
halves, kept only while the pair occurs at least twice. These are the ranks of a suffix array over the lines, restricted to its
intervals of common prefixes, and doubled only as far as runs are compared.

A run counts when it has at least `min_words` words. For each place the shortest such runs that start and that end there are
compared (two overlapping halves of 2^k lines name a run of any length); every longer repeated run is covered by these. Of
equal runs the first stays, in the order of doc_id and line; the lines of the others are deleted. So what is deleted always
stays elsewhere, and a line that is part of no repeated run of that many words is kept.

Everything is a table: numbers come from map-side combined counts of distinct keys, are written, and joined back by plain
shuffles that Spark can split at a line which a third of all documents share. Joins are always merged: tables of numbers take so
few bytes on disk that Spark would gather long ones in the driver. Windows run within one document.

Defined cases: a null text stays null and has no lines; lines of blanks only are kept and do not end runs; runs may lie in one
document; repeated rows are copies, of which the later loses its repeated runs; a null doc_id comes last; a document that loses
all its lines keeps an empty text; an empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from aerolens.llm import common


def _numbered(keys: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """Keys that occur at least twice, sorted and numbered."""
    often = keys.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return common.stored(often.sortWithinPartitions(*names).withColumn("number", F.monotonically_increasing_id()), what)


def repeated_lines(texts: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """From (row, doc_id, text): (per row: n_lines), and (row, line) of the lines to delete, lines counted from 0."""
    lines = texts.select("row", "doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line", "value"))
    lines = lines.select("row", "doc_id", "line", F.md5("value").alias("digest"), common.word_count(F.col("value")).cast("int").alias("words"))
    lines = common.stored(lines.where("words > 0"), "lines")
    place = F.row_number().over(Window.partitionBy("row").orderBy("line"))
    n_lines = lines.groupBy("row").agg(F.count("*").alias("n_lines"))

    names = _numbered(lines, ["digest"], "line-names")
    placed = lines.withColumn("i", place)
    level = common.stored(placed.join(names.hint("merge"), "digest").select("row", "doc_id", "i", "line", "words", F.col("number").alias("name")), "lines-0")
    # Stretches of repeated lines without a gap; a run lies within one.
    stretch = F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i"))
    some = level.withColumn("stretch", stretch)
    within = Window.partitionBy("row", "stretch").orderBy("i")
    enough = lambda words: F.aggregate(  # noqa: E731  the number of lines until there are enough words; 0 if there never are
        words,
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")),
        lambda a, w: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["s"] + w).alias("s"), (a["n"] + 1).alias("n"))),
        lambda a: F.when(a["s"] >= min_words, a["n"]).otherwise(F.lit(0)),
    )
    reach = min_words - 1  # a line has a word at least
    some = some.withColumns(
        {
            "ahead": enough(F.collect_list("words").over(within.rowsBetween(0, reach))),
            "back": enough(F.reverse(F.collect_list("words").over(within.rowsBetween(-reach, 0)))),
        }
    )
    runs = some.select("row", "doc_id", F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("ahead").alias("size")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("size")))).alias("r"))
    runs = common.stored(runs.select("row", "doc_id", "r.i", "r.size").where("size > 0").distinct(), "runs")
    longest = runs.agg(F.max("size")).first()[0] or 0

    level = level.select("row", "i", "name")
    keyed, half = [], 1
    while half <= longest:
        ours = runs.where((F.col("size") >= half) & (F.col("size") < 2 * half))
        ours = ours.join(level.withColumnRenamed("name", "a").hint("merge"), ["row", "i"])
        ends = level.select("row", F.col("i").alias("j"), F.col("name").alias("b"))
        ours = ours.withColumn("j", F.col("i") + F.col("size") - half).join(ends.hint("merge"), ["row", "j"])
        keyed.append(ours.select("row", "doc_id", "i", "size", "a", "b"))
        if 2 * half > longest:
            break
        after = F.first("name").over(Window.partitionBy("row").orderBy("i").rangeBetween(half, half))
        pairs = common.stored(level.withColumn("next", after).where("next IS NOT NULL"), "line-pairs")
        names = _numbered(pairs, ["name", "next"], "line-pair-names")
        level = common.stored(pairs.join(names.hint("merge"), ["name", "next"]).select("row", "i", F.col("number").alias("name")), f"lines-{half}")
        half *= 2
    if not keyed:
        return n_lines, lines.select("row", "line").limit(0)
    found = keyed[0]
    for more in keyed[1:]:
        found = found.unionByName(more)
    found = common.stored(found, "run-keys")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "i")
    firsts = found.groupBy("size", "a", "b").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    firsts = common.stored(firsts.select("size", "a", "b", F.col("first.row").alias("first_row"), F.col("first.i").alias("first_i")), "run-firsts")
    later = found.join(firsts.hint("merge"), ["size", "a", "b"]).where("row <> first_row OR i <> first_i")
    gone = later.select("row", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("size") - 1)).alias("i")).distinct()
    return n_lines, gone.join(placed.select("row", "i", "line").hint("merge"), ["row", "i"]).select("row", "line")


def deduplicated(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """Every row: `row` (the input's columns as a struct), text (without the deleted lines), n_lines, n_removed."""
    texts = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "texts")
    slim = texts.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    n_lines, gone = repeated_lines(slim, min_words)
    # As many lines as one document has.
    gone = common.stored(gone.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("gone")), "gone")
    counts = n_lines.join(gone.hint("merge"), "row", "left")
    out = texts.join(counts.hint("merge"), "row", "left")
    out = out.withColumn("lines", F.split("doc.text", "\n", -1))
    # The kept lines are the slices between deleted ones.
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    slices = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("gone") + 1),
            lambda k: F.slice("lines", F.element_at(cuts, k) + 2, F.element_at(cuts, k + 1) - F.element_at(cuts, k) - 1),
        )
    )
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(slices, "\n"))
    return out.select(
        F.col("doc").alias("row"), text.alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
