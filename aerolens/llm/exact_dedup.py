"""Exact deduplication by deterministic block naming.

A text without its blanks is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and get whole numbers as
names; then adjacent names are paired, distinct pairs are sorted and named, and so on until each document has one name. Two
texts are equal if and only if they have the same number of blocks and the same last name: names stand for the texts
themselves, so nothing can collide.

Texts are shuffled once: a batch of documents lists each of its blocks once (so a block that holds a third of all rows is one
row for each batch), the blocks of all batches are grouped, and the names go back by (batch, number of the block in it). The
levels above are slim tables of whole numbers; their names come from map-side combined distinct pairs, written before they are
joined back, so that both sides of the join are plain shuffles that Spark can split at a much copied pair. Levels halve; there
are log2 of the longest text's blocks.

Defined cases: a null text counts as empty; texts of blanks only are empty, and all empty texts are equal; repeated rows are
copies of one another; a null doc_id comes after all others when the row that stays is chosen; an empty table gives no rows.
Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from aerolens.llm import common


def blocked(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """One row for each document: row, batch, n_points, n_blocks, text_sha256, `blocks` (its blocks' numbers in the batch), and
    `fresh`, those of its blocks that the batch had not seen, numbered from `fresh_at`."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = StructType([rows.schema["doc_id"]])
    for name, kind in (("row", LongType()), ("batch", LongType()), ("n_points", LongType()), ("n_blocks", IntegerType()), ("text_sha256", StringType()), ("blocks", ArrayType(IntegerType())), ("fresh_at", IntegerType()), ("fresh", ArrayType(BinaryType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            numbers: dict[bytes, int] = {}
            out = {f.name: [] for f in schema.fields[1:]}
            for k, text in enumerate(batch.column("text").to_pylist()):
                bare = b"".join(text.encode().split())  # splits at [\x20\x09-\x0D]
                fresh_at, fresh, blocks = len(numbers), [], []
                for at in range(0, len(bare) or 1, block_bytes):
                    block = bare[at : at + block_bytes]
                    number = numbers.setdefault(block, len(numbers))
                    if number == fresh_at + len(fresh):
                        fresh.append(block)
                    blocks.append(number)
                for name, value in zip(out, (first + k, first, len(text), len(blocks), hashlib.sha256(bare).hexdigest(), blocks, fresh_at, fresh)):
                    out[name].append(value)
            first += batch.num_rows
            arrays = [pa.array(out[f.name], _ARROW[type(f.dataType)] if not isinstance(f.dataType, ArrayType) else pa.list_(_ARROW[type(f.dataType.elementType)])) for f in schema.fields[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema.names)

    return rows.mapInArrow(run, schema)


_ARROW = {LongType: pa.int64(), IntegerType: pa.int32(), StringType: pa.string(), BinaryType: pa.binary()}


def _named(distinct: DataFrame, keys: list[str], what: str) -> DataFrame:
    """A whole number for each row of a table of distinct keys: its place when the keys of a partition are sorted."""
    named = distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return common.stored(named, what)


def identities(docs: DataFrame, block_bytes: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, n_points, n_blocks, text_sha256), (identities: row, name)."""
    rows = common.stored(blocked(docs, block_bytes), "blocks")
    documents = rows.select("row", "doc_id", "n_points", "n_blocks", "text_sha256")
    blocks = rows.select("batch", "fresh_at", F.posexplode("fresh").alias("k", "block"))
    at = F.struct("batch", (F.col("fresh_at") + F.col("k")).alias("number"))
    # A block has one place for each batch that holds it, so the list of a block grows with batches, not with rows.
    names = blocks.groupBy("block").agg(F.collect_list(at).alias("at")).sortWithinPartitions("block")
    # The name is given before the list is spread: beside explode in one select it would count places, not blocks.
    names = names.withColumn("name", F.monotonically_increasing_id()).select("name", F.explode("at").alias("at")).select("name", "at.batch", "at.number")
    names = common.stored(names, "block-names")
    places = rows.select("row", "batch", "n_blocks", F.posexplode("blocks").alias("pos", "number"))
    named = common.stored(places.join(names, ["batch", "number"]).select("row", "n_blocks", "pos", "name"), "level")
    done, longest = [], documents.agg(F.max("n_blocks")).first()[0] or 0
    while True:
        done.append(named.where("n_blocks = 1").select("row", "name"))
        if longest <= 1:
            break
        left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = named.where("n_blocks > 1").groupBy("row", "n_blocks", F.expr("pos div 2").alias("pos"))
        # The last name of an odd row has no partner; -1 is no name.
        pairs = pairs.agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        pairs = common.stored(pairs, "pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        named = pairs.join(names, ["a", "b"]).select("row", F.expr("(n_blocks + 1) div 2").cast("int").alias("n_blocks"), "pos", "name")
        named = common.stored(named, "level")
        longest = (longest + 1) // 2
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return documents, found


def groups(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """Every row with doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most characters before the blanks went, then the smallest doc_id, stays.
    """
    documents, found = identities(docs, block_bytes)
    rows = common.stored(documents.join(found, "row"), "identities")
    key = ["n_blocks", "name"]
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = common.stored(rows.groupBy(*key).agg(F.count("*").alias("group_size"), first.alias("best")), "groups")
    out = rows.join(best, key)
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )
