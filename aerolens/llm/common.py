"""What the training-data operators share: words, the folds of a table, and tables written to the shared work folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Tables of at most so many rows may be sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="aerolens-llm-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the work folder and read back: later readers neither repeat the work nor depend on lost executors."""
    at = f"{folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if it has few rows, else to be merged: Spark's own guess goes by bytes on disk."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """So many partitions that each has about `each` rows, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))
