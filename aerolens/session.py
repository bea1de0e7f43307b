"""Session defaults and lineage cutting."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: HotSpot compiles no method of more bytes of code than this; it interprets it, at several times the time.
COMPILED_BYTES = 8000


def compiled(spark: SparkSession) -> None:
    """Have plans whose generated method would be longer run operator by operator, in methods that are compiled.

    Spark's own limit is the longest method there may be, and the formulas of a photo's camera and corners come to three times
    what is compiled. A lower limit of the session is kept.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > COMPILED_BYTES:
        spark.conf.set(limit, str(COMPILED_BYTES))


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "aerolens") -> SparkSession:
    """A session for tests and benches; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))
        .getOrCreate()
    )


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage of a stage that several later jobs read: a Parquet table in the work folder, read back.

    Its readers prune columns and push filters, and lost executors cost no repeated work.
    """
    at = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, which spark.checkpoint.dir names; a local session without it gets its own.

    A cluster has to name one: a machine-local folder dies with its executor and is not seen by the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="aerolens-")
        shared = _LOCAL["dir"]
    return f"{shared}/aerolens-{spark.sparkContext.applicationId}"


_LOCAL: dict[str, str] = {}
_WRITTEN: dict[tuple[str, str], StructType] = {}


def stored(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application to the work folder and read back from there.

    Readers then prune its columns and push filters into the scan, and recompute nothing.
    """
    folder = work_folder(spark)
    name = hashlib.sha1(key.encode()).hexdigest()[:16]
    at = (folder, name)
    if at not in _WRITTEN:
        df = make()
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        _WRITTEN[at] = df.schema
    return spark.read.schema(_WRITTEN[at]).parquet(f"{folder}/{name}")
