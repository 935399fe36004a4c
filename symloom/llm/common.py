"""Session plumbing shared by the training-data operators.

Nothing here holds rows on the driver.  Intermediate tables go to the folder
that the session names in ``spark.checkpoint.dir``; a temporary folder is used
only where that setting is missing (single-machine tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
ARROW_ROWS = 1024
ARROW_BYTES = 8 << 20

_local: list[str] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; sets a temporary one only if none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="symloom-"))
        atexit.register(shutil.rmtree, _local[0], True)
    sc.setCheckpointDir(_local[0])
    return _local[0]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="symloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, package.name), "zip", package.parent, package.name))


def tune(spark: SparkSession) -> None:
    """Ship the code; keep Arrow batches small, so long texts cannot fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    shared_dir(spark)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
