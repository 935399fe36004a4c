"""Snapshots maintained from a stream of changed files.

Each micro-batch of ``(path, content)`` files is extracted; the slices of its
paths are replaced in the current snapshot, all other rows are carried over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import store
from symloom.sources import extract


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of text files, each a row."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def apply_batch(batch: DataFrame, target: str, commit_id: int) -> None:
    """Write snapshot ``commit_id`` of the symbols: the one before, with the
    batch's files replaced.  A batch that runs twice gives the same snapshot."""
    spark = batch.sparkSession
    new = extract.symbols(extract.extract(batch)).withColumn("commit_id", F.lit(commit_id).cast("long"))
    try:
        before = spark.read.parquet(target).filter(F.col("commit_id") == commit_id - 1).withColumn("commit_id", F.lit(commit_id).cast("long"))
    except Exception as e:  # the first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        before = new.limit(0)
    store.write_snapshot(store.next_snapshot(before.select(*new.columns), batch.select("path"), new), target)


def run(files: DataFrame, target: str, checkpoint: str):
    """Start the stream over what is there now (``availableNow``)."""
    return files.writeStream.foreachBatch(lambda df, i: apply_batch(df, target, i + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
