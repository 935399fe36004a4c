"""Incremental job: a full-text index of a growing folder of documents.

    python -m jobs.index_documents --documents DIR --output DIR --checkpoint DIR [--config FILE]

``DIR`` is a folder, or a pattern of folders and files.  A file stream takes the
Parquet files that its checkpoint does not know yet, all
that are there now, and ends.  Each of its batches extends the index
(``symloom.operators.text_index``) under a folder of the batch's number: a batch
that was cut off is run again by Spark with the same files and replaces its own
folder, so no file counts twice or is lost.  A document that comes again replaces
its former version.  With nothing new nothing is written.  Files are known by their
paths: write changed documents to new files.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from symloom.operators import text_index

from .common import log, main, settings


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Index what is new; returns the settings, batches and rows taken."""
    conf = settings("index_documents", given)
    taken: dict[int, int] = {}

    def take(rows: DataFrame, batch: int) -> None:
        text_index.extend(rows, output, batch, conf["key"], conf["text"], buckets=conf["buckets"])
        taken[batch] = spark.read.parquet(f"{output}/docs/batch={batch}").count()
        log.info("batch %d: indexed %d documents", batch, taken[batch])

    schema = spark.read.parquet(documents).select(conf["key"], conf["text"]).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_per_batch"]).parquet(documents)
    log.info("reading new files of %s", documents)
    query = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("took %d documents in %d batches", sum(taken.values()), len(taken))
    return conf | {"batches": len(taken), "documents": sum(taken.values())}


if __name__ == "__main__":
    main("index_documents", __doc__, ("documents", "output", "checkpoint"), run)
