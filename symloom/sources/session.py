"""Where iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that an operator of many rounds still broadcasts.
SMALL = 1 << 20
#: Bytes of a shuffle's partition, compressed, where its rows are mostly zeros.
PART = 4 << 20

_local: list[str] = []
_shipped: set[str] = set()


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


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a temporary one if none is."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="symloom-"))
            atexit.register(shutil.rmtree, _local[0], True)
        named = _local[0]
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint that outlives any executor."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a written table.  Unlike a checkpoint, which keeps the
    estimate of its plan, it is planned by its true size: a table joined with itself
    round by round would square that estimate each time."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dealt(spark: SparkSession, tasks: int) -> Iterator[None]:
    """What runs inside shuffles into so many partitions at least.  Adaptive execution
    joins small ones up to ``PART`` bytes only: it goes by their size as files, which for
    rows that are mostly zeros is a small part of what they take in memory."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], max(int(before[names[0]]), tasks))
    spark.conf.set(names[1], str(PART))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def few_broadcasts(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, with only ``SMALL`` tables broadcast while it runs: a broadcast passes
    through the driver, and one a join and round adds up."""
    name = "spark.sql.autoBroadcastJoinThreshold"

    @wraps(operator)
    def run(pairs: DataFrame, *args, **more) -> DataFrame:
        conf = pairs.sparkSession.conf
        before = {k: conf.get(k, None) for k in (name, "spark.sql.adaptive.autoBroadcastJoinThreshold")}
        # a bound of the user's own that is lower stays
        own = conf.get(name)
        if not own.lstrip("-").isdigit() or int(own.lstrip("-") or 0) > SMALL and not own.startswith("-"):
            conf.set(name, str(SMALL))
            conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(SMALL))
        try:
            return operator(pairs, *args, **more)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    return run
