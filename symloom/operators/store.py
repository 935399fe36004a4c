"""Snapshots: get-or-create, upsert, slice deletion, diffs and closures.

Tables are immutable frames; a changed snapshot is a new one.  Rows carry a
``seq`` that grows with insertion, so "the later row replaces" is a maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import file_dependents


def get_or_create_commit(commits: DataFrame, sha: str, now: int | None = None) -> DataFrame:
    """The commits with this one; unchanged if it is there."""
    spark = commits.sparkSession
    ts = F.unix_timestamp() if now is None else F.lit(now)
    new = spark.createDataFrame([(sha,)], "commit_sha string").join(commits.select("commit_sha"), "commit_sha", "left_anti")
    top = commits.agg(F.coalesce(F.max("commit_id"), F.lit(0)).alias("top"))
    return commits.unionByName(new.crossJoin(F.broadcast(top)).select((F.col("top") + 1).alias("commit_id"), "commit_sha", ts.cast("long").alias("ts")))  # one row


def upsert(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def delete_slice(symbols: DataFrame, edges: DataFrame, occurrences: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the files ``(commit_id, path)`` removed; an edge goes with either file."""
    by = lambda c: changed.select("commit_id", F.col("path").alias(c)).distinct()
    left = edges.join(by("file_src"), ["commit_id", "file_src"], "left_anti").join(by("file_dst"), ["commit_id", "file_dst"], "left_anti")
    gone = lambda df: df.join(by("file_path"), ["commit_id", "file_path"], "left_anti").select(*df.columns)
    return gone(symbols), left.select(*edges.columns), gone(occurrences)


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths that are new or whose hash differs."""
    old = stored.select("path", F.col("content_hash").alias("old_hash"))
    return now.join(old, "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old_hash"))).select("path")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)``: added, modified or removed."""
    a, b = old.select("path", F.col("content_hash").alias("h0"), F.lit(True).alias("in0")), new.select("path", F.col("content_hash").alias("h1"), F.lit(True).alias("in1"))
    both = a.join(b, "path", "full")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def dirty_closure(changed: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Changed files and the files that depend on them, one hop."""
    near = file_dependents(file_edges).join(changed.select(F.col("path").alias("file_dst")), "file_dst", "left_semi").select(F.col("file_src").alias("path"))
    return changed.select("path").union(near).distinct()


def next_snapshot(previous: DataFrame, diff: DataFrame, extracted: DataFrame, path: str = "file_path") -> DataFrame:
    """Unchanged files' rows carried over, changed files' rows replaced."""
    gone = diff.select(F.col("path").alias(path)).distinct()
    return previous.join(gone, path, "left_anti").select(*previous.columns).unionByName(extracted)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace only the commits that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_id").parquet(path)
