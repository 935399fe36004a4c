"""Counts kept up to date from what a commit changes, without reading the rest.

A commit replaces the edges of some files: what these held counts -1, what they hold
now +1.  Four tables of sums follow, each from its state before and the signed rows:

* ``pairs`` ``(src, dst, edge_type, n)``: edges of a kind between two symbols;
* ``types`` ``(edge_type, n)``: edges by kind;
* ``degrees`` ``(node, n)``: distinct neighbours, out plus in;
* ``modules`` ``(src_module, dst_module, n)``: import pairs between modules.

Distinct counts change only where a sum leaves or reaches 0 (``transitions``), so they
need no rows but those that the commit touches.  A commit writes folders of its own
from those of the commit before it; writing it again gives the same tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import text

KEYS = {"pairs": ["src", "dst", "edge_type"], "types": ["edge_type"], "degrees": ["node"], "modules": ["src_module", "dst_module"]}
_SCHEMA = {name: ", ".join(f"{k} string" for k in keys) + ", n long" for name, keys in KEYS.items()}


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(src, dst, edge_type, n)``: -1 a row before and +1 a row after; edges without
    both ends count nowhere."""
    one = lambda df, n: df.select("src", "dst", "edge_type", F.lit(n).cast("long").alias("n"))
    return one(old, -1).union(one(new, 1)).filter("src is not null and dst is not null")


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sums of ``changes``, a row a pair and kind."""
    return summed(changes(old, new), KEYS["pairs"])


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def transitions(before: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """+1 for every key whose sum rises above 0 by the delta, -1 for one that falls to
    it; only keys of the delta are looked up."""
    held = delta.join(before.withColumnRenamed("n", "_n"), keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    step = (F.col("_n") + F.col("n") > 0).cast("long") - (F.col("_n") > 0).cast("long")
    return held.select(*keys, step.alias("n")).filter("n <> 0")


def read(spark: SparkSession, path: str, name: str, commit: int) -> DataFrame:
    """A table as of a commit; empty before the first."""
    try:
        return spark.read.schema(_SCHEMA[name]).parquet(f"{path}/{name}/commit={commit}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA[name])


def update(spark: SparkSession, path: str, commit: int, old: DataFrame, new: DataFrame, tables: Iterable[str] = tuple(KEYS)) -> None:
    """Write the tables of a commit that replaces the edges ``old`` by ``new``, from
    those of the commit before.

    Of ``tables`` alone, where not all are followed (the same ones in every commit);
    ``degrees`` and ``modules`` bring ``pairs`` with them, ``types`` needs no other."""
    tables = set(tables)
    if unknown := tables - set(KEYS):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if tables & {"degrees", "modules"}:
        tables.add("pairs")

    def write(name: str, delta: DataFrame) -> None:
        total = summed(read(spark, path, name, commit - 1).union(delta.select(*KEYS[name], "n")), KEYS[name])
        total.write.mode("overwrite").parquet(f"{path}/{name}/commit={commit}")

    if tables == {"types"}:  # a few sums: no row a pair is made
        return write("types", summed(changes(old, new), KEYS["types"]))
    delta = signed(old, new).cache()  # the touched rows, used by every table
    try:
        before = read(spark, path, "pairs", commit - 1)
        if "pairs" in tables:
            write("pairs", delta)
        if "types" in tables:
            write("types", summed(delta, ["edge_type"]))
        # neighbours of any kind: sums over kinds, of the touched pairs alone
        ends = ["src", "dst"]
        if "degrees" in tables:
            near = transitions(summed(before.join(delta.select(*ends).distinct(), ends, "left_semi"), ends), summed(delta, ends), ends)
            write("degrees", summed(near.select(F.explode(F.array("src", "dst")).alias("node"), "n"), ["node"]))
        # import pairs between modules, each pair of symbols once
        if "modules" in tables:
            imports = lambda df: df.filter("edge_type = 'imports'").select(*ends, "n")
            linked = transitions(imports(before).join(imports(delta).select(*ends).distinct(), ends, "left_semi"), imports(delta), ends)
            modules = linked.select(text.module(F.col("src")).alias("src_module"), text.module(F.col("dst")).alias("dst_module"), "n").filter("src_module <> dst_module")
            write("modules", summed(modules, KEYS["modules"]))
    finally:
        delta.unpersist()


def follow(changes: DataFrame, path: str, checkpoint: str):
    """Start a stream of signed edges ``(src, dst, edge_type, sign)`` over what is
    there now; each of its batches is a commit, from 1."""

    def take(rows: DataFrame, batch: int) -> None:
        update(rows.sparkSession, path, batch + 1, rows.filter("sign < 0"), rows.filter("sign > 0"))

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
