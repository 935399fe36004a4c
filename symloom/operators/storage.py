"""Stored graphs: a folder of Parquet tables, a partition a commit.

``create`` and ``open`` check what they find, ``append`` adds rows as a bag,
``table`` gives the same frame until ``refresh``, ``close`` releases what was
kept.  A store opened for reading takes no rows.  Rows that another application
appends show after ``refresh``.

An append is a set of new files that its commit makes visible at once; there is
no transaction over several tables.  Empty tables are read as such; null columns
are stored; columns that a table does not have are ignored, missing ones are
null; a row appended twice is stored twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schema

TABLES = {"commits": schema.COMMITS, "files": schema.FILES, "symbols": schema.SYMBOLS, "edges": schema.EDGES, "occurrences": schema.OCCURRENCES}
#: Tables that are kept in one piece; the others have a partition a commit.
WHOLE = ("commits",)


class MissingStore(ValueError):
    """A folder that is no store, or a table that lacks columns."""


class Store:
    def __init__(self, spark: SparkSession, folder: str, writable: bool):
        self.spark, self.folder, self.writable = spark, folder.rstrip("/"), writable
        self._kept: dict[str, DataFrame] = {}

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Store:
        """The store in this folder, its missing tables made empty."""
        store = cls(spark, folder, True)
        for name, columns in TABLES.items():
            if not store._exists(name):
                store._write(spark.createDataFrame([], columns), name)
        return cls.open(spark, folder, writable=True)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, writable: bool = False) -> Store:
        """The store in this folder; an error if a table or a column is missing."""
        store = cls(spark, folder, writable)
        gone = [name for name in TABLES if not store._exists(name)]
        if gone:
            raise MissingStore(f"{folder} has no table {', '.join(gone)}")
        for name, columns in TABLES.items():
            try:
                found = set(spark.read.parquet(store.path(name)).columns)
            except AnalysisException as e:  # no row was ever written
                if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                continue
            lacks = [f.name for f in schema.struct(columns) if f.name not in found]
            if lacks:
                raise MissingStore(f"table {name} of {folder} has no column {', '.join(lacks)}")
        return store

    @classmethod
    def open_or_build(cls, spark: SparkSession, folder: str, build: Callable[[Store], None]) -> Store:
        """The store in this folder; if there is none, one that ``build`` fills."""
        try:
            return cls.open(spark, folder)
        except MissingStore:
            if any(cls(spark, folder, False)._exists(name) for name in TABLES):
                raise  # half a store is an error, not a reason to scan
        build(cls.create(spark, folder))
        return cls.open(spark, folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        """All rows of a table; the same frame until ``refresh``."""
        if name not in self._kept:
            self._kept[name] = self.spark.read.schema(TABLES[name]).parquet(self.path(name)).select(*schema.struct(TABLES[name]).names)
        return self._kept[name]

    def keep(self, name: str) -> DataFrame:
        """``table``, its rows kept by the executors until ``refresh`` or ``close``."""
        self._kept[name] = self.table(name).persist()
        return self._kept[name]

    def append(self, name: str, rows: DataFrame) -> None:
        """Add all rows; ``seq`` goes on from the largest stored one, with gaps."""
        if not self.writable:
            raise PermissionError(f"{self.folder} is open for reading")
        fields = {f.name: f.dataType for f in schema.struct(TABLES[name])}
        have = set(rows.columns)
        out = rows.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
        if "seq" in fields:
            top = self.table(name).agg(F.max("seq")).first()[0]  # one number
            out = out.withColumn("seq", F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1))
        self._write(out, name)
        self._forget(name)

    def drop_commits(self, newest: int) -> list[int]:
        """Remove the rows of all but the newest commits; ids of those removed.
        The driver sees ids of commits only."""
        if not self.writable:
            raise PermissionError(f"{self.folder} is open for reading")
        ids = [r[0] for r in self.table("commits").select("commit_id").distinct().orderBy(F.desc("commit_id")).collect()]
        old = sorted(ids[newest:])
        for name in TABLES:
            if name not in WHOLE:
                for i in old:
                    path, fs = self._file(f"{name}/commit_id={i}")
                    fs.delete(path, True)
                self._forget(name)
        return old

    def refresh(self) -> None:
        """Read all tables anew."""
        for name in TABLES:
            self._forget(name)
            self.spark.catalog.refreshByPath(self.path(name))

    def close(self) -> None:
        for name in list(self._kept):
            self._forget(name)
        self.writable = False

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _forget(self, name: str) -> None:
        frame = self._kept.pop(name, None)
        if frame is not None and frame.is_cached:
            frame.unpersist()

    def _write(self, rows: DataFrame, name: str) -> None:
        out = rows.write.mode("append")
        (out if name in WHOLE else out.partitionBy("commit_id")).parquet(self.path(name))

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._file(name)
        return fs.exists(path)


def is_current(commits: DataFrame, sha: str) -> bool:
    """Whether the newest commit is this one, so nothing is to be done."""
    newest = commits.orderBy(F.desc("commit_id")).select("commit_sha").first()
    return newest is not None and newest[0] == sha


def dry_run(files: DataFrame) -> DataFrame:
    """``(files, lines, bytes, errors)`` that a scan would take in; nothing is written."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.count("error").alias("errors"),
    )


def run_languages(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], target: str, commit_id: int, changed: DataFrame | None = None) -> DataFrame:
    """``(language, error)``: each language's rows written as its partition of a
    commit in ``target``; one that fails has an error and leaves the others and
    its own earlier rows alone.

    With ``changed`` (column ``path``) only rows of these files are written anew;
    the language's other rows of the commit before are carried over."""
    outcome = []
    for language, source in sources.items():
        try:
            rows = source()
            if changed is not None:
                rows = _carried(spark, target, language, commit_id - 1, changed, rows)
            rows.withColumn("lang", F.lit(language)).withColumn("commit_id", F.lit(commit_id).cast("long")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("commit_id", "lang").parquet(target)
            outcome.append((language, None))
        except Exception as e:  # whatever a language's indexer or parser raises
            outcome.append((language, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return spark.createDataFrame(outcome, "language string, error string")


def _carried(spark: SparkSession, target: str, language: str, before: int, changed: DataFrame, rows: DataFrame) -> DataFrame:
    paths = changed.select(F.col("path").alias("file_path")).distinct()
    new = rows.join(paths, "file_path", "left_semi").select(*rows.columns)
    try:
        old = spark.read.parquet(target)
    except AnalysisException as e:  # the first commit
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return new
    old = old.filter((F.col("commit_id") == before) & (F.col("lang") == language)).join(paths, "file_path", "left_anti")
    return old.select(*rows.columns).unionByName(new)
