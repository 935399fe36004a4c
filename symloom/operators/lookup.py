"""Point lookups, filters and scans over the views ``symbols files edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_path(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path (symbols without a file drop out)."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def by_id(symbols: DataFrame, symbol_id) -> DataFrame:
    return symbols.filter(F.col("id") == symbol_id).orderBy("id").limit(1)


def by_fqn(symbols: DataFrame, fqn: str, order: str = "id") -> DataFrame:
    """The newest row of the name (largest ``order``)."""
    return symbols.filter(F.col("fqn") == fqn).orderBy(F.desc(order)).limit(1)


def latest_by_fqn(symbols: DataFrame, order: str = "id") -> DataFrame:
    """The newest row of every name."""
    newest = symbols.groupBy("fqn").agg(F.max_by(F.struct(*symbols.columns), F.col(order)).alias("s"))
    return newest.select("s.*")


def find(symbols: DataFrame, pattern: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Names that hold the pattern, in any case; ``%`` and ``_`` are wildcards."""
    found = symbols.filter(F.col("name").ilike(f"%{pattern}%"))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    return found if limit is None else found.orderBy("id").limit(limit)


def in_file(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return with_path(symbols, files).filter(F.col("path") == path).orderBy("line", "column", "id")


def edges_of(edges: DataFrame, fqn: str) -> DataFrame:
    """Outgoing, then incoming edges; a self-loop comes twice."""
    out = edges.filter(F.col("src") == fqn).withColumn("direction", F.lit("out"))
    return out.unionAll(edges.filter(F.col("dst") == fqn).withColumn("direction", F.lit("in")))


def filter_edges(edges: DataFrame, source: str = "", target: str = "", edge_type: str = "") -> DataFrame:
    """An empty argument does not filter."""
    for column, value in (("src", source), ("dst", target), ("edge_type", edge_type)):
        if value:
            edges = edges.filter(F.col(column) == value)
    return edges


def latest_commit(commits: DataFrame) -> DataFrame:
    return commits.agg(F.max_by("commit_sha", F.struct("ts", "commit_id")).alias("commit_sha"))


def file_hash(files: DataFrame, commits: DataFrame, sha: str, path: str) -> DataFrame:
    return files.join(commits.filter(F.col("commit_sha") == sha).select("commit_id"), "commit_id").filter(F.col("path") == path).select("content_hash")


def files_in_commit(files: DataFrame, commits: DataFrame, sha: str) -> DataFrame:
    return files.join(commits.filter(F.col("commit_sha") == sha).select("commit_id"), "commit_id").select("path", "content_hash")


def sql(spark: SparkSession, views: dict[str, DataFrame], text: str, args: list | dict | None = None) -> DataFrame:
    """Free SQL over the views, with positional or named parameters."""
    return spark.sql(text, args, **views) if _formats(text, views) else _registered(spark, views, text, args)


def _formats(text: str, views: dict[str, DataFrame]) -> bool:
    return any("{" + name + "}" in text for name in views)


def _registered(spark: SparkSession, views: dict[str, DataFrame], text: str, args) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args)
