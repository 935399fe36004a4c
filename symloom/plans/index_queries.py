"""Queries of the stored text index and of hybrid search, and their oracles.

An index is built once an application and folder and kept, as a user would; a query
then reads the buckets of its terms.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import graph, hybrid, text_index, vectors
from symloom.operators.search import tokenise
from symloom.sources.session import scratch

from . import bridge
from .bridge import ORACLE

TERMS = ("red", "widget", "query")
DOC_TERMS = ("are", "que", "ther")

_built: dict[tuple[str, str, str], Any] = {}


def kept(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str, str], None], opened: Callable[[SparkSession, str], Any] = text_index.Index) -> Any:
    """An open index, built at its first use."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        path = scratch(spark, name)
        build(spark, sf, path)
        _built[key] = opened(spark, path)
    return _built[key]


def _symbols(spark: SparkSession, sf: str, path: str) -> None:
    s = bridge.symbols(spark, sf)
    text_index.extend(s.select("id", F.concat_ws(" ", "name", "docstring").alias("text")), path, 0)


def _versions(spark: SparkSession, sf: str, path: str) -> None:
    """The documents as versions of files, a batch a commit (see ``bridge.snapshots``);
    the last commit's versions replace earlier ones of their paths."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = bridge.snapshots(spark, sf).join(d.withColumnRenamed("doc_id", "seq"), "seq").withColumn("commit_id", F.coalesce("commit_id", F.lit(0).cast("long")))
    commits = sorted(r[0] for r in rows.select("commit_id").distinct().collect())  # a row a commit
    for c in commits:
        last = rows.filter(F.col("commit_id") == c).groupBy("path").agg(F.max_by("text", "seq").alias("text"))
        text_index.extend(last, path, c, key="path")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = kept(spark, sf, "symbol-index", _symbols).topk(list(TERMS), 20)
    return found.select(F.col("doc").alias("id"), "score")


def bm25_topk_versions(spark: SparkSession, sf: str) -> DataFrame:
    found = kept(spark, sf, "version-index", _versions).topk(list(DOC_TERMS), 20)
    return found.select(F.col("doc").alias("path"), "score")


def _vectors(spark: SparkSession, sf: str, path: str) -> None:
    vectors.build(spark.read.parquet(f"{sf}/embeddings.parquet"), path, "vec_id", "embedding")


def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every vector whose id 20 divides, among all vectors."""
    asked = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return kept(spark, sf, "vector-index", _vectors, vectors.Index).knn(asked, 10)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Ten symbols like each of those whose id 20 divides: a symbol is its vector,
    its words and its calls."""
    s = bridge.symbols(spark, sf)
    asked = s.filter("id % 20 = 0").select(F.col("id").alias("q"), F.col("fqn").alias("node"), F.concat_ws(" ", "name", "docstring").alias("text"))
    held = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    terms = asked.select("q", F.explode(F.array_distinct(tokenise(F.col("text")))).alias("term"))
    pairs = graph.arcs(bridge.edges(spark, sf), ["calls"])
    return hybrid.search(
        asked.join(held, "q", "left").select("q", "vector", "node"), terms, s.select("id", F.col("fqn").alias("node")), pairs,
        kept(spark, sf, "vector-index", _vectors, vectors.Index), kept(spark, sf, "symbol-index", _symbols),
    )


QUERIES = {"bm25_topk_versions": lambda g: bm25_topk_versions(g.spark, g.sf), "vector_knn": lambda g: vector_knn(g.spark, g.sf), "hybrid_search": lambda g: hybrid_search(g.spark, g.sf)}

ORACLES = {
    "bm25_topk_versions": ORACLE + r""", live AS (SELECT path, arg_max(text, (coalesce(commit_id, 0), seq)) AS text FROM snapshots JOIN documents ON doc_id = seq GROUP BY path),
words AS (SELECT path, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS w FROM live),
c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words), each AS (SELECT path, len(w) AS dl, unnest(w) AS term FROM words),
tf AS (SELECT path, dl, term, count(*) AS tf FROM each WHERE term IN ('are', 'que', 'ther') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term), c GROUP BY path ORDER BY score DESC, path LIMIT 20""",
}
