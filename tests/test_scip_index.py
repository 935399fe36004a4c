"""The index that the SCIP queries read: no row grows with a file's symbols."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from symloom.plans import ingest_queries
from symloom.sources import scip


def test_a_large_file_is_many_documents(spark):
    n = 3000
    fqn = F.concat(F.lit("pkg1::f"), F.col("id").cast("string"))
    symbols = spark.range(n).select("id", F.lit(1).cast("long").alias("file_id"), fqn.alias("fqn"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("function").alias("kind"), F.lit(3).alias("line"), F.lit(4).alias("column"), F.lit("d").alias("docstring"))
    to = F.concat(F.lit("pkg1::f"), ((F.col("id") + 1) % n).cast("string"))
    edges = spark.range(n).select("id", fqn.alias("src"), to.alias("dst"), F.lit("calls").alias("edge_type"))
    files = spark.createDataFrame([(1, "src/a.py")], "id long, path string")
    index = ingest_queries.scip_index(SimpleNamespace(symbols=symbols, edges=edges, files=files))
    held = index.select(F.size(F.col("documents")[0]["symbols"]).alias("n")).collect()
    assert sum(r["n"] for r in held) == n and max(r["n"] for r in held) < 2 * ingest_queries.DOCUMENT
    assert scip.symbols(index).select("fqn").distinct().count() == n
    assert scip.edges(index).select("src", "dst", "file_src").distinct().count() == n
    assert scip.occurrences(index).count() == n
