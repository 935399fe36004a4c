"""Batch job: the quality and security report of a code base.

    python -m jobs.code_report --tables DIR --output DIR [--config FILE]

Reads the symbol graph from the tables of a folder and writes

* ``symbols/language=L``: every symbol with its module, callers and callees, the
  symbols that a change of it reaches, complexity and number of issues;
* ``issues/severity=S``: every issue of the rules named in the settings.

A run replaces the report, so reruns give the same files' contents.  What a symbol
in no known file has for a language is ``unknown``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.operators import graph, propagate, rules, stats
from symloom.plans import bridge
from symloom.sources.session import stored

from .common import log, main, settings

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
RULES = {
    "code_smells": lambda symbols, edges: rules.smells(symbols),
    "hardcoded_secrets": lambda symbols, edges: rules.hardcoded_secrets(symbols),
    "missing_auth": rules.missing_auth,
    "command_injection": rules.command_injection,
    "sql_injection": rules.sql_injection_callers,
    "unsafe_deserialization": rules.unsafe_deserialization,
}


def issues_of(symbols: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """``(type, severity, symbol, detail, confidence, cwe)`` of the named rules; symbols
    come with the counts of their calls."""
    if unknown := set(names) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    found = None
    for name in names:
        one = RULES[name](symbols, edges)
        found = one if found is None else found.union(one)
    return found


def symbols_of(calls: DataFrame, files: DataFrame, edges: DataFrame, issues: DataFrame, complex_over: int, depth: int) -> DataFrame:
    up = graph.arcs(edges, ["calls"], reverse=True, bag=True)
    impact = propagate.reach_counts(up, up.select(F.col("dst").alias("node")).distinct(), depth)
    impact = impact.select(F.col("node").alias("fqn"), F.col("reached").alias("impact"))
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in RANK.items()])
    found = issues.groupBy(F.col("symbol").alias("fqn")).agg(F.count(F.lit(1)).alias("issues"), F.max(rank).alias("worst"))
    held = calls.join(files.select(F.col("id").alias("file_id"), "language"), "file_id", "left").join(impact, "fqn", "left").join(found, "fqn", "left")
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return held.select(
        F.coalesce("language", F.lit("unknown")).alias("language"), text.module(F.col("fqn")).alias("module"), "fqn", "kind", zero("n_in"), zero("n_out"), zero("impact"),
        (F.col("n_out") + 1).alias("cyclomatic"), (F.col("n_out") + 1 > complex_over).alias("is_complex"), zero("issues"), zero("worst", "int"),
    )


def run(spark: SparkSession, tables: str, output: str, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write the report; returns the settings and rows written."""
    conf = settings("code_report", given)
    symbols, files = bridge.symbols(spark, tables), bridge.files(spark, tables)
    # all rules are on calls; these and their counts are made once
    edges = stored(graph.arcs(bridge.edges(spark, tables), ["calls"])).withColumn("edge_type", F.lit("calls"))
    symbols = stored(stats.with_fan(symbols, edges, ["calls"], once=True))
    log.info("read the symbol graph of %s", tables)
    issues = issues_of(symbols, edges, conf["rules"])
    # a rebalanced write gives files of the advised size, whatever a language's share
    issues.hint("rebalance", "severity").write.mode("overwrite").partitionBy("severity").parquet(f"{output}/issues")
    written = spark.read.schema(issues.schema).parquet(f"{output}/issues")
    report = symbols_of(symbols, files, edges, written, conf["complex_over"], conf["impact_depth"])
    report.hint("rebalance", "language").write.mode("overwrite").partitionBy("language").parquet(f"{output}/symbols")
    counts = {"issues": written.count(), "symbols": spark.read.schema(report.schema).parquet(f"{output}/symbols").count()}
    log.info("wrote %(symbols)d symbols and %(issues)d issues", counts)
    return conf | counts


if __name__ == "__main__":
    main("code_report", __doc__, ("tables", "output"), run)
