"""Counts, roll-ups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import text

from .graph import arcs


def by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def by_edge_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def by_type_and_resolution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type", "resolution").agg(F.count(F.lit(1)).alias("n"))


def totals(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one(files, "files").union(one(symbols, "symbols")).union(one(edges, "edges"))


def distinct_files(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct("path").alias("n"))


def fan(edges: DataFrame, types: list[str] | None = None, once: bool = False) -> DataFrame:
    """``(fqn, n_out, n_in)``: distinct neighbours of every end of an edge; ``once`` says
    that no two edges of the types have the same ends."""
    pairs = arcs(edges, types, bag=once)
    out = pairs.groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("n_out"))
    back = pairs.groupBy(F.col("dst").alias("fqn")).agg(F.count(F.lit(1)).alias("n_in"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.join(back, "fqn", "full").select("fqn", zero("n_out"), zero("n_in"))


def with_fan(symbols: DataFrame, edges: DataFrame, types: list[str] | None = None, once: bool = False) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = symbols.join(fan(edges, types, once), "fqn", "left")
    return joined.withColumn("n_out", zero("n_out")).withColumn("n_in", zero("n_in"))


def centrality(symbols: DataFrame, edges: DataFrame, over: int = 2) -> DataFrame:
    """Symbols with more than ``over`` distinct neighbours, out plus in."""
    return with_fan(symbols, edges).select("fqn", "name", (F.col("n_out") + F.col("n_in")).alias("degree")).filter(F.col("degree") > over)


def file_summary(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file: its symbols, and the edges that touch one of them, once each.

    An edge knows the files of both its ends, so no table of files and edges is made
    distinct."""
    own = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("fqn", "path")
    of = lambda end: own.groupBy(F.col("fqn").alias(end)).agg(F.collect_set("path").alias(f"{end}_paths"))
    held_by = lambda end: F.coalesce(f"{end}_paths", F.array().cast("array<string>"))
    ends = edges.select("src", "dst").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    touched = ends.select(F.explode(F.array_union(held_by("src"), held_by("dst"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("edge_count"))
    held = own.groupBy("path").agg(F.count(F.lit(1)).alias("symbol_count"))
    return held.join(touched, "path", "left").select("path", "symbol_count", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"))


def file_kinds(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def code_summary(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file: names of its classes and functions, complexity of its functions."""
    s = with_fan(symbols, edges, ["calls"]).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    is_function = F.col("kind") == "function"
    cyclomatic = F.when(is_function, F.col("n_out") + 1)
    return s.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "class", F.col("name")))).alias("main_classes"),
        F.sort_array(F.collect_list(F.when(is_function, F.col("name")))).alias("main_functions"),
        F.coalesce(F.sum(cyclomatic), F.lit(0)).cast("long").alias("total_complexity"),
        F.coalesce(F.avg(cyclomatic), F.lit(0.0)).alias("average_complexity"),
    )


def module_dependencies(edges: DataFrame, of: Column | None = None) -> DataFrame:
    """``(src_module, dst_module)`` of imports, itself left out."""
    name = text.module if of is None else of
    pairs = arcs(edges, ["imports"]).select(name(F.col("src")).alias("src_module"), name(F.col("dst")).alias("dst_module"))
    return pairs.filter("src_module <> dst_module").distinct()


def report(symbols: DataFrame, edges: DataFrame, callers: int = 1, callees: int = 10) -> DataFrame:
    """Functions that look like entries, and those with many callees."""
    f = with_fan(symbols, edges, ["calls"]).filter(F.col("kind") == "function")
    entry = f.filter(F.col("n_in") <= callers).select(F.lit("entry_point").alias("what"), "fqn", F.col("n_in").alias("n"))
    return entry.union(f.filter(F.col("n_out") > callees).select(F.lit("complex_function").alias("what"), "fqn", F.col("n_out").alias("n")))


def overview(symbols: DataFrame, files: DataFrame, edges: DataFrame, closed: DataFrame, cycles: int = 10, entries: int = 20, complex_: int = 10) -> DataFrame:
    """``(what, subject, n)``: totals, symbols by kind, edges by type, the first
    cycles of ``closed`` with their lengths, the first functions with at most one
    caller, and those with the most callees."""
    row = lambda df, what, subject, n: df.select(F.lit(what).alias("what"), F.col(subject).alias("subject"), F.col(n).cast("long").alias("n"))
    f = report(symbols, edges)
    listed = closed.select(F.array_join("cycle", ">").alias("cycle"), (F.size("cycle") - 1).alias("n")).orderBy("cycle").limit(cycles)
    return (
        row(totals(symbols, files, edges), "total", "what", "n")
        .union(row(by_kind(symbols), "kind", "kind", "n"))
        .union(row(by_edge_type(edges), "edge_type", "edge_type", "n"))
        .union(row(listed, "cycle", "cycle", "n"))
        .union(row(f.filter("what = 'entry_point'").orderBy("fqn").limit(entries), "entry_point", "fqn", "n"))
        .union(row(f.filter("what = 'complex_function'").orderBy(F.desc("n"), "fqn").limit(complex_), "complex_function", "fqn", "n"))
    )


def throughput(files: DataFrame, seconds: float, size: str = "size_bytes") -> DataFrame:
    """One row: totals, rates (null for no time) and a rating."""
    n = F.count(F.lit(1))
    rate = F.try_divide(n.cast("double"), F.lit(float(seconds)))
    out = files.agg(n.alias("files"), F.sum(size).alias("bytes"), rate.alias("files_per_second"))
    return out.withColumn("rating", F.when(F.col("files_per_second") > 10, "high").when(F.col("files_per_second") > 1, "moderate").otherwise("low"))
