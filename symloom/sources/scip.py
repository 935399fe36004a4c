"""SCIP index documents to symbols, edges and occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "metadata struct<tool_info:struct<name:string,version:string>,project_root:string,text_document_encoding:int>, "
    "documents array<struct<relative_path:string,"
    "symbols:array<struct<symbol:string,documentation:array<string>,relationships:array<struct<symbol:string,is_implementation:boolean,is_reference:boolean>>>>,"
    "occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int,enclosing_range:array<int>>>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row an index file (JSON, one document or pretty-printed)."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def _each(index: DataFrame, rows: str, *columns: Column) -> DataFrame:
    """``columns`` of a document (as ``d``, with ``metadata``) and an item of its array
    ``rows`` a row.  The scalars are taken before the array is opened: a row that still
    held its document would copy the whole of it for every item."""
    d = index.select("metadata", F.explode("documents").alias("d"))
    return d.select(*columns, F.col(f"d.{rows}").alias("_all")).select("*", F.explode("_all").alias(rows[0])).drop("_all")


def symbols(index: DataFrame, commit: str = "unknown", strict_kinds: bool = False) -> DataFrame:
    """Symbols with a descriptor (five parts or more).

    ``strict_kinds`` tells methods from classes; otherwise any ``#`` is a class."""
    s = _each(index, "symbols", F.col("d.relative_path").alias("file_path")).select("file_path", F.col("s.symbol").alias("raw"), F.col("s.documentation").alias("documentation"))
    parts = F.filter(F.split("raw", r"\s+"), lambda x: x != "")
    s = s.withColumn("parts", parts).filter(F.size("parts") >= 5).withColumn("descriptor", F.element_at("parts", -1))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("descriptor", r"\.+$", ""), r"(?:\(\))+$", ""), r"#+$", "")
    name = F.element_at(F.split(bare, "/"), -1)
    d = F.col("descriptor")
    kind = F.when(F.contains(d, F.lit("#")), "class").when(F.contains(d, F.lit("().")), "function").when(F.endswith(d, F.lit("()")), "method").otherwise("variable")
    if strict_kinds:
        kind = F.when(d.rlike(r"#[^#]+\(\)\.?$"), "method").otherwise(kind)
    stem = F.regexp_replace("file_path", r"\.ts$", "")
    s = s.withColumn("name", name).withColumn("fqn", F.concat(stem, F.lit("."), name)).withColumn("sig_hash", F.lower(F.hex(F.octet_length(name))))
    sid = F.concat(F.lit("repo://"), F.lit(commit), F.lit("/"), F.regexp_replace("file_path", "^/+", ""), F.lit("/#sym(typescript:"), F.col("fqn"), F.lit(":"), F.col("sig_hash"), F.lit(")"))
    return s.select(sid.alias("symbol_id"), F.lit("typescript").alias("lang"), kind.alias("kind"), "name", "fqn", "file_path", F.array_join("documentation", "\n").alias("doc"), "sig_hash", "raw")


def edges(index: DataFrame) -> DataFrame:
    """Relationships: implements or calls, between raw symbols."""
    source = F.concat_ws("@", "metadata.tool_info.name", "metadata.tool_info.version")
    s = _each(index, "symbols", F.col("d.relative_path").alias("file_src"), source.alias("source"))
    r = s.select("source", "file_src", F.col("s.symbol").alias("src"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.coalesce("r.is_implementation", F.lit(False)), "implements").otherwise("calls")
    return r.select(kind.alias("edge_type"), "src", F.col("r.symbol").alias("dst"), "file_src", F.lit("semantic").alias("resolution"), F.create_map(F.lit("source"), F.col("source")).alias("provenance"))


def occurrences(index: DataFrame) -> DataFrame:
    """Occurrences with a range of three or four numbers."""
    o = _each(index, "occurrences", F.col("d.relative_path").alias("file_path"))
    n, r = F.size("o.range"), F.col("o.range")
    role = F.coalesce("o.symbol_roles", F.lit(2))
    return o.filter(n.isin(3, 4)).select(
        "file_path",
        F.col("o.symbol").alias("symbol_id"),
        F.when(role == 1, "definition").when(role == 4, "write").otherwise("reference").alias("role"),
        r[0].alias("start_line"),
        r[1].alias("start_col"),
        F.when(n == 3, r[0]).otherwise(r[2]).alias("end_line"),
        F.when(n == 3, r[2]).otherwise(F.try_element_at(r, F.lit(4))).alias("end_col"),
        F.lit("").alias("token"),
    )


def keep_changed(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose path holds a changed path (a driver's list, usually short)."""
    return rows.join(changed.select(F.col("path").alias("_p")), F.expr("contains(file_path, _p)"), "left_semi")


def upgrade(edges_: DataFrame, symbols_: DataFrame, dst: str = "dst") -> DataFrame:
    """Syntactic edges whose target text is a stored name become semantic."""
    known = symbols_.groupBy(F.col("fqn").alias(dst)).agg(F.max_by("symbol_id", "seq").alias("_id"))
    hit = F.col("_id").isNotNull() & (F.col("resolution") == "syntactic")
    new = {dst: F.when(hit, F.col("_id")).otherwise(F.col(dst)), "resolution": F.when(hit, "semantic").otherwise(F.col("resolution")), "resolved_by": F.when(hit, "scip")}
    return edges_.join(known, dst, "left").withColumns(new).drop("_id")
