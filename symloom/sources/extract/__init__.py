"""Source text to symbols, edges and occurrences.

``extract`` maps ``(path, content)`` to one tagged table, a parser a file;
``symbols``, ``edges`` and ``occurrences`` are its three projections.  Malformed
files give what could be read, never an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.session import ship

from . import braces, python

ROW = (
    "rec string, path string, lang string, kind string, name string, fqn string, signature string, line int, col int, end_line int, end_col int, "
    "visibility string, doc string, edge_type string, src string, dst string, file_dst string, role string, token string"
)
_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ROW.split(", ")])

EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp",
}
#: Walked, but only as files.
UNPARSED = ("mjs", "pyi")
#: Rows that exist as Python values at once.
ROWS = 4096


def language(path: str) -> str:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "unknown")


def parse(path: str, content: str) -> list[dict]:
    """All rows of a file; none of a malformed one."""
    try:
        return list(rows(path, content))
    except python.Malformed:
        return []


def rows(path: str, content: str) -> Iterator[dict]:
    """The rows of a file, one after the other; a malformed one ends in ``Malformed``."""
    lang = language(path)
    if lang == "python":
        return python.rows(path, content)
    return iter(()) if lang == "unknown" else braces.rows(path, content, lang)


def _batches(path: str, content: str) -> list[pa.RecordBatch]:
    """A file's rows in columns, ``ROWS`` at a time; none of a malformed file."""
    out, each = [], rows(path, content)
    try:
        while some := [{"path": path, **r} for r in islice(each, ROWS)]:
            out.append(pa.RecordBatch.from_pylist(some, _ARROW))
    except python.Malformed:
        return []
    return out


def _run(batches):
    for batch in batches:
        # a file at a time: a batch may hold all of a task's files
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield from _batches(path.as_py() or "", content.as_py() or "")


def extract(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(_run, ROW)


def symbols(rows: DataFrame, commit: str = "unknown") -> DataFrame:
    """Symbols with their stable id; same-named ones of a file share it."""
    size = F.lower(F.hex(F.octet_length("name")))
    short = F.concat(F.lit("repo://"), F.lit(commit), F.lit("/"), F.regexp_replace("path", "^/+", ""), F.lit("/#sym("), F.col("lang"), F.lit(":"), F.col("fqn"), F.lit(":"), size, F.lit(")"))
    plain = F.concat(F.col("path"), F.lit("#"), F.col("fqn"))
    sid = F.when(F.col("lang").isin("rust", "java", "c", "cpp"), plain).when(F.col("lang") == "csharp", F.concat(F.lit("csharp_file_"), F.col("path"))).otherwise(short)
    return rows.filter("rec = 'symbol'").select(sid.alias("symbol_id"), "lang", "kind", "name", "fqn", "signature", F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("col").alias("start_col"), "end_line", "end_col", "visibility", "doc")


def edges(rows: DataFrame) -> DataFrame:
    return rows.filter("rec = 'edge'").select("edge_type", "src", "dst", F.col("path").alias("file_src"), "file_dst", F.lit("syntactic").alias("resolution"))


def occurrences(rows: DataFrame) -> DataFrame:
    return rows.filter("rec = 'occurrence'").select(F.col("path").alias("file_path"), "role", F.col("line").alias("start_line"), F.col("col").alias("start_col"), "token")


def resolve_calls(rows: DataFrame) -> DataFrame:
    """Heuristic call edges: an occurrence of a call in a function of the file,
    to a symbol of that name in the same file."""
    s = rows.filter("rec = 'symbol' and kind in ('function', 'method')")
    inside = s.select("path", F.col("fqn").alias("src"), F.col("line").alias("from_line"), "end_line")
    calls = rows.filter("rec = 'occurrence' and role = 'call'").select("path", "line", "token")
    target = s.select("path", F.col("name").alias("token"), F.col("fqn").alias("dst")).distinct()
    hit = calls.join(target, ["path", "token"]).join(inside, "path").filter("line between from_line and end_line")
    # the innermost function that holds the call
    return hit.groupBy("path", "line", "token", "dst").agg(F.max_by("src", "from_line").alias("src")).select(F.lit("calls").alias("edge_type"), "src", "dst", F.lit("heuristic").alias("resolution")).distinct()
