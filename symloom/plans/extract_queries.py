"""Queries of the extractors, over sources that Spark writes from the symbol graph.

Every file of ``bridge`` becomes a source in each language: its functions, methods
and classes in the order of their ids, three lines each, a function calling the
smallest name among its callees.  So the extractors must give the graph back, and
the oracles state names, places and calls from the tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.sources import extract

from .bridge import ORACLE


class Form(NamedTuple):
    """How a language writes a declaration (three lines) and a call; ``head`` and
    ``tail`` stand around a file's declarations (``{file}``: the file's name)."""

    ending: str
    head: tuple[str, ...]
    function: tuple[str, str, str]
    klass: tuple[str, str, str]
    kinds: tuple[str, str]
    fqn: str
    body: str = "{callee}()"
    tail: str = ""
    also: str | None = None


FORMS = {
    "python": Form("py", (), ("def {name}():", "    {body}", ""), ("class {name}:", "    pass", ""), ("function", "class"), "'src.' || file || '.' || name"),
    "typescript": Form("ts", (), ("export function {name}() {{", "  {body};", "}}"), ("class {name} {{", "", "}}"), ("function", "class"), "'src/' || file || '/' || name"),
    "go": Form("go", ("package pkg",), ("func {name}() {{", "\t{body}", "}}"), ("type {name} struct {{", "", "}}"), ("function", "class"), "'src.' || name"),
    "rust": Form("rs", (), ("fn {name}() {{", "    {body};", "}}"), ("struct {name} {{", "", "}}"), ("function", "struct"), "name"),
    "java": Form("java", ("package com.x;", "class Of_{file} {{"), ("  void {name}() {{", "    {body};", "  }}"), ("  class {name} {{", "", "  }}"), ("method", "class"), "'com.x.Of_' || file || '.' || name", tail="}}", also="'com.x.Of_' || file"),
    "cpp": Form("cpp", (), ("void {name}() {{", "  {body};", "}}"), ("class {name} {{", "", "}};"), ("function", "class"), "name"),
}


def _text(form: str, **parts: Column) -> Column:
    """The form with columns in its braces."""
    plain = form.replace("{{", "\0").replace("}}", "\1")
    out: list[Column] = []
    while plain:
        before, brace, rest = plain.partition("{")
        out.append(F.lit(before.replace("\0", "{").replace("\1", "}")))
        name, _, plain = rest.partition("}") if brace else ("", "", "")
        if brace:
            out.append(parts[name])
    return F.concat(*out) if out else F.lit("")


def sources(g, language: str) -> DataFrame:
    """``(path, content)``, a row a file of the graph."""
    form = FORMS[language]
    name = F.split_part(F.col("dst"), F.lit("::"), F.lit(2))
    callee = g.edges.filter("edge_type = 'calls'").groupBy(F.col("src").alias("fqn")).agg(F.min(name).alias("callee"))
    s = g.symbols.filter("kind <> 'variable'").join(callee, "fqn", "left")
    call = F.when(F.col("callee").isNotNull(), _text(form.body, callee=F.col("callee"))).otherwise("pass" if language == "python" else "")
    lines = lambda three: F.array(*[_text(x, name=F.col("name"), body=call) for x in three])
    one = F.array_join(F.when(F.col("kind") == "class", lines(form.klass)).otherwise(lines(form.function)), "\n")
    held = s.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", one.alias("text")))).alias("all"))
    file = F.concat(F.lit("file"), F.col("file_id").cast("string"))
    parts = [*[F.array(_text(x, file=file)) for x in form.head], F.col("all.text"), *([F.array(_text(form.tail))] if form.tail else [])]
    return held.select(F.concat(F.lit("src/"), file, F.lit(f".{form.ending}")).alias("path"), F.array_join(F.concat(*parts), "\n").alias("content"))


def _facts(rows: DataFrame) -> DataFrame:
    """Symbols and calls as ``(path, fact, name, fqn, line)``."""
    s = rows.filter("rec = 'symbol'").select("path", F.col("kind").alias("fact"), "name", "fqn", "line")
    o = rows.filter("rec = 'occurrence'").select("path", F.col("role").alias("fact"), F.col("token").alias("name"), F.lit("").alias("fqn"), "line")
    return s.union(o)


def _query(language: str):
    return lambda g: _facts(extract.extract(sources(g, language)))


def _stub(g) -> DataFrame:
    """C# files are walked as modules only."""
    files = sources(g, "java").select(F.regexp_replace("path", r"\.java$", ".cs").alias("path"), "content")
    return extract.symbols(extract.extract(files)).select("kind", "name", "file_path")


QUERIES = {f"extract_{language}": _query(language) for language in FORMS}
QUERIES["extract_csharp"] = _stub
QUERIES["extract_counts"] = lambda g: extract.extract(sources(g, "python")).groupBy("path", "rec").agg(F.count(F.lit(1)).alias("n"))
QUERIES["extract_heuristic_calls"] = lambda g: extract.resolve_calls(extract.extract(sources(g, "python"))).select("src", "dst")

_DECLARED = ORACLE + """, callee AS (SELECT src AS fqn, min(split_part(dst, '::', 2)) AS callee FROM calls GROUP BY src),
declared AS (SELECT 'file' || file_id AS file, name, s.kind, callee, 3 * (row_number() OVER (PARTITION BY file_id ORDER BY id) - 1) AS place
  FROM symbols s LEFT JOIN callee USING (fqn) WHERE kind <> 'variable') """


def _oracle(language: str) -> str:
    form = FORMS[language]
    path, first = f"'src/' || file || '.{form.ending}'", len(form.head)  # lines count from 0
    also = f" UNION ALL SELECT DISTINCT {path}, 'class', 'Of_' || file, {form.also}, CAST({first - 1} AS INTEGER) FROM declared" if form.also else ""
    return _DECLARED + f"""SELECT {path} AS path, CASE kind WHEN 'class' THEN '{form.kinds[1]}' ELSE '{form.kinds[0]}' END AS fact, name, {form.fqn} AS fqn, CAST(place + {first} AS INTEGER) AS line FROM declared
UNION ALL SELECT {path}, 'call', callee, '', CAST(place + {first + 1} AS INTEGER) FROM declared WHERE kind <> 'class' AND callee IS NOT NULL""" + also


ORACLES = {f"extract_{language}": _oracle(language) for language in FORMS}
ORACLES["extract_csharp"] = _DECLARED + "SELECT DISTINCT 'module' AS kind, file || '.cs' AS name, 'src/' || file || '.cs' AS file_path FROM declared"
ORACLES["extract_counts"] = _DECLARED + """SELECT 'src/' || file || '.py' AS path, 'symbol' AS rec, count(*) AS n FROM declared GROUP BY file
UNION ALL SELECT 'src/' || file || '.py', 'occurrence', count(*) FROM declared WHERE kind <> 'class' AND callee IS NOT NULL GROUP BY file"""
ORACLES["extract_heuristic_calls"] = _DECLARED + """SELECT DISTINCT 'src.' || a.file || '.' || a.name AS src, 'src.' || b.file || '.' || b.name AS dst
FROM declared a JOIN declared b ON a.file = b.file AND a.callee = b.name WHERE a.kind <> 'class' AND b.kind <> 'class'"""
