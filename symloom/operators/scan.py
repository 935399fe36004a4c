"""Patterns of risky code over whole texts, all in one scan.

Each pattern names literals of which a match holds one.  A row's literals are looked
up once for all patterns; a pattern's expression runs on a row only if one of its
literals is there.  Places come from the text between matches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Pattern(NamedTuple):
    kind: str
    severity: str
    expression: str
    literals: tuple[str, ...]


# The patterns of the inventory, with the literals they need.
PATTERNS = (
    *(Pattern("sql_concatenation", "critical", rf"\+.*[\"'].*{verb}", (verb,)) for verb in ("SELECT", "INSERT", "UPDATE", "DELETE")),
    Pattern("sql_concatenation", "critical", r"\.format\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE)", (".format(",)),
    Pattern("sql_concatenation", "critical", r"f[\"'].*SELECT.*\{", ("SELECT",)),
    *(Pattern("sql_call", "medium", rf"{name}\s*\(", (name,)) for name in ("execute", "query", "raw")),
    *(Pattern("command", "critical", rf"{name}\s*\(", (name,)) for name in ("exec", "eval", "system", "popen")),
    Pattern("command", "critical", r"subprocess\.(?:call|run|Popen)\s*\(", ("subprocess.",)),
    Pattern("path_traversal", "high", r"\.\./", ("../",)),
    Pattern("path_traversal", "high", r"\.\.\\", ("..\\",)),
    Pattern("secret", "high", r"(?:password|passwd|pwd)\s*=\s*[\"'][^\"']+[\"']", ("password", "passwd", "pwd")),
    Pattern("secret", "high", r"(?:api[_-]?key|apikey)\s*=\s*[\"'][^\"']+[\"']", ("api",)),
    Pattern("secret", "high", r"(?:secret|token)\s*=\s*[\"'][^\"']+[\"']", ("secret", "token")),
)


def _matches(text: Column, number: int, pattern: Pattern) -> Column:
    """``array<struct<pattern, place, match>>``; a place is a code point from 0."""
    expression = F.lit("(?d)" + pattern.expression)  # only \n ends a line
    found = F.regexp_extract_all(text, expression, F.lit(0))
    between = F.split(text, "(?d)" + pattern.expression, -1)
    # the place of a match: all text between matches before it, and all matches before it
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pattern:int,place:int,match:string>>").alias("out"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["between"]) + F.length(x["found"])).alias("at"),
        F.concat(a["out"], F.array(F.struct(F.lit(number).alias("pattern"), (a["at"] + F.length(x["between"])).alias("place"), x["found"].alias("match")))).alias("out"),
    )
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"))
    return F.aggregate(pairs, start, step)["out"]


def scan(rows: DataFrame, key: str, text: str, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """``(id, kind, severity, place, match)``: every match of every pattern, with its
    first code point; matches of one pattern do not overlap.  A null text has none."""
    literals = sorted({x for p in patterns for x in p.literals})
    held = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    # whole texts of no literal end here
    held = held.withColumn("has", F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), F.lit(i)) for i, x in enumerate(literals)]))).filter(F.size("has") > 0)
    none = F.array().cast("array<struct<pattern:int,place:int,match:string>>")
    each = [F.when(F.arrays_overlap("has", F.array(*[F.lit(literals.index(x)) for x in p.literals])), _matches(F.col("text"), i, p)).otherwise(none) for i, p in enumerate(patterns)]
    named = lambda field: F.element_at(F.array(*[F.lit(getattr(p, field)) for p in patterns]), F.col("m.pattern") + 1).alias(field)
    return held.select("id", F.explode(F.flatten(F.array(*each))).alias("m")).select("id", named("kind"), named("severity"), "m.place", "m.match")
