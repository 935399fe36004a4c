"""Source trees as tables: listing, hashing, line counts, language detection."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.sources.session import ship

from .extract import EXTENSIONS, UNPARSED

#: Folders below the root that are never source.
VENDORED = ("node_modules", "vendor", ".next", "dist", "build")
MARKERS = {"typescript": ("tsconfig.json", "package.json"), "python": ("setup.py", "pyproject.toml", "requirements.txt"), "go": ("go.mod",), "rust": ("Cargo.toml",), "java": ("pom.xml", "build.gradle", "build.gradle.kts"), "cpp": ("CMakeLists.txt", "Makefile")}


def ignored(path: Column, patterns: list[str]) -> Column:
    """Paths an ignore file's patterns drop; later ones win, ``!`` takes back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        body = p.lstrip("!").rstrip("/")
        anchored = body.strip("/").count("/") > 0 or body.startswith("/")
        regex = fnmatch.translate(body.strip("/")).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z").replace(".*", "[^/]*")
        hit = path.rlike(("^" if anchored else "(^|/)") + regex + "(/|$)")
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def rule(line: str) -> tuple[str, bool, bool] | None:
    """``(expression, takes back, folders only)`` of a line of an ignore file, for
    paths from its folder; None for blank lines and notes."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back, body = line.startswith("!"), line.removeprefix("!")
    folder, body = body.endswith("/"), body.rstrip("/")
    anchored, body = "/" in body, body.lstrip("/")
    if not body:
        return None
    out = "" if anchored else "(?:.*/)?"
    for part in re.findall(r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|.", body, re.S):
        if part == "**/":
            out += "(?:.*/)?"
        elif part == "/**/":
            out += "/(?:.*/)?"
        elif part == "/**":
            out += "/.+"
        elif part.startswith("*"):
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif part.startswith("[") and len(part) > 2:
            inner = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
        else:
            out += _quote(part[-1])
    return "^" + out + "$", back, folder


def _rules(frames):
    for f in frames:
        rows = [(folder, depth, n, *r) for folder, depth, content in zip(f["folder"], f["depth"], f["content"], strict=True) for n, line in enumerate((content or "").split("\n")) if (r := rule(line))]
        yield pd.DataFrame(rows, columns=["folder", "level", "number", "expression", "back", "folders"])


def not_ignored(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """The rows of ``files`` that no ignore file drops.

    ``ignores`` is ``(path, content)``: a row an ignore file, each for what lies below
    its folder.  Of the rules that match a path the last line of the nearest file
    decides.  A file of an ignored folder is ignored, whatever takes it back.  Paths
    are relative to the root of the tree; files meet rules by their folders' paths."""
    ship(files.sparkSession)
    folder = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    depth = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))
    held = ignores.select(folder(F.col("path")).alias("folder"), "content").withColumn("depth", depth(F.col("folder")))
    rules = held.mapInPandas(_rules, "folder string, level int, number int, expression string, back boolean, folders boolean")
    parts = F.split("_path", "/")
    # the path itself and every folder above it, each asked of the ignore files above
    asked = files.select(F.col("path").alias("_path")).distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts))))
    asked = asked.select("_path", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "/").alias("_at"), (F.col("_n") < F.size(parts)).alias("_dir"), "_n")
    above = asked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("folder", F.array_join(F.slice(F.split("_at", "/"), F.lit(1), F.col("_level")), "/"))
    rest = F.array_join(F.slice(F.split("_at", "/"), F.col("_level") + 1, F.size(F.split("_at", "/"))), "/")
    met = above.join(rules, "folder").filter((F.col("_dir") | ~F.col("folders")) & F.regexp_like(rest, F.col("expression")))
    last = met.groupBy("_path", "_at").agg(F.max_by(~F.col("back"), F.struct("level", "number")).alias("gone"))
    gone = last.filter("gone").select(F.col("_path").alias("path")).distinct()
    return files.join(gone, "path", "left_anti")


def walk(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """``(path, content, content_hash, size_bytes, lines, error)`` of source files.

    Vendored folders are matched as whole path segments below the root.  A file
    that is not UTF-8 has an error and no content.  Spark skips hidden files and
    files without a byte."""
    ext = "|".join([*EXTENSIONS, *UNPARSED])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace("path", "^.*?" + _quote(base) + "/", "")
    files = raw.withColumn("path", path).filter(F.col("path").rlike(rf"(?i)\.({ext})$") & ~F.col("path").rlike(r"(^|/)(" + "|".join(_quote(v) for v in VENDORED) + r")(/)"))
    if patterns:
        files = files.filter(~ignored(F.col("path"), patterns))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select(
        "path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), line_count(text).alias("lines"),
        F.when(text.isNull(), "not UTF-8").alias("error"),
    )


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in s)


def line_count(text: Column) -> Column:
    """Lines; a last line break does not begin another."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).when(F.endswith(text, F.lit("\n")), n).otherwise(n + 1)


def languages(files: DataFrame) -> DataFrame:
    """``(language, files, marked)``: files a language has, and whether a marker of
    its projects is there."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    lang = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    marker = F.create_map(*[F.lit(x) for lang_, names in MARKERS.items() for n in names for x in (n, lang_)])[name]
    by = files.select(lang.alias("language")).filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    marked = files.select(marker.alias("language")).filter("language is not null").distinct().withColumn("marked", F.lit(True))
    return by.join(marked, "language", "full").select("language", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("marked", F.lit(False)).alias("marked"))
