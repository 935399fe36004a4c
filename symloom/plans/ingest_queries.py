"""Queries of ingestion: SCIP mapping, edge upgrades, versions, hashing, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions import versions
from symloom.operators import scan, store
from symloom.sources import scip, walk

from .bridge import ORACLE


#: Symbols a document holds at most, about.
DOCUMENT = 256


def scip_index(g) -> DataFrame:
    """The symbol graph as one index: a document a file, several where a file has more
    than ``DOCUMENT`` symbols, so that no row grows with the table."""
    raw = F.concat(F.lit("scip-typescript npm pkg 1.0 src/"), F.col("name"), F.when(F.col("kind") == "class", "#").when(F.col("kind") == "function", "().").when(F.col("kind") == "method", "()").otherwise("."))
    s = g.symbols.withColumn("raw", raw)
    calls = g.edges.filter("edge_type in ('calls', 'imports')").join(s.select(F.col("fqn").alias("dst"), F.col("raw").alias("other")), "dst")
    related = calls.groupBy(F.col("src").alias("fqn")).agg(F.collect_list(F.struct(F.col("other").alias("symbol"), (F.col("edge_type") == "imports").alias("is_implementation"), F.lit(True).alias("is_reference"))).alias("relationships"))
    one = s.join(related, "fqn", "left").join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    where = F.when(F.col("line") % 2 == 0, F.array("line", "column", F.col("column") + 5)).otherwise(F.array("line", "column", F.col("line") + 1, F.lit(0)))
    parts = g.symbols.groupBy("file_id").agg(F.ceil(F.count(F.lit(1)) / DOCUMENT).alias("parts"))  # a row a file
    one = one.join(parts, "file_id").withColumn("part", F.pmod(F.xxhash64("fqn"), F.col("parts")))
    docs = one.groupBy("path", "part").agg(
        F.collect_list(F.struct(F.col("raw").alias("symbol"), F.array("docstring").alias("documentation"), "relationships")).alias("symbols"),
        F.collect_list(F.struct(where.alias("range"), F.col("raw").alias("symbol"), F.when(F.col("line") % 3 == 0, 1).when(F.col("line") % 3 == 1, 4).alias("symbol_roles"), F.lit(None).cast("array<int>").alias("enclosing_range"))).alias("occurrences"),
    )
    tool = F.struct(F.struct(F.lit("tool").alias("name"), F.lit("1").alias("version")).alias("tool_info"), F.lit("r").alias("project_root"), F.lit(None).cast("int").alias("text_document_encoding"))
    return docs.select(tool.alias("metadata"), F.array(F.struct(F.col("path").alias("relative_path"), "symbols", "occurrences")).alias("documents"))


def _upgrade(g) -> DataFrame:
    s = g.symbols.select("fqn", F.concat(F.lit("id:"), F.col("id").cast("string")).alias("symbol_id"), F.col("id").alias("seq"))
    return scip.upgrade(g.edges, s).select("id", "dst", "resolution", "resolved_by")


#: Sources with the version that they show.
CPP_SOURCES = (
    ("a.cpp", "co_await x;"), ("b.cpp", "template <class T> concept C = true;"), ("c.cpp", "if constexpr (x) {}"), ("d.cc", "std::optional<int> x;"), ("e.cpp", "auto f() -> int { return 1; }"),
    ("f.cpp", "int *p = nullptr;"), ("g.cpp", "int x = 1;"), ("h.hpp", "int x = 1;"), ("i.c", "_Static_assert(1);"), ("j.h", "int x;"), ("k.cpp", "// -std=c++03\nint *p = nullptr;"), ("l.c", "int f(char *restrict p);"), ("m", "namespace a {}"), ("n.cpp", "[[nodiscard]] int f();"),
)
JAVA_SOURCES = (
    ("A.java", "Thread.startVirtualThread(r);"), ("B.java", "sealed class A permits B {}"), ("C.java", "String s = \"\"\"\nx\"\"\";"), ("D.java", "var x = 1;"), ("E.java", "list.forEach(x -> f(x));"), ("F.java", "int x = 1;"),
    ("pom.xml", "<maven.compiler.source>17</maven.compiler.source>"), ("build.gradle", "sourceCompatibility = '1.8'"), ("G.java", "@FunctionalInterface interface F {}"),
)


def _sources(g, rows) -> DataFrame:
    """A source a symbol, by its id one of the given; its name has the id."""
    form = F.element_at(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in rows]), (F.col("id") % len(rows) + 1).cast("int"))
    return g.symbols.select("id", F.concat(F.lit("src"), F.col("id").cast("string"), F.lit("/"), form["path"]).alias("path"), form["content"].alias("content"))


def _supported(g) -> DataFrame:
    """Every symbol's features: those of a family and version that its id picks."""
    known = [(lang, v) for lang, all_ in versions.FAMILIES.items() if any(lang == x for x, _ in versions.FEATURES) for v in all_]
    pick = F.element_at(F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(v).alias("version")) for lang, v in known]), (F.col("id") % len(known) + 1).cast("int"))
    return g.symbols.select("id", pick.alias("p")).select("id", "p.*").join(versions.feature_table(g.spark), ["language", "version"]).select("id", "language", "version", "feature", "supported")


def _minimum(g) -> DataFrame:
    """Every file's features with the least version that has them, by its language."""
    return g.files.join(versions.minimum_table(g.spark), "language").select("path", "language", "feature", "version", "name")


def _scanned(g) -> DataFrame:
    """Risky patterns in all documents and pages."""
    docs, pages = (g.spark.read.parquet(f"{g.sf}/{t}.parquet") for t in ("documents", "pages"))
    one = lambda rows, what, key, text: scan.scan(rows, key, text).select(F.lit(what).alias("what"), "*")
    return one(docs, "document", "doc_id", "text").union(one(pages, "page", "page_id", "html"))


def _scan_oracle() -> str:
    """Pattern by pattern, without the literals."""
    each = " UNION ALL ".join(
        f"SELECT what, id, '{p.kind}' AS kind, '{p.severity}' AS severity, regexp_extract_all(text, '{e}') AS found, string_split_regex(text, '{e}') AS between FROM held"
        for p in scan.PATTERNS
        for e in [p.expression.replace("'", "''")]
    )
    return f"""WITH held AS (SELECT 'document' AS what, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
each AS ({each})
SELECT what, id, kind, severity, CAST(list_sum([length(x) for x in between[:i]]) + coalesce(list_sum([length(x) for x in found[:i - 1]]), 0) AS INTEGER) AS place, found[i] AS match
FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM each WHERE len(found) > 0)"""


QUERIES = {
    "scan_patterns": _scanned,
    "scip_symbols": lambda g: scip.symbols(scip_index(g), "c0").select("symbol_id", "kind", "name", "fqn", "doc"),
    "scip_edges": lambda g: scip.edges(scip_index(g)).select("edge_type", "src", "dst", "file_src"),
    "scip_occurrences": lambda g: scip.occurrences(scip_index(g)).select("file_path", "role", "start_line", "start_col", "end_line", "end_col"),
    "fqn_edge_upgrade": _upgrade,
    "version_detect_java": lambda g: _sources(g, JAVA_SOURCES).select("id", "path", versions.of_java(F.col("content"))["version"].alias("version")),
    "version_detect_cpp": lambda g: _sources(g, CPP_SOURCES).select("id", "path", versions.of_cpp(F.col("path"), F.col("content"))["version"].alias("version")),
    "feature_support": _supported,
    "feature_minimum": _minimum,
    "line_counts": lambda g: g.spark.read.parquet(f"{g.sf}/documents.parquet").select("doc_id", walk.line_count(F.col("text")).cast("long").alias("lines")),
    "content_hashes": lambda g: g.spark.read.parquet(f"{g.sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash")),
    "next_snapshot": lambda g: store.next_snapshot(*_snapshot_step(g)).select("commit_id", "path", "content_hash"),
}


def _snapshot_step(g):
    rows = store.upsert(g.snapshots, ["commit_id", "path"]).select("commit_id", "path", "content_hash")
    old, new = rows.filter("commit_id = 1"), rows.filter("commit_id = 2")
    diff = store.snapshot_diff(old, new)
    changed = new.join(diff.filter("change <> 'removed'"), "path", "left_semi").select("commit_id", "path", "content_hash")
    return old.withColumn("commit_id", F.lit(2).cast("long")), diff, changed, "path"


_RAW = "'scip-typescript npm pkg 1.0 src/' || name || CASE kind WHEN 'class' THEN '#' WHEN 'function' THEN '().' WHEN 'method' THEN '()' ELSE '.' END"
ORACLES = {
    "scan_patterns": _scan_oracle(),
    "scip_symbols": ORACLE + "SELECT 'repo://c0/' || path || '/#sym(typescript:' || path || '.' || name || ':' || lower(to_hex(octet_length(encode(name)))) || ')' AS symbol_id, CASE kind WHEN 'class' THEN 'class' WHEN 'function' THEN 'function' WHEN 'method' THEN 'method' ELSE 'variable' END AS kind, name, path || '.' || name AS fqn, docstring AS doc FROM symbols s JOIN files f ON f.id = s.file_id",
    "scip_edges": ORACLE + f", raw AS (SELECT fqn, file_id, {_RAW} AS raw FROM symbols) SELECT CASE edge_type WHEN 'imports' THEN 'implements' ELSE 'calls' END AS edge_type, a.raw AS src, b.raw AS dst, path AS file_src FROM edges e JOIN raw a ON a.fqn = e.src JOIN raw b ON b.fqn = e.dst JOIN files f ON f.id = a.file_id WHERE edge_type IN ('calls', 'imports')",
    "scip_occurrences": ORACLE + "SELECT path AS file_path, CASE line % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'write' ELSE 'reference' END AS role, line AS start_line, \"column\" AS start_col, CASE WHEN line % 2 = 0 THEN line ELSE line + 1 END AS end_line, CASE WHEN line % 2 = 0 THEN \"column\" + 5 ELSE 0 END AS end_col FROM symbols s JOIN files f ON f.id = s.file_id",
    "fqn_edge_upgrade": ORACLE + "SELECT e.id, CASE WHEN resolution = 'syntactic' THEN 'id:' || s.id ELSE dst END AS dst, 'semantic' AS resolution, CASE WHEN resolution = 'syntactic' THEN 'scip' END AS resolved_by FROM edges e JOIN symbols s ON s.fqn = e.dst",
    "version_detect_java": ORACLE + "SELECT id, 'src' || id || '/' || path AS path, version FROM symbols JOIN (SELECT path, version, row_number() OVER () - 1 AS place FROM (VALUES ('A.java', 'Java21'), ('B.java', 'Java17'), ('C.java', 'Java17'), ('D.java', 'Java11'), ('E.java', 'Java8'), ('F.java', 'Java8'), ('pom.xml', 'Java17'), ('build.gradle', 'Java8'), ('G.java', 'Java8')) t(path, version)) v ON place = id % 9",
    "version_detect_cpp": ORACLE + "SELECT id, 'src' || id || '/' || path AS path, version FROM symbols JOIN (SELECT path, version, row_number() OVER () - 1 AS place FROM (VALUES ('a.cpp', 'Cpp20'), ('b.cpp', 'Cpp20'), ('c.cpp', 'Cpp17'), ('d.cc', 'Cpp17'), ('e.cpp', 'Cpp14'), ('f.cpp', 'Cpp11'), ('g.cpp', 'Cpp17'), ('h.hpp', 'Cpp17'), ('i.c', 'C11'), ('j.h', 'C11'), ('k.cpp', 'Cpp03'), ('l.c', 'C99'), ('m', 'Cpp98'), ('n.cpp', 'Cpp17')) t(path, version)) v ON place = id % 14",
    "feature_support": ORACLE + """, v(language, version, place) AS (VALUES
  ('cpp', 'Cpp98', 1), ('cpp', 'Cpp03', 2), ('cpp', 'Cpp11', 3), ('cpp', 'Cpp14', 4), ('cpp', 'Cpp17', 5), ('cpp', 'Cpp20', 6), ('cpp', 'Cpp23', 7),
  ('java', 'Java8', 1), ('java', 'Java11', 2), ('java', 'Java17', 3), ('java', 'Java21', 4),
  ('python', 'Python2', 1), ('python', 'Python3', 2), ('python', 'Python38', 3), ('python', 'Python39', 4), ('python', 'Python310', 5), ('python', 'Python311', 6), ('python', 'Python312', 7),
  ('javascript', 'ES5', 1), ('javascript', 'ES6', 2), ('javascript', 'ES2016', 3), ('javascript', 'ES2017', 4), ('javascript', 'ES2018', 5), ('javascript', 'ES2019', 6), ('javascript', 'ES2020', 7), ('javascript', 'ES2021', 8), ('javascript', 'ES2022', 9), ('javascript', 'ES2023', 10),
  ('go', 'Go118', 1), ('go', 'Go119', 2), ('go', 'Go120', 3), ('go', 'Go121', 4)),
f(language, feature, least) AS (VALUES
  ('cpp', 'auto', 3), ('cpp', 'lambda', 3), ('cpp', 'nullptr', 3), ('cpp', 'override', 3), ('cpp', 'auto_return', 4), ('cpp', 'structured_bindings', 5), ('cpp', 'if_constexpr', 5), ('cpp', 'inline_variables', 5),
  ('cpp', 'concepts', 6), ('cpp', 'coroutines', 6), ('cpp', 'modules', 6), ('cpp', 'ranges', 6), ('cpp', 'spaceship', 6),
  ('java', 'lambda', 1), ('java', 'stream', 1), ('java', 'var', 2), ('java', 'sealed', 3), ('java', 'pattern_matching', 3), ('java', 'virtual_threads', 4),
  ('python', 'annotations', 2), ('python', 'walrus', 3), ('python', 'match', 5), ('python', 'exception_groups', 6),
  ('javascript', 'arrow_functions', 2), ('javascript', 'let_const', 2), ('javascript', 'template_literals', 2), ('javascript', 'async_await', 4), ('javascript', 'optional_chaining', 7), ('javascript', 'nullish_coalescing', 7),
  ('go', 'generics', 1))
SELECT s.id, language, version, feature, p.place >= least AS supported FROM symbols s
JOIN (SELECT language, version, place, row_number() OVER (ORDER BY list_position(['cpp', 'java', 'python', 'javascript', 'go'], language), place) - 1 AS at FROM v) p ON p.at = s.id % (SELECT count(*) FROM v) JOIN f USING (language)""",
    "feature_minimum": ORACLE + """SELECT path, language, feature, version, name FROM files JOIN (VALUES ('cpp', 'auto', 'Cpp11', 'C++11'), ('cpp', 'lambda', 'Cpp11', 'C++11'), ('cpp', 'structured_bindings', 'Cpp17', 'C++17'), ('cpp', 'concepts', 'Cpp20', 'C++20'), ('cpp', 'coroutines', 'Cpp20', 'C++20'), ('cpp', 'modules', 'Cpp20', 'C++20'),
  ('java', 'lambda', 'Java8', 'Java 8'), ('java', 'var', 'Java11', 'Java 11'), ('java', 'sealed', 'Java17', 'Java 17'), ('java', 'virtual_threads', 'Java21', 'Java 21'),
  ('python', 'annotations', 'Python3', 'Python 3'), ('python', 'walrus', 'Python38', 'Python 3.8'), ('python', 'match', 'Python310', 'Python 3.10'),
  ('javascript', 'arrow_functions', 'ES6', 'ES6/ES2015'), ('javascript', 'async_await', 'ES2017', 'ES2017'), ('javascript', 'optional_chaining', 'ES2020', 'ES2020'),
  ('typescript', 'arrow_functions', 'ES6', 'ES6/ES2015'), ('typescript', 'async_await', 'ES2017', 'ES2017'), ('typescript', 'optional_chaining', 'ES2020', 'ES2020'),
  ('go', 'generics', 'Go118', 'Go 1.18')) t(language, feature, version, name) USING (language)""",
    "line_counts": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS lines FROM documents",
    "content_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "next_snapshot": ORACLE + "SELECT CAST(2 AS BIGINT) AS commit_id, path, max_by(content_hash, seq) AS content_hash FROM snapshots WHERE commit_id = 2 GROUP BY path",
}
