"""The registered queries of the symbol-graph engine, and their oracles.

A query runs an operator on the symbol graph of ``bridge``; its oracle is an
independent statement in DuckDB's SQL over the same mapping.  Paths and lists
are joined to strings, so both engines' values compare.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.operators import cycles, graph, lookup, propagate, rules, search, similar, stats, store, taint

from symloom.sources.session import cut, stored

from . import bridge, extract_queries, index_queries, ingest_queries, storage_queries
from .bridge import ORACLE


_hubs: dict[tuple[str, str], str] = {}


class Graph:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    symbols = cached_property(lambda s: bridge.symbols(s.spark, s.sf))
    files = cached_property(lambda s: bridge.files(s.spark, s.sf))
    edges = cached_property(lambda s: bridge.edges(s.spark, s.sf))
    file_edges = cached_property(lambda s: bridge.file_edges(s.spark, s.sf))
    snapshots = cached_property(lambda s: bridge.snapshots(s.spark, s.sf))
    #: The edges as a written table, for queries that would make them more than once.
    kept = cached_property(lambda s: stored(s.edges))

    @cached_property
    def hub(self) -> str:
        """The symbol with the most callers; found once an application and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf)
        if key not in _hubs:
            calls = graph.arcs(self.kept, ["calls"])
            top = calls.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1)
            _hubs[key] = top.first()["node"]
        return _hubs[key]

    @cached_property
    def seed(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.hub).alias("node"))

    def views(self) -> dict[str, DataFrame]:
        return {"symbols": self.symbols, "files": self.files, "edges": self.edges}


Query = Callable[[Graph], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, run: Query, oracle: str | None) -> None:
    _QUERIES[name] = run
    if oracle is not None:
        _ORACLES[name] = ORACLE + oracle


def _path(c: str):
    return F.array_join(c, ">")


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _tail(column: str) -> str:
    return f"split_part({column}, '::', 2)"


# ---- lookups ---------------------------------------------------------------

_add("sym_by_id", lambda g: lookup.by_id(g.symbols, 7).select("id", "fqn", "kind"), "SELECT id, fqn, kind FROM symbols WHERE id = 7")
_add("sym_by_fqn", lambda g: lookup.by_fqn(g.symbols, g.hub).select("id", "fqn", "name", "kind"), "SELECT id, fqn, name, kind FROM symbols WHERE fqn = (SELECT node FROM seed)")
_add("sym_latest_by_name", lambda g: lookup.latest_by_fqn(g.symbols.withColumn("fqn", text.prefix(F.col("name")))).select("fqn", "id"), "SELECT split_part(name, '_', 1) AS fqn, max(id) AS id FROM symbols GROUP BY 1")
_add("find_symbols", lambda g: lookup.find(g.symbols, "REQUEST").select("id", "name", "kind"), "SELECT id, name, kind FROM symbols WHERE name ILIKE '%request%'")
_add("find_symbols_kind", lambda g: lookup.find(g.symbols, "query", "function").select("id", "name"), "SELECT id, name FROM symbols WHERE name ILIKE '%query%' AND kind = 'function'")
_add("find_symbols_limit", lambda g: lookup.find(g.symbols, "", limit=100).select("id", "name"), "SELECT id, name FROM symbols ORDER BY id LIMIT 100")
_add("file_symbols", lambda g: lookup.in_file(g.symbols, g.files, "src/mod2/file12.py").select("fqn", "line", "column"), "SELECT fqn, line, \"column\" FROM symbols s JOIN files f ON f.id = s.file_id WHERE path = 'src/mod2/file12.py'")
_add("edges_of_symbol", lambda g: lookup.edges_of(g.edges, g.hub).select("id", "direction", "edge_type"), "SELECT id, 'out' AS direction, edge_type FROM edges WHERE src = (SELECT node FROM seed) UNION ALL SELECT id, 'in', edge_type FROM edges WHERE dst = (SELECT node FROM seed)")
_add("edges_filtered", lambda g: lookup.filter_edges(g.edges, target=g.hub, edge_type="calls").select("id", "src"), "SELECT id, src FROM edges WHERE dst = (SELECT node FROM seed) AND edge_type = 'calls'")


def _commits(g: Graph) -> DataFrame:
    return g.snapshots.groupBy("commit_id").agg(F.max("seq").alias("ts")).withColumn("commit_sha", F.md5(F.col("commit_id").cast("string")))


_COMMITS = ", commits AS (SELECT commit_id, max(seq) AS ts, md5(CAST(commit_id AS VARCHAR)) AS commit_sha FROM snapshots GROUP BY 1) "
_add("latest_commit", lambda g: lookup.latest_commit(_commits(g)), _COMMITS + "SELECT commit_sha FROM commits ORDER BY ts DESC, commit_id DESC LIMIT 1")
_add("files_in_commit", lambda g: lookup.files_in_commit(store.upsert(g.snapshots, ["commit_id", "path"]), _commits(g), "c4ca4238a0b923820dcc509a6f75849b"), _COMMITS + "SELECT path, max_by(content_hash, seq) AS content_hash FROM snapshots JOIN commits USING (commit_id) WHERE commit_sha = 'c4ca4238a0b923820dcc509a6f75849b' GROUP BY path")
_add("file_hash", lambda g: lookup.file_hash(store.upsert(g.snapshots, ["commit_id", "path"]), _commits(g), "c81e728d9d4c2f636f067f89cc14862c", "src/src1/1.py"), _COMMITS + "SELECT max_by(content_hash, seq) AS content_hash FROM snapshots JOIN commits USING (commit_id) WHERE commit_sha = 'c81e728d9d4c2f636f067f89cc14862c' AND path = 'src/src1/1.py' GROUP BY path")
_add("free_sql", lambda g: lookup.sql(g.spark, g.views(), "SELECT kind, count(*) AS n FROM symbols WHERE line > ? GROUP BY kind", [10]), "SELECT kind, count(*) AS n FROM symbols WHERE line > 10 GROUP BY kind")

# ---- search ----------------------------------------------------------------

_FIELDS = ["name", "docstring"]
_POST = """, words AS MATERIALIZED (SELECT id, field, i - 1 AS pos, toks[i] AS term FROM
  (SELECT id, field, toks, unnest(range(1, len(toks) + 1)) AS i FROM
    (SELECT id, 'name' AS field, regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') AS toks FROM symbols UNION ALL SELECT id, 'docstring', regexp_extract_all(lower(docstring), '[\\p{L}\\p{N}]+') FROM symbols))) """
_add("fts_match_all_terms", lambda g: search.match_all(search.postings(g.symbols, _FIELDS), ["handle", "request"]), _POST + "SELECT id FROM words WHERE term IN ('handle', 'request') GROUP BY id HAVING count(DISTINCT term) = 2")
_add("fts_prefix", lambda g: search.match_all(search.postings(g.symbols, _FIELDS), ["red", "wid"], prefix_last=True), _POST + "SELECT id FROM words WHERE term = 'red' INTERSECT SELECT id FROM words WHERE starts_with(term, 'wid')")
_add("fts_phrase", lambda g: search.match_phrase(search.postings(g.symbols, _FIELDS), ["red", "widget"]), _POST + "SELECT DISTINCT a.id FROM words a JOIN words b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'red' AND b.term = 'widget'")
_add("fts_any_term", lambda g: search.match_any(search.postings(g.symbols, _FIELDS), ["promo", "secret"]), _POST + "SELECT DISTINCT id FROM words WHERE term IN ('promo', 'secret')")
_add(
    "bm25_topk",
    lambda g: index_queries.bm25_topk(g.spark, g.sf),
    _POST
    + """, dl AS (SELECT id, count(*) AS dl FROM words GROUP BY id), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT term, id, count(*) AS tf FROM words WHERE term IN ('red', 'widget', 'query') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term) JOIN dl USING (id), c GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
_add("search", lambda g: search.search(g.symbols, "handling requests", files=g.files), None)  # stems are beyond SQL
_add("like_ranked_search", lambda g: search.like_ranked(g.symbols, "get_user").select("id", "name", "tier"), "SELECT id, name, CAST(CASE WHEN name = 'get_user' THEN 0 WHEN name ILIKE 'get_user%' THEN 1 ELSE 2 END AS INTEGER) AS tier FROM symbols WHERE name ILIKE '%get_user%' OR fqn ILIKE '%get_user%' ORDER BY tier, length(name), id LIMIT 20")

# ---- one hop ---------------------------------------------------------------

_add("graph_vertices", lambda g: graph.vertices(g.symbols, g.edges), "SELECT fqn AS node FROM symbols UNION SELECT src FROM edges UNION SELECT dst FROM edges")
_add("direct_callers", lambda g: graph.direct(g.edges, g.hub, "src"), "SELECT src AS node FROM calls WHERE dst = (SELECT node FROM seed)")
_add("direct_callees", lambda g: graph.direct(g.edges, g.hub, "dst"), "SELECT dst AS node FROM calls WHERE src = (SELECT node FROM seed)")
_add(
    "dependencies_typed",
    lambda g: graph.dependencies_typed(g.edges).select("node", _path("dependencies").alias("dependencies"), _path("dependents").alias("dependents")),
    """, d AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('calls', 'imports', 'uses'))
SELECT coalesce(a.node, b.node) AS node, coalesce(dependencies, '') AS dependencies, coalesce(dependents, '') AS dependents
FROM (SELECT src AS node, string_agg(dst, '>' ORDER BY dst) AS dependencies FROM d GROUP BY src) a FULL JOIN (SELECT dst AS node, string_agg(src, '>' ORDER BY src) AS dependents FROM d GROUP BY dst) b ON a.node = b.node""",
)
_add(
    "dependencies_grouped",
    lambda g: graph.dependencies_grouped(g.edges, g.hub).select(F.explode("dependencies").alias("edge_type", "t")).select("edge_type", _path("t").alias("targets")),
    "SELECT t AS edge_type, coalesce(string_agg(DISTINCT dst, '>' ORDER BY dst), '') AS targets FROM (VALUES ('imports'), ('calls'), ('uses')) v(t) LEFT JOIN edges ON edge_type = t AND src = (SELECT node FROM seed) GROUP BY t",
)
_add("relationships_both", lambda g: graph.relationships(g.edges, g.hub), "SELECT 'outgoing_' || edge_type AS relation, dst AS node FROM edges WHERE src = (SELECT node FROM seed) UNION ALL SELECT 'incoming_' || edge_type, src FROM edges WHERE dst = (SELECT node FROM seed)")
_add("file_dependents", lambda g: graph.file_dependents(g.file_edges), "SELECT DISTINCT file_dst, file_src FROM file_edges WHERE edge_type IN ('imports', 'reads', 'calls', 'contains', 'implements')")
_add("importers", lambda g: graph.importers(g.edges, g.hub), "SELECT DISTINCT src AS node FROM edges WHERE edge_type = 'imports' AND dst = (SELECT node FROM seed)")
_add(
    "compare_symbols",
    lambda g: graph.compare(g.edges, *[r["node"] for r in _top_two(g)]),
    """, top AS (SELECT dst AS node, row_number() OVER (ORDER BY count(*) DESC, dst) AS r FROM calls GROUP BY dst QUALIFY r <= 2)
SELECT 'shared_callees' AS side, dst AS node FROM calls JOIN top ON src = top.node GROUP BY dst HAVING count(*) = 2
UNION ALL SELECT 'shared_callers', src FROM calls JOIN top ON dst = top.node GROUP BY src HAVING count(*) = 2""",
)


def _top_two(g: Graph):
    return graph.arcs(g.edges, ["calls"]).groupBy(F.col("dst").alias("node")).count().orderBy(F.desc("count"), "node").limit(2).collect()


_add(
    "symbol_context_counts",
    lambda g: graph.context_counts(g.symbols, g.edges),
    """SELECT s.fqn, n - 1 AS siblings, coalesce(a.c, 0) AS callers, coalesce(b.c, 0) AS callees, coalesce(i.c, 0) AS imports FROM symbols s
JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) f USING (file_id) LEFT JOIN (SELECT dst, count(*) AS c FROM calls GROUP BY 1) a ON a.dst = s.fqn
LEFT JOIN (SELECT src, count(*) AS c FROM calls GROUP BY 1) b ON b.src = s.fqn LEFT JOIN (SELECT src, count(DISTINCT dst) AS c FROM edges WHERE edge_type = 'imports' GROUP BY 1) i ON i.src = s.fqn""",
)
_add("explore_entry_points", lambda g: graph.entry_candidates(g.symbols, g.edges, None), "SELECT fqn FROM symbols WHERE fqn NOT IN (SELECT dst FROM calls) OR name ILIKE '%main%' OR name ILIKE '%start%' OR name ILIKE '%init%'")
_add("explore_first_entries", lambda g: graph.entry_candidates(g.symbols, g.edges), "SELECT fqn FROM symbols WHERE fqn NOT IN (SELECT dst FROM calls) OR name ILIKE '%main%' OR name ILIKE '%start%' OR name ILIKE '%init%' ORDER BY fqn LIMIT 10")

# ---- several hops ----------------------------------------------------------


def _hops(pairs: str, depth: int, start: str = "seed") -> str:
    return f", hop AS (SELECT node AS seed, node, 0 AS depth FROM {start} UNION SELECT h.seed, p.dst, h.depth + 1 FROM hop h JOIN ({pairs}) p ON p.src = h.node WHERE h.depth < {depth}) "


def _impact_all(g: Graph, depth: int) -> DataFrame:
    up = cut(graph.arcs(g.edges, ["calls"], reverse=True))
    found = propagate.reach_counts(up, up.select(F.col("dst").alias("node")).distinct(), depth)
    return found.join(g.symbols.select(F.col("fqn").alias("node")).distinct(), "node").select(F.col("node").alias("seed"), F.col("reached").alias("n"))


_UP = "SELECT dst AS src, src AS dst FROM calls"
_ANY_UP = "SELECT DISTINCT dst AS src, src AS dst FROM edges"
_ANY = "SELECT DISTINCT src, dst FROM edges"
_MIN = "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM hop WHERE depth > 0 {} GROUP BY seed, node"
_add("callers_k", lambda g: graph.callers(g.edges, g.seed, 3).select("node", "depth"), _hops(_ANY_UP, 3) + _MIN.format("AND node <> seed"))
_add("callees_k", lambda g: graph.callees(g.edges, g.seed, 3).select("node", "depth"), _hops(_ANY, 3) + _MIN.format("AND node <> seed"))
_add("callers_hydrated", lambda g: graph.hydrate(graph.callers(g.edges, g.seed, 2), g.symbols).select("node", "name", "kind", "depth"), _hops(_ANY_UP, 2) + "SELECT node, name, kind, CAST(min(depth) AS INTEGER) AS depth FROM hop JOIN symbols ON fqn = node WHERE depth > 0 AND node <> seed GROUP BY ALL")
_add("impact_radius", lambda g: graph.impact_radius(g.edges, g.seed, 3).select("node", "depth"), _hops(_UP, 3) + _MIN.format(""))
_add("impact_radius_all", lambda g: _impact_all(g, 2), _hops(_UP, 2, "(SELECT fqn AS node FROM symbols)") + "SELECT seed, count(DISTINCT node) AS n FROM hop WHERE depth > 0 GROUP BY seed")
_add("neighborhood", lambda g: graph.neighbourhood(g.edges, g.seed, 2).select("node", "depth"), _hops("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges", 2) + "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM hop GROUP BY node")
_add("reachable_unbounded", lambda g: graph.reach(graph.arcs(g.edges, ["imports"]), g.edges.filter("edge_type = 'imports'").agg(F.min("src").alias("node")), None).select("node"), """, r AS (SELECT min(src) AS node FROM edges WHERE edge_type = 'imports' UNION SELECT dst FROM edges JOIN r ON src = node WHERE edge_type = 'imports') SELECT node FROM r WHERE node <> (SELECT min(src) FROM edges WHERE edge_type = 'imports')""")
_add("explore_breadth", lambda g: graph.explore(g.symbols, g.kept, g.seed), _hops("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges", 3) + "SELECT DISTINCT node FROM hop")

# ---- paths -----------------------------------------------------------------


def _walks(depth: int, start: str = "SELECT node FROM seed", pairs: str = "SELECT src, dst FROM calls") -> str:
    return f""", walk AS (SELECT node AS seed, node, [node] AS path, false AS is_recursive FROM ({start}) UNION ALL
  SELECT w.seed, p.dst, list_append(path, p.dst), list_contains(path, p.dst) FROM walk w JOIN ({pairs}) p ON p.src = w.node WHERE NOT is_recursive AND len(path) <= {depth}) """


_add("call_paths_k", lambda g: graph.call_paths(graph.arcs(g.edges, ["calls"]), g.seed, 4).select(_path("path").alias("path"), F.col("depth").cast("long"), "is_recursive"), _walks(4) + "SELECT array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS depth, is_recursive FROM walk WHERE len(path) > 1")
_add("simple_paths", lambda g: graph.simple_paths(graph.arcs(g.edges, ["calls"]), _entries(g), 3, g.seed).select(_path("path").alias("path")), _walks(3, "SELECT fqn AS node FROM symbols WHERE kind = 'function'") + "SELECT array_to_string(path, '>') AS path FROM walk WHERE node = (SELECT node FROM seed) AND NOT is_recursive AND NOT list_contains(path[:-2], node)")


def _entries(g: Graph) -> DataFrame:
    return g.symbols.filter("kind = 'function'").select(F.col("fqn").alias("node"))


_add("trace_paths_typed", lambda g: graph.simple_paths(graph.arcs(g.edges, ["imports"], bag=True), g.seed, 4).select(_path("path").alias("path")), _walks(4, pairs="SELECT src, dst FROM edges WHERE edge_type = 'imports'") + "SELECT array_to_string(path, '>') AS path FROM walk WHERE len(path) > 1 AND NOT is_recursive")
_add("trace_all_reachable", lambda g: graph.simple_paths(graph.arcs(g.edges, ["calls"], bag=True), g.seed, 3).select(_path("path").alias("path")), _walks(3, pairs="SELECT src, dst FROM edges WHERE edge_type = 'calls'") + "SELECT array_to_string(path, '>') AS path FROM walk WHERE len(path) > 1 AND NOT is_recursive")


def _shortest(g: Graph) -> DataFrame:
    ends = g.symbols.join(graph.arcs(g.kept, ["calls"]).select(F.col("src").alias("fqn")).distinct(), "fqn").agg(F.min("fqn").alias("a")).first()
    path = graph.shortest_path(graph.arcs(g.kept), ends["a"], g.hub) or []
    return g.spark.createDataFrame([(len(path), ">".join(path))], "nodes long, path string")


_add(
    "shortest_path",
    _shortest,
    """, a AS (SELECT min(src) AS node FROM calls), h AS (SELECT node, 1 AS d FROM a UNION SELECT dst, d + 1 FROM h JOIN edges ON src = node WHERE d < 8),
level AS MATERIALIZED (SELECT node, min(d) AS d FROM h GROUP BY node),
best AS (SELECT node, 1 AS d, [node] AS path FROM a UNION ALL SELECT e.dst, b.d + 1, min(list_append(b.path, e.dst)) FROM best b JOIN edges e ON e.src = b.node JOIN level l ON l.node = e.dst AND l.d = b.d + 1 GROUP BY e.dst, b.d)
SELECT CAST(d AS BIGINT) AS nodes, array_to_string(path, '>') AS path FROM best WHERE node = (SELECT node FROM seed)""",
)

# ---- components ------------------------------------------------------------

_CLOSURE = """, imp AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'imports'), cl AS MATERIALIZED (SELECT src, dst FROM imp UNION SELECT cl.src, imp.dst FROM cl JOIN imp ON imp.src = cl.dst),
scc AS MATERIALIZED (SELECT a.src AS node, min(a.dst) AS component FROM cl a JOIN cl b ON a.src = b.dst AND a.dst = b.src WHERE a.src IN (SELECT x.src FROM cl x JOIN cl y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst) GROUP BY a.src) """
_add("scc_members", lambda g: graph.strong_components(graph.arcs(g.edges, ["imports"])), _CLOSURE + "SELECT node, component FROM scc")
_TREE = """, w AS MATERIALIZED (SELECT component, src, dst FROM imp JOIN scc a ON a.node = src JOIN (SELECT node, component AS other FROM scc) b ON b.node = dst WHERE component = other AND src <> dst),
ways AS MATERIALIZED (SELECT component, false AS against, src AS node, dst FROM w UNION ALL SELECT component, true, dst, src FROM w), roots AS (SELECT DISTINCT component, against, component AS node FROM ways),
near AS (SELECT *, 0 AS d FROM roots UNION SELECT component, against, b.dst, d + 1 FROM near JOIN ways b USING (component, against, node) WHERE d < 60),
level AS MATERIALIZED (SELECT component, against, node, min(d) AS d FROM near GROUP BY ALL),
tree AS (SELECT component, against, node, 0 AS d, [node] AS path FROM roots UNION ALL SELECT t.component, t.against, b.dst, t.d + 1, arg_min(list_append(path, b.dst), t.node) FROM tree t JOIN ways b ON b.component = t.component AND b.against = t.against AND b.node = t.node
  JOIN level l ON l.component = t.component AND l.against = t.against AND l.node = b.dst AND l.d = t.d + 1 GROUP BY ALL),
walk AS (SELECT w.component, list_concat(list_reverse(h.path), a.path[2:]) AS walk FROM w JOIN tree a ON NOT a.against AND a.component = w.component AND a.node = w.src JOIN tree h ON h.against AND h.component = w.component AND h.node = w.dst
  JOIN tree o ON NOT o.against AND o.component = w.component AND o.node = w.dst WHERE len(o.path) = 1 OR o.path[-2] <> w.src),
short AS (SELECT component, list_reduce(list_transform(walk, lambda x: [x]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a[:list_position(a, x[1])] ELSE list_concat(a, x) END) AS c FROM walk) """
_add(
    "cycle_basis",
    lambda g: cycles.cycle_basis(graph.arcs(g.edges, ["imports"])).select("component", _path("cycle").alias("cycle")),
    _CLOSURE + _TREE + """SELECT DISTINCT component, array_to_string(list_concat(list_concat(c[list_position(c, list_min(c)):], c[:list_position(c, list_min(c)) - 1]), [list_min(c)]), '>') AS cycle FROM short
UNION ALL SELECT coalesce(component, src), src || '>' || dst FROM imp LEFT JOIN scc ON node = src WHERE src = dst""",
)
_add("cycles_containing", lambda g: _one_component(g), _CLOSURE + "SELECT node FROM scc WHERE component = (SELECT min(component) FROM scc)")


def _one_component(g: Graph) -> DataFrame:
    found = graph.strong_components(graph.arcs(g.edges, ["imports"]))
    first = found.agg(F.min("component").alias("component"))
    return found.join(first, "component").select("node")


_add("graph_is_cyclic", lambda g: g.spark.createDataFrame([(graph.is_cyclic(graph.arcs(g.edges, ["imports"])),)], "is_cyclic boolean"), _CLOSURE + "SELECT count(*) > 0 AS is_cyclic FROM cl WHERE src = dst")
_add("graph_stats", lambda g: graph.stats(g.symbols, g.edges), _hops(_ANY, 8, "(SELECT node FROM seed)") + "SELECT (SELECT count(*) FROM (SELECT fqn FROM symbols UNION SELECT src FROM edges UNION SELECT dst FROM edges)) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM hop WHERE depth > 0 AND node = seed) > 0 AS is_cyclic")
_add("module_cycles", lambda g: graph.strong_components(stats.module_dependencies(g.edges).select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))), """, imp AS (SELECT DISTINCT split_part(src, '::', 1) AS src, split_part(dst, '::', 1) AS dst FROM edges WHERE edge_type = 'imports'), cl AS MATERIALIZED (SELECT src, dst FROM imp WHERE src <> dst UNION SELECT cl.src, imp.dst FROM cl JOIN imp ON imp.src = cl.dst AND imp.src <> imp.dst)
SELECT a.src AS node, min(a.dst) AS component FROM cl a JOIN cl b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1""")

# ---- statistics ------------------------------------------------------------

_FAN = """, fan AS MATERIALIZED (SELECT fqn, name, kind, id, file_id, signature, coalesce(o.c, 0) AS n_out, coalesce(i.c, 0) AS n_in FROM symbols LEFT JOIN (SELECT src, count(*) AS c FROM calls GROUP BY 1) o ON o.src = fqn LEFT JOIN (SELECT dst, count(*) AS c FROM calls GROUP BY 1) i ON i.dst = fqn) """
_add("stats_by_kind", lambda g: stats.by_kind(g.symbols), "SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
_add("stats_by_edge_type", lambda g: stats.by_edge_type(g.edges), "SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
_add("stats_by_type_resolution", lambda g: stats.by_type_and_resolution(g.edges), "SELECT edge_type, resolution, count(*) AS n FROM edges GROUP BY 1, 2")
_add("stats_totals", lambda g: stats.totals(g.symbols, g.files, g.edges), "SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges")
_add("distinct_file_count", lambda g: stats.distinct_files(g.snapshots), "SELECT count(DISTINCT path) AS n FROM snapshots")
_add("degree_centrality", lambda g: stats.centrality(g.symbols, g.edges), "SELECT fqn, name, coalesce(o.c, 0) + coalesce(i.c, 0) AS degree FROM symbols LEFT JOIN (SELECT src, count(DISTINCT dst) AS c FROM edges GROUP BY 1) o ON o.src = fqn LEFT JOIN (SELECT dst, count(DISTINCT src) AS c FROM edges GROUP BY 1) i ON i.dst = fqn WHERE coalesce(o.c, 0) + coalesce(i.c, 0) > 2")
_add("file_summary", lambda g: stats.file_summary(g.symbols, g.files, g.edges), "SELECT path, count(DISTINCT s.id) AS symbol_count, count(DISTINCT e.id) AS edge_count FROM files f JOIN symbols s ON s.file_id = f.id LEFT JOIN edges e ON e.src = s.fqn OR e.dst = s.fqn GROUP BY path".replace("LEFT JOIN edges e ON e.src = s.fqn OR e.dst = s.fqn", "LEFT JOIN (SELECT id, src AS fqn FROM edges UNION SELECT id, dst FROM edges) e ON e.fqn = s.fqn"))
_add("file_kinds", lambda g: stats.file_kinds(g.symbols, g.files), "SELECT path, kind, count(*) AS n FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY 1, 2")
_add(
    "code_summary",
    lambda g: stats.code_summary(g.symbols, g.files, g.edges).select("path", "total_symbols", _path("main_classes").alias("main_classes"), _path("main_functions").alias("main_functions"), "total_complexity", F.round("average_complexity", 6).alias("average_complexity")),
    _FAN + """SELECT path, count(*) AS total_symbols, coalesce(string_agg(name, '>' ORDER BY name) FILTER (kind = 'class'), '') AS main_classes, coalesce(string_agg(name, '>' ORDER BY name) FILTER (kind = 'function'), '') AS main_functions,
CAST(coalesce(sum(n_out + 1) FILTER (kind = 'function'), 0) AS BIGINT) AS total_complexity, round(coalesce(avg(n_out + 1) FILTER (kind = 'function'), 0), 6) AS average_complexity FROM fan JOIN files f ON f.id = file_id GROUP BY path""",
)
_add("module_dependencies", lambda g: stats.module_dependencies(g.edges), "SELECT DISTINCT split_part(src, '::', 1) AS src_module, split_part(dst, '::', 1) AS dst_module FROM edges WHERE edge_type = 'imports' AND split_part(src, '::', 1) <> split_part(dst, '::', 1)")
_add("codebase_report", lambda g: stats.report(g.symbols, g.edges), _FAN + "SELECT 'entry_point' AS what, fqn, n_in AS n FROM fan WHERE kind = 'function' AND n_in <= 1 UNION ALL SELECT 'complex_function', fqn, n_out FROM fan WHERE kind = 'function' AND n_out > 10")
_add("throughput_metrics", lambda g: stats.throughput(g.snapshots, 7.0).withColumn("files_per_second", F.round("files_per_second", 6)), "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(count(*) / 7.0, 6) AS files_per_second, CASE WHEN count(*) / 7.0 > 10 THEN 'high' WHEN count(*) / 7.0 > 1 THEN 'moderate' ELSE 'low' END AS rating FROM snapshots")



def _overview() -> str:
    closed = _ORACLES["cycle_basis"].removeprefix(ORACLE)
    fan, tail = _FAN.lstrip(" ,"), closed.rindex("SELECT DISTINCT component")
    return closed[:tail] + f""", basis AS (SELECT cycle, CAST(len(string_split(cycle, '>')) - 1 AS BIGINT) AS n FROM ({closed[tail:]})), {fan}
SELECT 'total' AS what, 'files' AS subject, count(*) AS n FROM files UNION ALL SELECT 'total', 'symbols', count(*) FROM symbols UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'kind', kind, count(*) FROM symbols GROUP BY kind UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edges GROUP BY edge_type
UNION ALL (SELECT 'cycle', cycle, n FROM basis ORDER BY cycle LIMIT 10)
UNION ALL (SELECT 'entry_point', fqn, n_in FROM fan WHERE kind = 'function' AND n_in <= 1 ORDER BY fqn LIMIT 20)
UNION ALL (SELECT 'complex_function', fqn, n_out FROM fan WHERE kind = 'function' AND n_out > 10 ORDER BY n_out DESC, fqn LIMIT 10)"""


_add("codebase_overview", lambda g: stats.overview(g.symbols, g.files, g.kept, cycles.cycle_basis(graph.arcs(g.kept, ["imports"]))), _overview().removeprefix(ORACLE))

# ---- scalar functions ------------------------------------------------------

_add("sig_params", lambda g: g.symbols.select("id", F.array_join(F.coalesce(text.params(F.col("signature")), F.array().cast("array<string>")), ";").alias("params")), """SELECT id, coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(signature, '\\(([^)]*)\\)', 1), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: trim(split_part(x, ':', 1)) || ':' || CASE WHEN contains(x, ':') THEN trim(split_part(x, ':', 2)) ELSE 'Any' END), ';'), '') AS params FROM symbols""")
_add("return_type", lambda g: g.symbols.select("id", text.return_type(F.col("signature")).alias("returns")), "SELECT id, CASE WHEN contains(signature, '->') THEN trim(split_part(signature, '->', 2)) END AS returns FROM symbols")
_add("param_count", lambda g: g.symbols.select("id", F.coalesce(text.param_count(F.col("signature")), F.lit(0)).cast("long").alias("n")), "SELECT id, CAST(CASE WHEN contains(signature, '(') THEN length(signature) - length(replace(signature, ',', '')) + 1 ELSE 0 END AS BIGINT) AS n FROM symbols")
_add("privilege", lambda g: g.symbols.select("id", text.privilege(F.col("fqn")).alias("privilege")), f"SELECT id, CASE WHEN {_any('fqn', ('admin', 'superuser', 'root'))} THEN 'admin' WHEN {_any('fqn', ('system', 'internal', 'private'))} THEN 'system' ELSE 'user' END AS privilege FROM symbols")
_LAYER = "CASE " + " ".join(f"WHEN {_any('{0}', w)} THEN '{k}'" for k, w in text.LAYERS.items()) + " ELSE 'unknown' END"
_add("layer", lambda g: g.symbols.select("id", text.layer(F.col("name")).alias("layer")), f"SELECT id, {_LAYER.format('name')} AS layer FROM symbols")
_PURPOSE = "CASE " + " ".join(f"WHEN {_any('name', w)} THEN '{k}'" for w, k in text.PURPOSES) + f" WHEN n_out > 5 THEN '{text.MANY_CALLS}' WHEN n_out = 0 THEN '{text.NO_CALLS}' ELSE '{text.SOME_CALLS}' END"
_add("purpose", lambda g: stats.with_fan(g.symbols, g.edges, ["calls"]).select("fqn", text.purpose(F.col("name"), F.col("n_out")).alias("purpose")), _FAN + f"SELECT fqn, {_PURPOSE} AS purpose FROM fan")
_add("jaccard_chars", lambda g: g.symbols.select("id", F.round(text.char_jaccard(F.col("name"), F.col("docstring")), 6).alias("similarity")), "SELECT id, round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT id, list_distinct(string_split(lower(name), '')) AS a, list_distinct(string_split(lower(docstring), '')) AS b FROM symbols)")
_add("tiered_similarity", lambda g: g.symbols.select("id", F.round(text.name_similarity(F.col("name"), F.lit("get_user_query")), 6).alias("similarity")), "SELECT id, round(CASE WHEN lower(name) = 'get_user_query' THEN 1.0 WHEN contains(lower(name), 'get_user_query') OR contains('get_user_query', lower(name)) THEN 0.8 ELSE len(list_intersect(t, ['get', 'user', 'query'])) * 1.0 / len(list_distinct(list_concat(t, ['get', 'user', 'query']))) END, 6) AS similarity FROM (SELECT id, name, list_distinct(string_split(lower(name), '_')) AS t FROM symbols)")
_add("feature_keywords", lambda g: g.symbols.select("id", F.explode(F.array_compact(F.array(*[F.when(text.has_any(F.col("fqn"), (k,)), v) for k, v in text.FEATURES.items()]))).alias("feature")), " UNION ALL ".join(f"SELECT id, '{v}' AS feature FROM symbols WHERE contains(lower(fqn), '{k}')" for k, v in text.FEATURES.items()))

# ---- rules -----------------------------------------------------------------


def _fresh(found: DataFrame) -> DataFrame:
    return found.select("type", "severity", "symbol", "detail")


def _issues(kind: str, severity: str, body: str) -> str:
    return f"SELECT '{kind}' AS type, '{severity}' AS severity, symbol, detail FROM ({body})"


def _pat(words, where: str) -> str:
    return " UNION ALL ".join(f"SELECT *, '{w}' AS pattern FROM symbols WHERE contains(lower(name), '{w}') AND {where}" for w in words)


_add("hardcoded_secrets", lambda g: _fresh(rules.hardcoded_secrets(g.symbols)), _issues("hardcoded_secret", "high", f"SELECT fqn AS symbol, pattern AS detail FROM ({_pat(text.SECRET_PATTERNS, 'kind = $$variable$$')}) WHERE {_any('name', text.SECRET_NAMES)}"))
_add("command_injection", lambda g: _fresh(rules.command_injection(g.symbols, g.edges)), _issues("command_injection", "critical", f"SELECT fqn AS symbol, src AS detail FROM ({_pat(text.COMMANDS, 'true')}) JOIN calls ON dst = fqn WHERE {_any('src', text.INPUT_USER)}"))
_add("sql_injection_callers", lambda g: _fresh(rules.sql_injection_callers(g.symbols, g.edges)), _issues("sql_injection", "critical", f"SELECT fqn AS symbol, src AS detail FROM ({_pat(('query', 'execute'), 'kind = $$method$$')} UNION ALL {_pat(('sql',), 'kind = $$function$$')}) JOIN calls ON dst = fqn WHERE {_any('src', text.INPUT_USER)}"))
_add("missing_auth", lambda g: _fresh(rules.missing_auth(g.symbols, g.edges)), _issues("missing_authentication", "high", f"SELECT fqn AS symbol, pattern AS detail FROM ({_pat(text.ENDPOINTS_VERBS, 'kind IN ($$function$$, $$method$$)')}) WHERE {_any('name', text.VERB_PREFIXES)} AND NOT {_any('name', text.AUTH_CALLS)} AND fqn NOT IN (SELECT src FROM calls WHERE {_any('dst', text.AUTH_CALLS)})"))
_add("unsafe_deserialization", lambda g: _fresh(rules.unsafe_deserialization(g.symbols, g.edges)), _issues("unsafe_deserialization", "high", f"SELECT fqn AS symbol, pattern AS detail FROM ({_pat(text.DESERIALISERS, 'true')}) WHERE fqn IN (SELECT dst FROM calls WHERE {_any('src', text.INPUT_USER)})"))
_add(
    "analyse_symbols",
    lambda g: rules.analyse_symbols(g.symbols, g.edges).select("type", "severity", "symbol"),
    f"""SELECT 'sql_injection' AS type, 'critical' AS severity, fqn AS symbol FROM symbols WHERE (contains(lower(name), 'query') OR contains(lower(name), 'sql')) AND fqn IN (SELECT dst FROM calls WHERE {_any('src', text.INPUT_USER)}) AND ({_any('fqn', text.DATABASE_SQL)} OR fqn IN (SELECT src FROM calls WHERE {_any('dst', text.DATABASE_SQL)}))
UNION ALL SELECT 'command_injection', 'critical', fqn FROM symbols WHERE {_any('name', text.DANGEROUS)} AND {_any('fqn', text.INPUT_USER)}
UNION ALL SELECT 'hardcoded_secret', 'high', fqn FROM symbols WHERE {_any('name', text.SECRET_NAMES)} AND kind = 'variable'
UNION ALL SELECT 'missing_validation', 'medium', fqn FROM symbols WHERE {_any('fqn', text.INPUT_USER)} AND fqn NOT IN (SELECT src FROM calls WHERE {_any('dst', text.VALIDATION)})""",
)
_DEEP = "SELECT fqn AS node FROM symbols WHERE kind = 'function' AND (contains(lower(name), 'query') OR contains(lower(name), 'execute'))"
_SQLI = _walks(3, _DEEP, _UP) + """SELECT 'sql_injection' AS type, 'critical' AS severity, seed AS symbol, array_to_string(path, ' <- ') AS detail FROM walk JOIN (SELECT fqn, CAST(contains(lower(name), 'query') AS INTEGER) + CAST(contains(lower(name), 'execute') AS INTEGER) AS times FROM symbols) s ON s.fqn = seed, unnest(range(times)) WHERE len(path) > 1 AND {} AND len(list_filter(path, lambda x: {})) = 0"""
_CLEAN = _any("split_part(x, '::', 2)", text.SANITISERS)
_add("sql_injection_literal", lambda g: _fresh(rules.sql_injection(g.symbols, g.edges, literal=True)), _SQLI.format(_any("split_part(path[1], '::', 2)", text.INPUT), _CLEAN))
_add("sql_injection_paths", lambda g: _fresh(rules.sql_injection(g.symbols, g.edges)), _SQLI.format(_any("split_part(node, '::', 2)", text.INPUT), _CLEAN))
_add("auth_bypass", lambda g: _fresh(rules.auth_bypass(g.symbols, g.edges)), _hops("SELECT src, dst FROM calls", 2, "(SELECT fqn AS node FROM symbols WHERE kind = 'function')") + _issues("missing_authentication", "high", f"SELECT fqn AS symbol, pattern AS detail FROM ({_pat(text.ENDPOINTS, 'kind = $$function$$')}) WHERE fqn NOT IN (SELECT seed FROM hop WHERE {_any(_tail('node'), text.AUTH_REGEX)})"))
_add("unsafe_ops", lambda g: _fresh(rules.unsafe_operations(g.symbols, g.edges)), _walks(2, "SELECT fqn AS node FROM symbols", _UP) + _issues("unsafe_all", "high", f"SELECT fqn AS symbol, node AS detail FROM ({_pat(sum(text.UNSAFE.values(), ()), 'true')}) JOIN walk ON seed = fqn WHERE len(path) > 1 AND {_any(_tail('node'), text.INPUT)}"))
_FLOW = "SELECT seed AS source, node AS sink, array_to_string(path, '>') AS path, len(list_filter(path, lambda x: {0})) > 0 AS sanitised FROM walk WHERE len(path) > 1 AND {1}"
_add("data_flow", lambda g: rules.data_flow(g.symbols, g.edges, "request", 3).select("source", "sink", _path("path").alias("path"), "sanitised"), _walks(3, "SELECT fqn AS node FROM symbols WHERE name ILIKE '%request%'") + _FLOW.format(_CLEAN, _any(_tail("node"), text.SINKS)))
_add(
    "taint_flows",
    lambda g: taint.flows(g.edges, lookup.find(g.symbols, "request").select(F.col("fqn").alias("node")), depth=5).select("source", "sink", "tainted", "depth", _path("path").alias("path")),
    f""", hop AS (SELECT DISTINCT src AS node, dst, {_any(_tail('dst'), text.SANITISERS)} AS cleans FROM calls),
start AS (SELECT DISTINCT fqn AS seed, fqn AS node, {_any('name', text.SANITISERS)} AS clean FROM symbols WHERE name ILIKE '%request%'),
state AS (SELECT seed, node, clean, 0 AS depth FROM start UNION SELECT seed, dst, clean OR cleans, depth + 1 FROM state JOIN hop USING (node) WHERE depth < 5),
level AS MATERIALIZED (SELECT seed, node, clean, min(depth) AS depth FROM state GROUP BY ALL),
best AS (SELECT seed, node, clean, 0 AS depth, [node] AS path FROM start UNION ALL
  SELECT b.seed, h.dst, b.clean OR h.cleans, b.depth + 1, arg_min(list_append(b.path, h.dst), (b.node, b.clean)) FROM best b JOIN hop h ON h.node = b.node
    JOIN level l ON l.seed = b.seed AND l.node = h.dst AND l.clean = (b.clean OR h.cleans) AND l.depth = b.depth + 1 GROUP BY ALL)
SELECT seed AS source, node AS sink, NOT clean AS tainted, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM best WHERE depth > 0 AND {_any(_tail('node'), text.SINKS)}""",
)
_add("tainted_paths", lambda g: rules.tainted_paths(g.symbols, g.edges, "parse_body", 3).select("source", "sink", _path("path").alias("path"), "sanitised"), _walks(3, "SELECT fqn AS node FROM symbols WHERE name ILIKE '%parse_body%'") + _FLOW.format(_CLEAN, _any(_tail("node"), text.SINKS) + f" AND len(list_filter(path, lambda x: {_CLEAN})) = 0"))
_add("complexity", lambda g: rules.complexity(g.symbols, g.edges), _FAN + "SELECT fqn, n_out + 1 AS cyclomatic, n_out * 2 AS cognitive, CAST(CASE WHEN contains(signature, '(') THEN length(signature) - length(replace(signature, ',', '')) + 1 ELSE 0 END AS BIGINT) AS parameter_count, n_out + 1 > 10 OR n_out * 2 > 15 AS is_complex FROM fan")
_add("code_smells", lambda g: _fresh(rules.code_smells(g.symbols, g.edges)), _FAN + f"SELECT 'long_identifier' AS type, 'low' AS severity, fqn AS symbol, NULL::VARCHAR AS detail FROM fan WHERE length(name) > 50 UNION ALL SELECT 'god_function', 'medium', fqn, CAST(n_out AS VARCHAR) FROM fan WHERE kind = 'function' AND n_out > 20 UNION ALL SELECT 'dead_code', 'low', fqn, NULL FROM fan WHERE kind IN ('function', 'method') AND n_in = 0 AND NOT {_any('name', text.ENTRIES)}")
_NAMES = ", cn AS MATERIALIZED (SELECT src AS fqn, list(DISTINCT split_part(dst, '::', 2)) AS callees FROM calls GROUP BY 1) "
_add(
    "duplicate_pairs",
    lambda g: rules.duplicates(g.symbols, g.edges, 0.5).withColumn("similarity", F.round("similarity", 6)),
    _NAMES + """, s AS MATERIALIZED (SELECT id, name, split_part(name, '_', 1) AS prefix, callees, list_distinct(string_split(lower(name), '')) AS cs FROM symbols JOIN cn USING (fqn))
SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT a.id AS a, b.id AS b, (len(list_intersect(a.cs, b.cs)) * 1.0 / len(list_distinct(list_concat(a.cs, b.cs))) + len(list_intersect(a.callees, b.callees)) * 1.0 / len(list_distinct(list_concat(a.callees, b.callees)))) / 2 AS similarity, len(list_intersect(a.callees, b.callees)) AS shared FROM s a JOIN s b ON a.prefix = b.prefix AND a.id < b.id) WHERE similarity > 0.5 AND shared > 0""",
)
_add(
    "similar_code",
    lambda g: rules.similar_code(g.symbols, g.edges, g.hub, 0.1),
    _NAMES + """, s AS MATERIALIZED (SELECT x.fqn, x.name, x.kind, coalesce(callees, []) AS callees, list_distinct(string_split(lower(x.name), '_')) AS t FROM symbols x LEFT JOIN cn USING (fqn)), r AS (SELECT * FROM s WHERE fqn = (SELECT node FROM seed))
SELECT fqn, similarity FROM (SELECT s.fqn, round(0.3 * CASE WHEN lower(r.name) = lower(s.name) THEN 1.0 WHEN contains(lower(r.name), lower(s.name)) OR contains(lower(s.name), lower(r.name)) THEN 0.8 ELSE len(list_intersect(s.t, r.t)) * 1.0 / len(list_distinct(list_concat(s.t, r.t))) END
 + 0.7 * CASE WHEN len(s.callees) + len(r.callees) = 0 THEN 0.0 ELSE len(list_intersect(s.callees, r.callees)) * 1.0 / len(list_distinct(list_concat(s.callees, r.callees))) END, 6) AS similarity FROM s, r WHERE s.kind = 'function' AND s.fqn <> r.fqn) WHERE similarity >= 0.1""",
)
_MODNAME = _LAYER.format("src_module"), _LAYER.format("dst_module")
_add(
    "layer_violations",
    lambda g: rules.layer_violations(g.edges, of=lambda c: text.prefix(F.split_part(c, F.lit("::"), F.lit(2)))),
    f""", d AS (SELECT DISTINCT split_part(split_part(src, '::', 2), '_', 1) AS src_module, split_part(split_part(dst, '::', 2), '_', 1) AS dst_module FROM edges WHERE edge_type = 'imports'), l AS (SELECT *, {_MODNAME[0]} AS from_layer, {_MODNAME[1]} AS to_layer FROM d WHERE src_module <> dst_module)
SELECT * FROM l WHERE from_layer <> to_layer AND NOT (from_layer = 'presentation' AND to_layer = 'business') AND NOT (from_layer = 'business' AND to_layer = 'data')""",
)
_add("god_modules", lambda g: rules.god_modules(g.edges), "SELECT src_module, count(*) AS n FROM (SELECT DISTINCT split_part(src, '::', 1) AS src_module, split_part(dst, '::', 1) AS dst_module FROM edges WHERE edge_type = 'imports') WHERE src_module <> dst_module GROUP BY 1 HAVING count(*) > 10")
_TESTS = """, tests AS MATERIALIZED (SELECT key, count(DISTINCT id) AS tests FROM (SELECT id, regexp_extract(lower(name), 'test_(.+)$', 1) AS key FROM symbols WHERE kind = 'function' UNION ALL SELECT id, regexp_extract(lower(name), '^(.+)_test', 1) FROM symbols WHERE kind = 'function' UNION ALL SELECT id, regexp_extract(lower(name), 'test([^_].*)$', 1) FROM symbols WHERE kind = 'function') WHERE key <> '' GROUP BY key) """
_add(
    "change_impact",
    lambda g: rules.change_impact(g.symbols, g.edges, 3),
    _TESTS + _hops(_UP, 3, "(SELECT fqn AS node FROM symbols)") + """, near AS (SELECT seed, node, min(depth) AS depth FROM hop WHERE depth > 0 GROUP BY 1, 2), n AS (SELECT seed, count(*) FILTER (depth = 1) AS direct, count(*) AS transitive FROM near GROUP BY 1)
SELECT fqn, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, round(least(1.0, coalesce(direct, 0) * 0.1 + coalesce(transitive, 0) * 0.01)::DOUBLE * CASE WHEN tests > 0 THEN 0.7 ELSE 1.0 END, 6) AS risk FROM symbols LEFT JOIN n ON seed = fqn LEFT JOIN tests ON key = lower(name)""",
)
_add("explain_function", lambda g: rules.explain(g.symbols, g.edges).select("fqn", "purpose", "cyclomatic", "side_effects", "test_coverage"), _TESTS + _FAN + _hops("SELECT src, dst FROM calls", 2, "(SELECT fqn AS node FROM symbols)") + f""", fx AS (SELECT seed, count(DISTINCT CASE WHEN {_any(_tail('node'), text.MODIFIES)} THEN 'm' || node WHEN {_any(_tail('node'), text.CALLS_OUT)} THEN 'c' || node WHEN {_any(_tail('node'), text.PRINTS)} THEN 'p' || node END) AS n FROM hop WHERE depth > 0 GROUP BY 1)
SELECT fan.fqn, {_PURPOSE} AS purpose, n_out + 1 AS cyclomatic, coalesce(n, 0) AS side_effects, CASE WHEN tests > 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS test_coverage FROM fan LEFT JOIN fx ON seed = fan.fqn LEFT JOIN tests ON key = lower(name)""")
def _alike() -> str:
    """All pairs of functions that share a callee, by the weighted likeness."""
    same = "CASE WHEN lower(x.name) = lower(y.name) THEN 1.0 WHEN contains(lower(x.name), lower(y.name)) OR contains(lower(y.name), lower(x.name)) THEN 0.8 ELSE len(list_intersect(x.t, y.t)) * 1.0 / len(list_distinct(list_concat(x.t, y.t))) END"
    return f""", f AS MATERIALIZED (SELECT fqn, name, callees, list_distinct(string_split(lower(name), '_')) AS t FROM symbols JOIN cn USING (fqn) WHERE kind = 'function'),
shared AS MATERIALIZED (SELECT DISTINCT a.fqn AS a, b.fqn AS b FROM (SELECT fqn, unnest(callees) AS c FROM f) a JOIN (SELECT fqn, unnest(callees) AS c FROM f) b ON a.c = b.c AND a.fqn < b.fqn),
alike AS MATERIALIZED (SELECT a, b, round(0.3 * {same} + 0.7 * len(list_intersect(x.callees, y.callees)) / len(list_distinct(list_concat(x.callees, y.callees))), 6) AS similarity
  FROM shared JOIN f x ON x.fqn = a JOIN f y ON y.fqn = b) """


_WORD = ", wn AS MATERIALIZED (SELECT fqn, list_distinct(list_transform(callees, lambda c: regexp_replace(c, '_[0-9].*$', ''))) AS callees FROM cn)"
_add(
    "similar_functions",
    lambda g: similar.similar_functions(g.symbols, g.edges, 0.5, lambda c: F.regexp_replace(c, "_[0-9].*$", "")),
    _NAMES + _WORD + _alike().replace("JOIN cn USING", "JOIN wn USING") + "SELECT a, b, similarity FROM alike WHERE similarity >= 0.5",
)
_add("refactor_suggestions", lambda g: rules.refactorings(g.symbols, g.edges, 0.4), _FAN + _NAMES + _alike() + "SELECT fqn, 'extract_method' AS type FROM fan WHERE n_out + 1 > 10 UNION ALL SELECT fqn, 'introduce_parameter_object' FROM fan WHERE contains(signature, '(') AND length(signature) - length(replace(signature, ',', '')) + 1 > 5 UNION ALL SELECT fqn, 'rename' FROM fan WHERE length(name) > 40 UNION ALL SELECT DISTINCT unnest([a, b]), 'merge_similar' FROM alike WHERE similarity >= 0.4")
_PARAMS = "coalesce(regexp_extract(signature, '\\(([^)]*)\\)', 1), '')"
_INPUT = f"({_any('fqn', text.INPUT)} OR {_any(_PARAMS, text.INPUT)})"
_add(
    "security_context",
    lambda g: rules.security_context(g.symbols, g.edges),
    _hops("SELECT src, dst FROM calls", 3, "(SELECT fqn AS node FROM symbols)") + f""", c AS (SELECT seed, bool_or({_any(_tail('node'), text.DATABASE)}) AS db, bool_or(depth <= 2 AND {_any(_tail('node'), text.CRYPTO)}) AS crypto FROM hop GROUP BY 1), s AS (SELECT fqn, {_INPUT} AS handles_user_input, db AS accesses_database, {_any('name', text.AUTH_WORDS)} AS performs_auth, crypto AS performs_crypto,
 CASE WHEN {_any('fqn', ('admin', 'superuser', 'root'))} THEN 'admin' WHEN {_any('fqn', ('system', 'internal', 'private'))} THEN 'system' ELSE 'user' END AS privilege FROM symbols JOIN c ON seed = fqn)
SELECT *, performs_auth OR performs_crypto OR (handles_user_input AND accesses_database) AS security_critical FROM s""",
)
_add("entry_points", lambda g: rules.entry_points(g.symbols, g.edges), _FAN + f"SELECT fqn FROM fan WHERE kind = 'function' AND (({_any('name', text.ENTRY_PATTERNS)} AND n_in <= 2) OR ({_any('name', text.ENDPOINTS_VIEW)} AND ({_any('name', text.VERBS)} OR {_INPUT})))")
_add("n_plus_one", lambda g: _fresh(rules.n_plus_one(g.symbols, g.edges)), _issues("n_plus_one", "medium", f"SELECT fqn AS symbol, src AS detail FROM symbols JOIN calls ON dst = fqn WHERE {_any('name', text.DATABASE)} AND {_any(_tail('src'), ('loop', 'for'))}"))
_add("review_by_severity", lambda g: rules.by_severity(rules.analyse_symbols(g.symbols, g.edges)), "SELECT severity, type, count(*) AS n, CAST(list_position(['critical', 'high', 'medium', 'low', 'info'], severity) AS INTEGER) AS rank FROM (" + _ORACLES["analyse_symbols"][len(ORACLE) :] + ") GROUP BY severity, type")

# ---- the pattern library ---------------------------------------------------

_add("co_callers", lambda g: lookup.sql(g.spark, g.views(), "SELECT DISTINCT a.src AS caller FROM edges a JOIN edges b ON a.src = b.src WHERE a.edge_type = 'calls' AND b.edge_type = 'calls' AND a.dst LIKE '%query%' AND b.dst LIKE '%request%'"), "SELECT src AS caller FROM calls WHERE contains(dst, 'query') INTERSECT SELECT src FROM calls WHERE contains(dst, 'request')")
_add(
    "class_method_count",
    lambda g: rules.methods_of_classes(g.symbols.withColumn("fqn", F.when(F.col("kind") == "method", F.concat(F.lit("pkg"), F.col("line").cast("string"), F.lit("::"), F.col("name"))).otherwise(F.concat(F.lit("pkg"), F.col("line").cast("string"))))),
    "SELECT c.fqn, count(DISTINCT m.id) AS methods FROM (SELECT DISTINCT 'pkg' || line AS fqn FROM symbols WHERE kind = 'class') c LEFT JOIN (SELECT id, 'pkg' || line || '::' || name AS fqn FROM symbols WHERE kind = 'method') m ON m.fqn LIKE c.fqn || '::%' GROUP BY c.fqn",
)
_add("input_to_db", lambda g: lookup.sql(g.spark, g.views(), "SELECT DISTINCT s.fqn, s.name FROM symbols s WHERE (s.name LIKE '%request%' OR s.name LIKE '%input%') AND EXISTS (SELECT 1 FROM edges e WHERE e.src = s.fqn AND e.dst IN (SELECT fqn FROM symbols WHERE name LIKE '%query%' OR name LIKE '%database%'))"), "SELECT DISTINCT s.fqn, s.name FROM symbols s JOIN edges e ON e.src = s.fqn JOIN symbols d ON d.fqn = e.dst WHERE (s.name LIKE '%request%' OR s.name LIKE '%input%') AND (d.name LIKE '%query%' OR d.name LIKE '%database%')")
_add("tested_status", lambda g: g.symbols.filter("kind = 'function'").join(graph.arcs(g.edges, ["calls"]).filter("src like '%test%'").select(F.col("dst").alias("fqn")).distinct().withColumn("t", F.lit(True)), "fqn", "left").select("fqn", F.when(F.col("t"), "tested").otherwise("untested").alias("status")), "SELECT fqn, CASE WHEN EXISTS (SELECT 1 FROM calls WHERE dst = fqn AND src LIKE '%test%') THEN 'tested' ELSE 'untested' END AS status FROM symbols WHERE kind = 'function'")
_add("mutual_imports", lambda g: graph.arcs(g.edges, ["imports"]).alias("a").join(graph.arcs(g.edges, ["imports"]).alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).filter("a.src < a.dst").select(F.col("a.src").alias("a"), F.col("a.dst").alias("b")), "SELECT a.src AS a, a.dst AS b FROM (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'imports') a JOIN (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'imports') b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")

# ---- snapshots -------------------------------------------------------------


def _of(g: Graph, commit: int) -> DataFrame:
    return store.upsert(g.snapshots, ["commit_id", "path"]).filter(F.col("commit_id") == commit)


_LATEST = ", latest AS MATERIALIZED (SELECT commit_id, path, max_by(content_hash, seq) AS content_hash, max_by(size_bytes, seq) AS size_bytes, max(seq) AS seq FROM snapshots GROUP BY 1, 2) "
_add("upsert_latest", lambda g: store.upsert(g.snapshots, ["commit_id", "path"]).select("commit_id", "path", "content_hash", "seq"), _LATEST + "SELECT commit_id, path, content_hash, seq FROM latest")
_add("snapshot_diff", lambda g: store.snapshot_diff(_of(g, 1), _of(g, 2)), _LATEST + "SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'modified' END AS change FROM (SELECT * FROM latest WHERE commit_id = 1) a FULL JOIN (SELECT * FROM latest WHERE commit_id = 2) b ON a.path = b.path) WHERE change IS NOT NULL")
_add("changed_files", lambda g: store.changed_files(_of(g, 2), _of(g, 1)), _LATEST + "SELECT b.path FROM latest b LEFT JOIN latest a ON a.path = b.path AND a.commit_id = 1 WHERE b.commit_id = 2 AND b.content_hash IS DISTINCT FROM a.content_hash")
_add("dirty_closure", lambda g: store.dirty_closure(g.files.filter("language = 'go'").select("path"), g.file_edges), "SELECT path FROM files WHERE language = 'go' UNION SELECT file_src FROM file_edges WHERE edge_type IN ('imports', 'calls') AND file_dst IN (SELECT path FROM files WHERE language = 'go')")
_add(
    "delete_slice",
    lambda g: store.delete_slice(*_slice_tables(g), g.files.filter("language = 'rust'").select(F.lit(1).alias("commit_id"), "path"))[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT edge_type, count(*) AS n FROM file_edges WHERE file_src NOT IN (SELECT path FROM files WHERE language = 'rust') AND file_dst NOT IN (SELECT path FROM files WHERE language = 'rust') GROUP BY 1",
)


def _slice_tables(g: Graph):
    e = g.file_edges.withColumn("commit_id", F.lit(1))
    s = g.symbols.join(g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id").withColumn("commit_id", F.lit(1))
    return s, e, s.select("commit_id", "file_path")


# ---- bundles ---------------------------------------------------------------

_add(
    "cycle_list",
    lambda g: graph.cycles(graph.arcs(g.edges, ["imports"])).select("component", F.size("cycle").cast("long").alias("nodes"), (F.element_at("cycle", 1) == F.element_at("cycle", -1)).alias("closed")),
    _CLOSURE
    + """, own AS MATERIALIZED (SELECT src, dst, a.component AS c FROM imp JOIN scc a ON a.node = src JOIN scc b ON b.node = dst WHERE a.component = b.component AND src <> dst),
bfs AS (SELECT DISTINCT c, c AS node, 0 AS d FROM own UNION SELECT bfs.c, dst, d + 1 FROM bfs JOIN own ON own.c = bfs.c AND own.src = bfs.node WHERE d < 16 AND (d = 0 OR bfs.node <> bfs.c))
SELECT c AS component, CAST(min(d) + 1 AS BIGINT) AS nodes, true AS closed FROM bfs WHERE d > 0 AND node = c GROUP BY c
UNION ALL SELECT src, 2, true FROM imp WHERE src = dst AND src NOT IN (SELECT component FROM scc)""",
)
_IMPACT = _hops(_UP, 3)
_RELATED = """SELECT 'caller' AS relation, src AS node FROM calls WHERE dst = (SELECT node FROM seed) UNION ALL SELECT 'callee', dst FROM calls WHERE src = (SELECT node FROM seed)"""
_add(
    "related_code",
    lambda g: graph.related_code(g.edges, g.seed).select("relation", "node"),
    _IMPACT + _RELATED + " UNION ALL SELECT DISTINCT 'dependency_' || edge_type, dst FROM edges WHERE src = (SELECT node FROM seed) AND edge_type IN ('imports', 'calls', 'uses') UNION ALL SELECT 'impact', node FROM (" + _MIN.format("") + ")",
)
_add(
    "symbol_context",
    lambda g: graph.symbol_context(g.symbols, g.files, g.edges, g.seed).select("relation", "node"),
    _RELATED + " UNION ALL SELECT DISTINCT 'dependency_imports', dst FROM edges WHERE src = (SELECT node FROM seed) AND edge_type = 'imports' UNION ALL SELECT 'file', path FROM symbols s JOIN files f ON f.id = s.file_id WHERE fqn = (SELECT node FROM seed) UNION ALL SELECT 'sibling', b.fqn FROM symbols a JOIN symbols b ON a.file_id = b.file_id AND a.fqn <> b.fqn WHERE a.fqn = (SELECT node FROM seed)"
    " UNION ALL SELECT 'outgoing_' || edge_type, dst FROM edges WHERE src = (SELECT node FROM seed) UNION ALL SELECT 'incoming_' || edge_type, src FROM edges WHERE dst = (SELECT node FROM seed)"
    " UNION ALL SELECT DISTINCT 'neighbour', b.dst FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges UNION SELECT fqn, fqn FROM symbols) a JOIN (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges UNION SELECT fqn, fqn FROM symbols) b ON b.src = a.dst WHERE a.src = (SELECT node FROM seed) AND b.dst <> a.src",
)


def _body(name: str) -> str:
    return _ORACLES[name][len(ORACLE) :].removeprefix(_FAN)


_add(
    "full_review",
    lambda g: rules.review(g.symbols, g.files, g.edges).select("type", "severity", "symbol"),
    _FAN + " UNION ALL ".join(f"SELECT type, severity, symbol FROM ({_body(n)})" for n in ("analyse_symbols", "missing_auth", "code_smells", "n_plus_one")),
)
_add(
    "architecture_review",
    lambda g: rules.architecture_review(g.edges, layered=lambda c: text.prefix(F.split_part(c, F.lit("::"), F.lit(2)))),
    _body("module_cycles").split("\nSELECT")[0]
    + _body("layer_violations").split("\nSELECT")[0]
    + ", ring AS (SELECT"
    + _body("module_cycles").split("\nSELECT")[1]
    + ") SELECT 'module_cycle' AS finding, component AS subject, string_agg(node, '>' ORDER BY node) AS detail FROM ring GROUP BY component UNION ALL SELECT 'god_module', src_module, CAST(n AS VARCHAR) FROM ("
    + _body("god_modules")
    + ") UNION ALL SELECT 'layer_violation', src_module, dst_module FROM (SELECT"
    + _body("layer_violations").split("\nSELECT")[1]
    + ")",
)

for _more in (ingest_queries, extract_queries, index_queries, storage_queries):
    _QUERIES |= _more.QUERIES
    _ORACLES |= _more.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact radius of the most called symbol, with names, nearest first."""
    g = Graph(spark, sf_dir)
    return graph.hydrate(graph.impact_radius(g.edges, g.seed, 3), g.symbols).select("depth", "node", "name", "kind").orderBy("depth", "node")


def _run(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: query(Graph(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(q) for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
