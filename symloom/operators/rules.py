"""Security, quality and architecture rules over whole symbol tables.

Each rule is one plan: a filter on names joined with bounded calls of all
symbols at once.  Issues share the columns ``type severity symbol detail
confidence cwe``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.sources.session import cut, stored

from . import graph, propagate, similar, stats

ISSUE = ("type", "severity", "symbol", "detail", "confidence", "cwe")


def _issue(df: DataFrame, kind: str, severity: str, symbol: str | Column, detail: str | Column | None, confidence: float, cwe: str | None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), col(symbol).alias("symbol"), (F.lit(None).cast("string") if detail is None else col(detail)).alias("detail"),
        F.lit(confidence).alias("confidence"), F.lit(cwe).cast("string").alias("cwe"),
    )


def _name(fqn: str | Column) -> Column:
    return F.split_part(F.col(fqn) if isinstance(fqn, str) else fqn, F.lit("::"), F.lit(-1))


def _seeds(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("fqn").alias("node")).distinct()


def _patterns(symbols: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Symbols by each pattern they match; one that matches two comes twice."""
    each = F.explode(F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(F.col("name")), p)))
    return symbols.withColumn("pattern", each)


def _called(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with each distinct direct caller."""
    calls = graph.arcs(edges, ["calls"]).select(F.col("src").alias("caller"), F.col("dst").alias("fqn"))
    return symbols.join(calls, "fqn")


def _callee_flags(symbols: DataFrame, edges: DataFrame, wanted: dict[str, tuple[tuple[str, ...], int]]) -> DataFrame:
    """A column for each ``name: (words, depth)``: the symbol's name or that of a
    callee within the depth has one of the words."""
    pairs = cut(graph.arcs(edges, ["calls"], bag=True))
    bits = {column: 1 << i for i, column in enumerate(wanted)}
    mask = sum((F.when(text.has_any(_name("node"), words), bits[column]).otherwise(0) for column, (words, _) in wanted.items()), F.lit(0))
    levels = propagate.reach_flags(pairs, pairs.select(F.col("dst").alias("node")).distinct().withColumn("mask", mask), max(depth for _, depth in wanted.values()))
    for depth in sorted({depth for _, depth in wanted.values()}):
        symbols = symbols.join(levels[depth - 1].select(F.col("node").alias("fqn"), F.col("mask").alias("_mask")), "fqn", "left")
        for column, (words, own) in wanted.items():
            if own == depth:
                symbols = symbols.withColumn(column, (F.coalesce("_mask", F.lit(0)).bitwiseAND(bits[column]) != 0) | text.has_any(F.col("name"), words))
        symbols = symbols.drop("_mask")
    return symbols


# ---- data flow -------------------------------------------------------------


def data_flow(symbols: DataFrame, edges: DataFrame, source: str, depth: int = 4, sink: str | None = None) -> DataFrame:
    """``(source, sink, path, tainted, sanitised)`` of call paths from symbols
    named like the source: to the sink, or to any sensitive one."""
    seeds = _seeds(symbols.filter(F.col("name").ilike(f"%{source}%")))
    pairs = graph.arcs(edges, ["calls"])
    if sink is None:
        paths = graph.call_paths(pairs, seeds, depth).select("seed", "path")
        paths = paths.filter(text.has_any(_name(F.element_at("path", -1)), text.SINKS))
    else:
        paths = graph.simple_paths(pairs, seeds, depth, seeds.sparkSession.createDataFrame([(sink,)], "node string"))
    names = F.transform("path", lambda x: F.lower(F.split_part(x, F.lit("::"), F.lit(-1))))
    any_of = lambda words: F.exists(names, lambda n: n.rlike("|".join(words)))
    sanitised = any_of(text.SANITISERS)
    return paths.select(F.col("seed").alias("source"), F.element_at("path", -1).alias("sink"), "path", (~sanitised).alias("tainted"), sanitised.alias("sanitised"))


def tainted_paths(symbols: DataFrame, edges: DataFrame, source: str, depth: int = 4) -> DataFrame:
    """Flows from an input source that nothing sanitises; none for other names."""
    flows = data_flow(symbols, edges, source, depth).filter("tainted")
    gate = any(w in source.lower() for w in ("request", "req", "body", "params", "query", "args", "input", "stdin"))
    return flows if gate else flows.limit(0)


def sql_injection(symbols: DataFrame, edges: DataFrame, depth: int = 3, literal: bool = False) -> DataFrame:
    """Call paths into query functions that start in input handling.

    ``literal`` tests the query function itself; otherwise the caller at the
    path's far end.  Unsanitised paths count."""
    db = _patterns(symbols.filter(F.col("kind") == "function"), ("query", "execute"))
    up = graph.call_paths(graph.arcs(edges, ["calls"], reverse=True), _seeds(db), depth).select(F.col("seed").alias("fqn"), "path")
    hits = db.select("fqn", "pattern").join(up, "fqn")
    tested = F.element_at("path", 1 if literal else -1)
    names = F.transform("path", lambda x: F.lower(F.split_part(x, F.lit("::"), F.lit(-1))))
    clean = F.exists(names, lambda n: n.rlike("|".join(text.SANITISERS)))
    return _issue(hits.filter(text.has_any(_name(tested), text.INPUT) & ~clean), "sql_injection", "critical", "fqn", F.array_join("path", " <- "), 0.8, "CWE-89")


def auth_bypass(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints without an authentication call within two steps."""
    ends = _patterns(symbols.filter(F.col("kind") == "function"), text.ENDPOINTS)
    flagged = _callee_flags(ends, edges, {"auth": (text.AUTH_REGEX, 2)})
    return _issue(flagged.filter(~F.col("auth")), "missing_authentication", "high", "fqn", "pattern", 0.7, "CWE-306")


def unsafe_operations(symbols: DataFrame, edges: DataFrame, operation: str = "all") -> DataFrame:
    """Calls (within two steps) of unsafe functions that handle input."""
    words = sum(text.UNSAFE.values(), ()) if operation == "all" else text.UNSAFE.get(operation, ())
    found = _patterns(symbols, words).select("fqn", "pattern")
    up = graph.call_paths(graph.arcs(edges, ["calls"], reverse=True), _seeds(found), 2).select(F.col("seed").alias("fqn"), F.element_at("path", -1).alias("caller"))
    hits = found.join(up, "fqn").filter(text.has_any(_name("caller"), text.INPUT))
    return _issue(hits, f"unsafe_{operation}", "high", "fqn", "caller", 0.75, "CWE-94")


# ---- the second rule set ---------------------------------------------------


def sql_injection_callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each input-handling direct caller of a query function."""
    m, f = symbols.filter(F.col("kind") == "method"), symbols.filter(F.col("kind") == "function")
    db = _patterns(m, ("query", "execute")).union(_patterns(f, ("sql",)))
    hits = _called(db, edges).filter(text.has_any(F.col("caller"), text.INPUT_USER))
    return _issue(hits, "sql_injection", "critical", "fqn", "caller", 0.8, "CWE-89")


def command_injection(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    hits = _called(_patterns(symbols, text.COMMANDS), edges).filter(text.has_any(F.col("caller"), text.INPUT_USER))
    return _issue(hits, "command_injection", "critical", "fqn", "caller", 0.75, "CWE-78")


def missing_auth(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for every pattern an endpoint matches."""
    ends = _patterns(symbols.filter(F.col("kind").isin("function", "method")), text.ENDPOINTS_VERBS).filter(text.has_any(F.col("name"), text.VERB_PREFIXES))
    calls = graph.arcs(edges, ["calls"]).filter(text.has_any(F.col("dst"), text.AUTH_CALLS)).select(F.col("src").alias("fqn")).distinct().withColumn("auth", F.lit(True))
    bare = ends.join(calls, "fqn", "left").filter(F.col("auth").isNull() & ~text.has_any(F.col("name"), text.AUTH_CALLS))
    return _issue(bare, "missing_authentication", "high", "fqn", "pattern", 0.7, "CWE-306")


def hardcoded_secrets(symbols: DataFrame) -> DataFrame:
    found = _patterns(symbols.filter(F.col("kind").isin("variable", "constant")), text.SECRET_PATTERNS)
    return _issue(found.filter(text.has_any(F.col("name"), text.SECRET_NAMES)), "hardcoded_secret", "high", "fqn", "pattern", 0.6, "CWE-798")


def unsafe_deserialization(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    found = _patterns(symbols, text.DESERIALISERS)
    risky = graph.arcs(edges, ["calls"]).filter(text.has_any(F.col("src"), text.INPUT_USER)).select(F.col("dst").alias("fqn")).distinct()
    return _issue(found.join(risky, "fqn"), "unsafe_deserialization", "high", "fqn", "pattern", 0.8, "CWE-502")


def analyse_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every symbol by the four checks on one symbol: SQL, command, secret, validation."""
    calls = graph.arcs(edges, ["calls"])
    db_call = calls.filter(text.has_any(F.col("dst"), text.DATABASE_SQL)).select(F.col("src").alias("fqn")).distinct().withColumn("db_call", F.lit(True))
    in_call = calls.filter(text.has_any(F.col("src"), text.INPUT_USER)).select(F.col("dst").alias("fqn")).distinct().withColumn("in_call", F.lit(True))
    valid = calls.filter(text.has_any(F.col("dst"), text.VALIDATION)).select(F.col("src").alias("fqn")).distinct().withColumn("valid", F.lit(True))
    s = symbols.join(db_call, "fqn", "left").join(in_call, "fqn", "left").join(valid, "fqn", "left")
    low, has_input = F.lower("name"), text.has_any(F.col("fqn"), text.INPUT_USER)
    db = F.coalesce("db_call", F.lit(False)) | text.has_any(F.col("fqn"), text.DATABASE_SQL)
    sql = s.filter(db & (F.contains(low, F.lit("query")) | F.contains(low, F.lit("sql"))) & F.col("in_call").isNotNull())
    command = s.filter(text.has_any(F.col("name"), text.DANGEROUS) & has_input)
    secret = s.filter(text.has_any(F.col("name"), text.SECRET_NAMES) & F.col("kind").isin("variable", "constant"))
    validation = s.filter(has_input & F.col("valid").isNull())
    return (
        _issue(sql, "sql_injection", "critical", "fqn", None, 0.7, "CWE-89")
        .union(_issue(command, "command_injection", "critical", "fqn", None, 0.7, "CWE-78"))
        .union(_issue(secret, "hardcoded_secret", "high", "fqn", None, 0.5, "CWE-798"))
        .union(_issue(validation, "missing_validation", "medium", "fqn", None, 0.6, "CWE-20"))
    )


# ---- quality ---------------------------------------------------------------


def complexity(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    c = F.col("n_out")
    out = stats.with_fan(symbols, edges, ["calls"]).select("fqn", (c + 1).alias("cyclomatic"), (c * 2).alias("cognitive"), F.coalesce(text.param_count(F.col("signature")), F.lit(0)).cast("long").alias("parameter_count"))
    return out.withColumn("is_complex", (F.col("cyclomatic") > 10) | (F.col("cognitive") > 15))


def _callee_names(edges: DataFrame) -> DataFrame:
    return graph.arcs(edges, ["calls"]).groupBy(F.col("src").alias("fqn")).agg(F.collect_set(_name("dst")).alias("callees"))


def duplicates(symbols: DataFrame, edges: DataFrame, over: float = 0.8) -> DataFrame:
    """Pairs of one name prefix whose mean of name and callee likeness is high."""
    return similar.duplicates(symbols, edges, over)


def code_smells(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return smells(stats.with_fan(symbols, edges, ["calls"]))


def smells(s: DataFrame) -> DataFrame:
    """``code_smells`` of symbols with the counts of their calls."""
    entry = text.has_any(F.col("name"), text.ENTRIES)
    long = s.filter(F.length("name") > 50)
    god = s.filter((F.col("kind") == "function") & (F.col("n_out") > 20))
    dead = s.filter(F.col("kind").isin("function", "method") & (F.col("n_in") == 0) & ~entry)
    return (
        _issue(long, "long_identifier", "low", "fqn", None, 1.0, None)
        .union(_issue(god, "god_function", "medium", "fqn", F.col("n_out").cast("string"), 1.0, None))
        .union(_issue(dead, "dead_code", "low", "fqn", None, 1.0, None))
    )


def layer_violations(edges: DataFrame, rules: dict[str, tuple[str, ...]] | None = None, of=None) -> DataFrame:
    """``(src_module, dst_module, from_layer, to_layer)`` not allowed by the rules."""
    rules = text.LAYER_RULES if rules is None else rules
    deps = stats.module_dependencies(edges, of).withColumn("from_layer", text.layer(F.col("src_module"))).withColumn("to_layer", text.layer(F.col("dst_module")))
    allowed = F.lit(False)
    for source, targets in rules.items():
        if targets:
            allowed = allowed | ((F.col("from_layer") == source) & F.col("to_layer").isin(*targets))
    return deps.filter(~allowed & (F.col("from_layer") != F.col("to_layer")))


def god_modules(edges: DataFrame, over: int = 10) -> DataFrame:
    return stats.module_dependencies(edges).groupBy("src_module").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > over)


def explain(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every symbol: purpose, parameters, result type, complexity, side effects, tests."""
    pairs, name = cut(graph.arcs(edges, ["calls"], bag=True)), _name("node")
    effect = F.when(text.has_any(name, text.MODIFIES), F.concat(F.lit("Modifies data via "), name)).when(text.has_any(name, text.CALLS_OUT), F.concat(F.lit("Makes external call via "), name)).when(text.has_any(name, text.PRINTS), F.concat(F.lit("Produces output via "), name))
    marks = pairs.select(F.col("dst").alias("node")).distinct().select("node", effect.alias("mark")).filter("mark is not null")
    effects = propagate.reach_counts(pairs, marks, 2).select(F.col("node").alias("fqn"), F.col("reached").alias("side_effects"))
    base = tests_of(stats.with_fan(symbols, edges, ["calls"]), symbols).join(effects, "fqn", "left")
    return base.select(
        "fqn",
        text.purpose(F.col("name"), F.col("n_out")).alias("purpose"),
        F.array_join(F.coalesce(text.params(F.col("signature")), F.array().cast("array<string>")), ";").alias("parameters"),
        text.return_type(F.col("signature")).alias("returns"),
        (F.col("n_out") + 1).alias("cyclomatic"),
        F.coalesce("side_effects", F.lit(0)).cast("long").alias("side_effects"),
        F.when(F.col("tests") > 0, 0.8).otherwise(0.0).alias("test_coverage"),
    )


def tests_of(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``tests``: functions named like a test of the symbol's name.

    A name that holds ``test_<name>`` or ``<name>_test`` as a whole word tail or
    head is matched on the word cut out, an equi-join."""
    t = symbols.filter((F.col("kind") == "function") & F.lower("name").rlike("test"))
    low = F.lower("name")
    after = t.select(F.regexp_extract(low, r"test_(.+)$", 1).alias("key"), "id")
    before = t.select(F.regexp_extract(low, r"^(.+)_test", 1).alias("key"), "id")
    joined = t.select(F.regexp_extract(low, r"test([^_].*)$", 1).alias("key"), "id")
    n = after.union(before).union(joined).filter("key <> ''").groupBy("key").agg(F.countDistinct("id").alias("tests"))
    return rows.join(n.withColumnRenamed("key", "_key"), F.lower(rows["name"]) == F.col("_key"), "left").drop("_key").withColumn("tests", F.coalesce("tests", F.lit(0)).cast("long"))


def change_impact(symbols: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """Every symbol: direct callers, transitive callers and a risk."""
    up = stored(graph.arcs(edges, ["calls"], reverse=True))
    direct = up.groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("direct"))
    near = propagate.reach_counts(up, up.select(F.col("dst").alias("node")).distinct(), depth).select(F.col("node").alias("fqn"), F.col("reached").alias("transitive"))
    rows = tests_of(symbols.join(direct, "fqn", "left").join(near, "fqn", "left"), symbols)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select("fqn", zero("direct").alias("direct"), zero("transitive").alias("transitive"), F.round(text.risk(zero("direct"), zero("transitive"), F.col("tests")), 6).alias("risk"))


def similar_code(symbols: DataFrame, edges: DataFrame, fqn: str, least: float = 0.7) -> DataFrame:
    """Functions like the given one: 0.3 of the name, 0.7 of the callees' likeness."""
    s = symbols.join(_callee_names(edges), "fqn", "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))
    ref = s.filter(F.col("fqn") == fqn).select(F.col("name").alias("rn"), F.col("callees").alias("rc")).limit(1)
    rows = s.filter((F.col("kind") == "function") & (F.col("fqn") != fqn)).crossJoin(F.broadcast(ref))  # one row
    union = F.size(F.array_union("callees", "rc"))
    like = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("callees", "rc")) / union)
    score = F.round(text.name_similarity(F.col("rn"), F.col("name")) * 0.3 + like * 0.7, 6)
    return rows.select("fqn", score.alias("similarity")).filter(F.col("similarity") >= least)


def refactorings(symbols: DataFrame, edges: DataFrame, alike: float = 0.85) -> DataFrame:
    """``(fqn, type)``: complex functions, long parameter lists, long names, and
    functions so like another one that both may become one."""
    c = complexity(symbols, edges).join(symbols.select("fqn", "name"), "fqn")
    one = lambda test, kind: c.filter(test).select("fqn", F.lit(kind).alias("type"))
    pairs = similar.similar_functions(symbols, edges, alike)
    twins = pairs.select(F.explode(F.array("a", "b")).alias("fqn")).distinct().withColumn("type", F.lit("merge_similar"))
    return one(F.col("cyclomatic") > 10, "extract_method").union(one(F.col("parameter_count") > 5, "introduce_parameter_object")).union(one(F.length("name") > 40, "rename")).union(twins)


def security_context(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every symbol: what it handles, and its privilege."""
    named = text.has_any(F.col("fqn"), text.INPUT) | text.has_any(text.param_text(F.col("signature")), text.INPUT)
    s = _callee_flags(symbols, edges, {"accesses_database": (text.DATABASE, 3), "performs_crypto": (text.CRYPTO, 2)})
    s = s.withColumn("handles_user_input", named).withColumn("performs_auth", text.has_any(F.col("name"), text.AUTH_WORDS))
    critical = F.col("performs_auth") | F.col("performs_crypto") | (F.col("handles_user_input") & F.col("accesses_database"))
    return s.select("fqn", "handles_user_input", "accesses_database", "performs_auth", "performs_crypto", text.privilege(F.col("fqn")).alias("privilege"), critical.alias("security_critical"))


def entry_points(symbols: DataFrame, edges: DataFrame, callers: int = 2) -> DataFrame:
    """Functions named like an entry with few callers, and endpoints."""
    f = stats.with_fan(symbols, edges, ["calls"]).filter(F.col("kind") == "function")
    named = text.has_any(F.col("name"), text.ENTRY_PATTERNS) & (F.col("n_in") <= callers)
    ends = text.has_any(F.col("name"), text.ENDPOINTS_VIEW) & (text.has_any(F.col("name"), text.VERBS) | text.has_any(F.col("fqn"), text.INPUT) | text.has_any(text.param_text(F.col("signature")), text.INPUT))
    return f.filter(named | ends).select("fqn").distinct()


def n_plus_one(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Database functions called from something named like a loop."""
    db = symbols.filter(text.has_any(F.col("name"), text.DATABASE))
    return _issue(_called(db, edges).filter(text.has_any(_name("caller"), ("loop", "for"))), "n_plus_one", "medium", "fqn", "caller", 0.6, None)


def review(symbols: DataFrame, files: DataFrame, edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All issues of the symbols in the files (all files if none are given)."""
    issues = analyse_symbols(symbols, edges).union(missing_auth(symbols, edges)).union(code_smells(symbols, edges)).union(n_plus_one(symbols, edges))
    if paths is None:
        return issues
    own = symbols.join(files.select(F.col("id").alias("file_id"), "path").join(paths, "path", "left_semi"), "file_id", "left_semi").select(F.col("fqn").alias("symbol")).distinct()
    return issues.join(own, "symbol", "left_semi").select(*ISSUE)


def by_severity(issues: DataFrame) -> DataFrame:
    order = F.array(*map(F.lit, ("critical", "high", "medium", "low", "info")))
    return issues.groupBy("severity", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.array_position(order, F.col("severity")).cast("int"))


def architecture_review(edges: DataFrame, of=None, layered=None) -> DataFrame:
    """``(finding, subject, detail)``: cycles between modules, forbidden layer
    dependencies and modules with too many dependencies.  ``of`` and ``layered``
    map names to modules, for cycles and for layers."""
    modules = stats.module_dependencies(edges, of).select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
    rings = graph.strong_components(modules).groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("node")), ">").alias("detail"))
    bad = layer_violations(edges, of=layered or of)
    return (
        rings.select(F.lit("module_cycle").alias("finding"), F.col("component").alias("subject"), "detail")
        .union(bad.select(F.lit("layer_violation"), "src_module", "dst_module"))
        .union(god_modules(edges).select(F.lit("god_module"), "src_module", F.col("n").cast("string")))
    )


def methods_of_classes(symbols: DataFrame, separator: str = "::") -> DataFrame:
    """``(fqn, methods)``: for each class the methods whose name begins with the
    class's and the separator.  Each method is dealt to the prefixes of its name,
    which join by equality."""
    methods = symbols.filter("kind = 'method'").select("id", F.split("fqn", separator).alias("parts"))
    owner = F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), separator)))
    of = methods.filter(F.size("parts") > 1).select("id", owner.alias("fqn")).groupBy("fqn").agg(F.countDistinct("id").alias("methods"))
    classes = symbols.filter("kind = 'class'").select("fqn").distinct()
    return classes.join(of, "fqn", "left").select("fqn", F.coalesce("methods", F.lit(0)).cast("long").alias("methods"))
