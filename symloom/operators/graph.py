"""Graph operators on edges ``(src, dst, edge_type)``.

All take many seeds at once: a seed travels as a column, so a rule over every
symbol is one expansion.  Frontiers join the pruned edge table; a depth-bounded
expansion is a chain of joins, an unbounded one is cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.session import cut, few_broadcasts, stored

#: Expansions deeper than this are checkpointed level by level.
PLAIN_DEPTH = 3
#: Tables of levels kept apart before they become one.
MERGE = 8


def arcs(edges: DataFrame, types: list[str] | None = None, reverse: bool = False, bag: bool = False) -> DataFrame:
    """``(src, dst)`` with both ends, of the given types (None: any)."""
    if types is not None:
        edges = edges.filter(F.col("edge_type").isin(types))
    edges = edges.filter("src is not null and dst is not null")
    pair = ("dst", "src") if reverse else ("src", "dst")
    out = edges.select(F.col(pair[0]).alias("src"), F.col(pair[1]).alias("dst"))
    return out if bag else out.distinct()


def vertices(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols and all ends of edges, once each."""
    ends = edges.filter("src is not null and dst is not null")
    return symbols.select(F.col("fqn").alias("node")).union(ends.select("src")).union(ends.select("dst")).distinct()


def reach(pairs: DataFrame, seeds: DataFrame, depth: int | None, include_seed_on_cycle: bool = False) -> DataFrame:
    """``(seed, node, depth)``: nodes reachable from each seed in at most
    ``depth`` steps (None: any number), with the least number of steps.

    The seed itself is left out, unless it lies on a cycle within the bound and
    ``include_seed_on_cycle`` is set."""
    start = seeds.select(F.col("node").alias("seed"), "node").distinct()
    if depth is None:
        return _closure(pairs, start, include_seed_on_cycle)
    if depth > PLAIN_DEPTH:
        return _closure(pairs, start, include_seed_on_cycle, depth)
    frontier, levels = start, []
    for step in range(1, depth + 1):
        frontier = frontier.join(pairs.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).distinct()
        levels.append(frontier.withColumn("depth", F.lit(step)))
    if not levels:
        return start.withColumn("depth", F.lit(0)).limit(0)
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    found = found.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    return found if include_seed_on_cycle else found.filter("seed <> node")


def _closure(pairs: DataFrame, start: DataFrame, include_seed_on_cycle: bool, depth: int | None = None) -> DataFrame:
    """Level by level; a node is expanded once.  Each level is a table of its own."""
    pairs = cut(pairs)
    frontier, levels, step = start, [], 0
    while depth is None or step < depth:
        new = frontier.join(pairs.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).distinct()
        for level in levels:
            new = new.join(level.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            break
        step += 1
        levels.append(frontier.withColumn("depth", F.lit(step)))
        if len(levels) == MERGE:  # few tables to compare with
            levels = [cut(_all(levels))]
    found = _all(levels) if levels else start.withColumn("depth", F.lit(0)).limit(0)
    return found if include_seed_on_cycle else found.filter("seed <> node")


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def callers(edges: DataFrame, seeds: DataFrame, depth: int | None, types: list[str] | None = None) -> DataFrame:
    return reach(arcs(edges, types, reverse=True), seeds, depth)


def callees(edges: DataFrame, seeds: DataFrame, depth: int | None, types: list[str] | None = None) -> DataFrame:
    return reach(arcs(edges, types), seeds, depth)


def hydrate(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Reached nodes that are stored symbols, with name and kind."""
    return found.join(symbols.select(F.col("fqn").alias("node"), "name", "kind").dropDuplicates(["node"]), "node")


def direct(edges: DataFrame, fqn: str, side: str) -> DataFrame:
    """Distinct direct callers (``side`` src) or callees (dst) by calls."""
    other = "dst" if side == "src" else "src"
    return edges.filter((F.col("edge_type") == "calls") & (F.col(other) == fqn)).select(F.col(side).alias("node")).distinct()


def impact_radius(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Transitive callers; the start counts where it lies on a cycle."""
    return reach(arcs(edges, ["calls"], reverse=True), seeds, depth, include_seed_on_cycle=True)


def neighbourhood(edges: DataFrame, seeds: DataFrame, radius: int = 2) -> DataFrame:
    """Nodes within ``radius`` steps in either direction, the start at 0."""
    there = arcs(edges, bag=True)  # frontiers are distinct, so pairs need not be
    both = there.union(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    zero = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()
    return zero.union(reach(both, seeds, radius))


def call_paths(pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(seed, path, depth, is_recursive)``: every walk from a seed that
    repeats no node, and once more with the first repeated node, not extended.

    ``depth`` is the number of nodes; a walk has at most ``depth`` steps."""
    grown = seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("path"), F.lit(False).alias("is_recursive")).distinct()
    out = None
    for step in range(1, depth + 1):
        grown = (
            grown.filter(~F.col("is_recursive"))
            .join(pairs.withColumnRenamed("src", "node"), "node")
            .select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("is_recursive"))
        )
        if step > PLAIN_DEPTH:
            grown = cut(grown)
        out = grown if out is None else out.union(grown)
    return out.select("seed", "path", F.size("path").alias("depth"), "is_recursive")


def simple_paths(pairs: DataFrame, seeds: DataFrame, depth: int, target: DataFrame | None = None) -> DataFrame:
    """``(seed, path)``: paths without a repeated node, of at most ``depth`` edges.

    With ``target`` (column ``node``) only paths to it, not beyond; a seed that
    is the target is a path of one node.  Without, every path of an edge or more."""
    grown = seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("path")).distinct()
    goal = None if target is None else target.select("node", F.lit(True).alias("hit")).distinct()
    out = []

    def arrived(paths: DataFrame) -> DataFrame:
        return paths.join(goal, "node", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    if goal is not None:
        first = arrived(grown)
        out.append(first.filter("hit").drop("hit"))
        grown = first.filter("not hit").drop("hit").select("seed", "node", "path")
        out[0] = out[0].select("seed", "node", "path")
    for step in range(1, depth + 1):
        grown = (
            grown.join(pairs.withColumnRenamed("src", "node"), "node")
            .filter(~F.array_contains("path", F.col("dst")))
            .select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        )
        if step > PLAIN_DEPTH:
            grown = cut(grown)
        if goal is None:
            out.append(grown)
        else:
            now = arrived(grown)
            out.append(now.filter("hit").select("seed", "node", "path"))
            grown = now.filter("not hit").select("seed", "node", "path")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.select("seed", "path")


def shortest_path(pairs: DataFrame, source: str, target: str, limit: int | None = None) -> list[str] | None:
    """A path with the fewest edges, of these the first in the order of its nodes;
    None if none (of at most ``limit`` edges).

    The search goes from both ends, each time from the smaller frontier, so levels are
    tables of nodes alone and about half as deep as the path is long.  Where they meet,
    the nodes of shortest paths are joined back; the driver then asks for one node a
    step."""
    if source == target:
        return [source]
    pairs = cut(pairs.select("src", "dst").distinct())
    spark = pairs.sparkSession
    ends = [[cut(spark.createDataFrame([(x,)], "node string"))] for x in (source, target)]
    seen, sizes = [ends[0][0], ends[1][0]], [1, 1]
    while True:
        if limit is not None and len(ends[0]) + len(ends[1]) - 2 >= limit:
            return None
        side = 0 if sizes[0] <= sizes[1] else 1
        near, far = ("src", "dst") if side == 0 else ("dst", "src")
        step = ends[side][-1].join(pairs.withColumnRenamed(near, "node"), "node").select(F.col(far).alias("node")).distinct()
        new = cut(step.join(seen[side], "node", "left_anti"))
        sizes[side] = new.count()
        if not sizes[side]:
            return None
        ends[side].append(new)
        met = new.join(ends[1 - side][-1], "node", "left_semi")
        if not met.isEmpty():
            break
        seen[side] = cut(seen[side].union(new))
    # nodes of shortest paths: back along the levels of the source, on along the target's
    on_path = [cut(met)]
    for level in reversed(ends[0][:-1]):
        ahead = pairs.join(on_path[0].withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        on_path.insert(0, cut(level.join(ahead, "node", "left_semi")))
    for level in reversed(ends[1][:-1]):
        behind = pairs.join(on_path[-1].withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        on_path.append(cut(level.join(behind, "node", "left_semi")))
    path = [source]
    for level in on_path[1:]:
        path.append(pairs.filter(F.col("src") == path[-1]).select(F.col("dst").alias("node")).join(level, "node").agg(F.min("node")).first()[0])
    return path


@few_broadcasts
def cycles(pairs: DataFrame) -> DataFrame:
    """``(component, cycle)``: of every strongly connected component, and every
    loop of one node, one closed cycle through its smallest node: the shortest,
    of these the smallest; the first node ends it again."""
    members = strong_components(pairs)
    within = cut(
        pairs.filter("src <> dst").distinct()
        .join(members.select(F.col("node").alias("src"), "component"), "src")
        .join(members.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
        .filter("component = other")
        .select("component", "src", "dst")
    )
    loops = pairs.filter("src = dst").distinct().select(F.col("src").alias("component"), F.array("src", "dst").alias("cycle"))
    frontier = within.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("path"))
    done, seen = [loops.join(members.select("component"), "component", "left_anti")], None
    while True:
        new = (
            frontier.join(within.withColumnRenamed("src", "node"), ["component", "node"])
            .groupBy("component", F.col("dst").alias("node"))
            .agg(F.min("path").alias("path"))
            .select("component", "node", F.concat("path", F.array("node")).alias("path"))
        )
        new = cut(new if seen is None else new.join(seen, ["component", "node"], "left_anti"))
        if new.isEmpty():
            return _all(done)
        closed = new.filter("node = component").select("component", F.col("path").alias("cycle"))
        done.append(closed)
        frontier = new.join(closed.select("component"), "component", "left_anti")
        step = frontier.select("component", "node")
        seen = step if seen is None else cut(seen.union(step))


def on_cycle(edges: DataFrame, fqn: str, types: tuple[str, ...] = ("calls",)) -> bool:
    """Whether a symbol reaches itself."""
    there = arcs(edges, list(types))
    seeds = there.sparkSession.createDataFrame([(fqn,)], "node string")
    return not reach(there, seeds, None, include_seed_on_cycle=True).filter(F.col("node") == fqn).isEmpty()


def related_code(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``(seed, relation, node)``: direct callers and callees, dependencies by
    type, and the impact within ``depth`` steps."""
    s = seeds.select(F.col("node").alias("seed")).distinct()
    typed = edges.filter("src is not null and dst is not null").select("src", "dst", "edge_type").distinct()
    there = typed.join(s.withColumnRenamed("seed", "src"), "src").select(F.col("src").alias("seed"), "edge_type", F.col("dst").alias("node"))
    back = typed.filter("edge_type = 'calls'").join(s.withColumnRenamed("seed", "dst"), "dst").select(F.col("dst").alias("seed"), F.lit("caller").alias("relation"), F.col("src").alias("node"))
    out = there.filter("edge_type = 'calls'").select("seed", F.lit("callee").alias("relation"), "node")
    needs = there.filter(F.col("edge_type").isin("imports", "calls", "uses")).select("seed", F.concat(F.lit("dependency_"), "edge_type").alias("relation"), "node")
    far = impact_radius(edges, seeds, depth).select("seed", F.lit("impact").alias("relation"), "node")
    return back.union(out).union(needs).union(far)


def symbol_context(symbols: DataFrame, files: DataFrame, edges: DataFrame, seeds: DataFrame, radius: int = 2) -> DataFrame:
    """``(seed, relation, node)``: the file's path, its other symbols, direct
    callers and callees, imports, all edges by type and direction, and the
    neighbourhood within ``radius`` steps."""
    own = symbols.join(seeds.select(F.col("node").alias("fqn")).distinct(), "fqn").select(F.col("fqn").alias("seed"), "file_id")
    where = own.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("seed", F.lit("file").alias("relation"), F.col("path").alias("node"))
    beside = own.join(symbols.select("file_id", "fqn"), "file_id").filter("fqn <> seed").select("seed", F.lit("sibling").alias("relation"), F.col("fqn").alias("node"))
    near = related_code(edges, seeds, 0).filter(F.col("relation").isin("caller", "callee", "dependency_imports"))
    asked = seeds.select(F.col("node").alias("seed")).distinct()
    out = edges.join(asked.withColumnRenamed("seed", "src"), "src").select(F.col("src").alias("seed"), F.concat(F.lit("outgoing_"), "edge_type").alias("relation"), F.col("dst").alias("node"))
    back = edges.join(asked.withColumnRenamed("seed", "dst"), "dst").select(F.col("dst").alias("seed"), F.concat(F.lit("incoming_"), "edge_type").alias("relation"), F.col("src").alias("node"))
    around = neighbourhood(edges, seeds, radius).filter("node <> seed").select("seed", F.lit("neighbour").alias("relation"), "node").distinct()
    return where.union(beside.distinct()).union(near).union(out).union(back).union(around)


@few_broadcasts
def strong_components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of every strongly connected component of two nodes
    or more; the component is its smallest node.

    In turn, until no edge is left: paths through nodes of one way in and one way
    out become single edges, by doubling; nodes without a way in or out go; and every
    node takes the least node that reaches it and the least that it reaches.  A node
    where both are the same is strongly connected with it; edges between nodes of
    other labels go.  "Least" is by a hash, so there are many pivots at once, and labels
    spread by doubling (see ``_least_around``): a long chain costs rounds in its
    logarithm, whatever the names of its nodes.  Self-loops and null ends do not
    count."""
    live = stored(pairs.filter("src <> dst").select("src", "dst").distinct())
    known = [live.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)]
    bridged: list[DataFrame] = []
    while not live.isEmpty():
        thin = _thin(live)
        if not thin.isEmpty():
            rings, inside, live = _bridge(live, thin)
            known.append(rings)
            bridged.append(inside)
        live = stored(_trimmed(_trimmed(live)))
        if live.isEmpty():
            break
        labels = _least_around(live)
        within = stored(
            live.join(labels.select(F.col("node").alias("src"), F.struct("behind", "ahead").alias("a")), "src")
            .join(labels.select(F.col("node").alias("dst"), F.struct("behind", "ahead").alias("b")), "dst")
            .filter("a = b")
            .select("src", "dst")
        )
        same = stored(labels.filter("behind = ahead").select("node", F.col("behind.node").alias("label")))
        known.append(same)
        gone = same.select("node")
        live = stored(within.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    out = known[0]
    for more in known[1:]:
        out = out.union(more)
    for inside in reversed(bridged):  # later bridges stand on nodes within earlier ones
        first = out.select(F.col("node").alias("a"), F.col("label").alias("la"))
        last = out.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        ends = inside.join(first, "a", "left").join(last, "b", "left").withColumn("label", F.coalesce("la", "a")).filter(F.col("label") == F.coalesce("lb", "b"))
        out = stored(out.union(ends.select("node", "label")).union(ends.select("a", "label")).distinct())
    big = out.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.join(big, "label").select("node", "component")


def _trimmed(live: DataFrame) -> DataFrame:
    """Without the nodes that have no edge in or no edge out."""
    starts = live.select(F.col("dst").alias("src")).distinct()
    ends = live.select(F.col("src").alias("dst")).distinct()
    return live.join(starts, "src", "left_semi").join(ends, "dst", "left_semi").select("src", "dst")


def _thin(live: DataFrame) -> DataFrame:
    """``(node, next)`` of the nodes with one edge in and one out."""
    out = live.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    into = live.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return stored(out.join(into.select("node"), "node").select("node", "next"))


def _bridge(live: DataFrame, thin: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(node, label)`` of rings of thin nodes alone, ``(node, a, b)`` of the thin
    nodes on a path from ``a`` to ``b``, and the edges with such paths as one each.

    Every node knows a thin node ahead, twice as far each round; ``open`` says that
    the path may go on there.  Open nodes of paths become fewer each round, so when
    their number stands still only rings are left."""
    more = thin.select(F.col("node").alias("next"), F.lit(True).alias("more"))
    ahead = thin.join(more, "next", "left").select("node", F.when(F.col("more"), F.col("next")).otherwise(F.col("node")).alias("last"), F.col("more").isNotNull().alias("open"))
    ahead = stored(ahead.withColumn("label", F.least("node", "last")))
    steps, before, left = 1, -1, ahead.filter("open").count()
    while left and not (left == before and steps >= left):
        there = ahead.select(F.col("node").alias("last"), F.col("last").alias("far"), F.col("open").alias("on"), F.col("label").alias("low"))
        ahead = stored(ahead.join(there, "last").select("node", F.col("far").alias("last"), F.col("on").alias("open"), F.least("label", "low").alias("label")))
        steps, before, left = steps * 2, left, ahead.filter("open").count()
    path = ahead.filter("not open").select("node", "last")
    thins = thin.select("node")
    apart = live.join(thins.withColumnRenamed("node", "src"), "src", "left_anti")
    first = apart.join(path.withColumnRenamed("node", "dst"), "dst").select("last", F.col("src").alias("a"))
    ends = stored(first.join(thin.select(F.col("node").alias("last"), F.col("next").alias("b")), "last").select("last", "a", "b"))
    inside = stored(path.join(ends, "last").select("node", "a", "b"))
    rest = apart.join(thins.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    live = stored(rest.union(ends.filter("a <> b").select("a", "b")).distinct())
    return ahead.filter("open").select("node", "label"), inside, live


def _least_around(live: DataFrame) -> DataFrame:
    """``(node, behind, ahead)``: the least node that reaches each and the least that
    it reaches, itself included, as ``(hash, node)``.

    A round takes the least label of the nodes before (after), then the label of that
    label's node: what reaches a node that reaches this one reaches it too.  Hashes
    are at random along any path, so the stretch a label stands for grows by a
    constant factor a round."""
    ends = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
    own = F.struct(F.xxhash64("node").alias("hash"), F.col("node"))
    labels = stored(ends.select("node", own.alias("behind"), own.alias("ahead")))
    while True:
        before = live.join(labels.select(F.col("node").alias("src"), "behind"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("behind").alias("b"))
        after = live.join(labels.select(F.col("node").alias("dst"), "ahead"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("ahead").alias("a"))
        met = labels.join(before, "node", "left").join(after, "node", "left")
        met = met.select("node", F.struct("behind", "ahead").alias("old"), F.least("behind", F.coalesce("b", "behind")).alias("behind"), F.least("ahead", F.coalesce("a", "ahead")).alias("ahead"))
        up = met.filter("behind.node <> node").select(F.col("node").alias("at"), F.col("behind").alias("b"))
        down = met.filter("ahead.node <> node").select(F.col("node").alias("to"), F.col("ahead").alias("a"))
        far = met.withColumn("at", F.col("behind.node")).withColumn("to", F.col("ahead.node")).join(up, "at", "left").join(down, "to", "left")
        new = stored(far.select("node", "old", F.least("behind", F.coalesce("b", "behind")).alias("behind"), F.least("ahead", F.coalesce("a", "ahead")).alias("ahead")))
        labels = new.select("node", "behind", "ahead")
        if new.filter("behind <> old.behind or ahead <> old.ahead").isEmpty():
            return labels


def is_cyclic(pairs: DataFrame) -> bool:
    """A self-loop counts."""
    return not pairs.filter("src = dst").isEmpty() or not strong_components(pairs).isEmpty()


def stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_count edge_count is_cyclic``; parallel edges count."""
    cyclic = is_cyclic(arcs(edges))
    nodes = vertices(symbols, edges).agg(F.count(F.lit(1)).alias("node_count"))
    return nodes.crossJoin(arcs(edges, bag=True).agg(F.count(F.lit(1)).alias("edge_count"))).withColumn("is_cyclic", F.lit(cyclic))


def dependencies_typed(edges: DataFrame, types: tuple[str, ...] = ("calls", "imports", "uses")) -> DataFrame:
    """``(node, dependencies, dependents)``: distinct neighbours by these types."""
    e = edges.filter(F.col("edge_type").isin(*types)).select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("dependencies"))
    back = e.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    none = F.array().cast("array<string>")
    return out.join(back, "node", "full").select("node", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def dependencies_grouped(edges: DataFrame, fqn: str) -> DataFrame:
    """One row: a map from edge type to targets, with imports, calls and uses."""
    e = edges.filter(F.col("src") == fqn).groupBy("edge_type").agg(F.sort_array(F.collect_set("dst")).alias("targets"))
    base = edges.sparkSession.createDataFrame([(t,) for t in ("imports", "calls", "uses")], "edge_type string")
    rows = base.join(e, "edge_type", "full").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("edge_type", "targets"))).alias("dependencies"))


def relationships(edges: DataFrame, fqn: str, direction: str = "both") -> DataFrame:
    """``(relation, node)`` rows of ``outgoing_<type>`` and ``incoming_<type>``."""
    out = edges.filter(F.col("src") == fqn).select(F.concat(F.lit("outgoing_"), "edge_type").alias("relation"), F.col("dst").alias("node"))
    back = edges.filter(F.col("dst") == fqn).select(F.concat(F.lit("incoming_"), "edge_type").alias("relation"), F.col("src").alias("node"))
    return {"from": out, "to": back, "both": out.unionAll(back)}[direction]


def file_dependents(file_edges: DataFrame, path: str | None = None) -> DataFrame:
    """Files whose imports, reads, calls, contains or implements end in a file."""
    e = file_edges.filter(F.col("edge_type").isin("imports", "reads", "calls", "contains", "implements")).filter("file_src is not null and file_dst is not null")
    if path is not None:
        e = e.filter(F.col("file_dst") == path)
    return e.select("file_dst", "file_src").distinct()


def importers(edges: DataFrame, fqn: str) -> DataFrame:
    return edges.filter((F.col("edge_type") == "imports") & (F.col("dst") == fqn)).select(F.col("src").alias("node")).distinct()


def compare(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(side, node)``: callees and callers by calls that both symbols have."""
    calls = edges.filter(F.col("edge_type") == "calls")

    def shared(key: str, other: str, side: str) -> DataFrame:
        of = lambda s: calls.filter(F.col(key) == s).select(other).distinct()
        return of(a).intersect(of(b)).select(F.lit(side).alias("side"), F.col(other).alias("node"))

    return shared("src", "dst", "shared_callees").union(shared("dst", "src", "shared_callers"))


def entry_candidates(symbols: DataFrame, edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """Symbols nobody calls, or named like an entry."""
    called = arcs(edges, ["calls"]).select(F.col("dst").alias("fqn")).distinct().withColumn("called", F.lit(True))
    found = symbols.join(called, "fqn", "left").filter(F.col("called").isNull() | F.col("name").ilike("%main%") | F.col("name").ilike("%start%") | F.col("name").ilike("%init%"))
    found = found.select("fqn").distinct()
    return found if limit is None else found.orderBy("fqn").limit(limit)


def explore(symbols: DataFrame, edges: DataFrame, start: DataFrame | None, strategy: str = "breadth", seed: int = 0) -> DataFrame:
    """Nodes found from a start: entries, a neighbourhood, path nodes or a sample."""
    if start is None:
        return entry_candidates(symbols, edges).select(F.col("fqn").alias("node"))
    if strategy == "breadth":
        return neighbourhood(edges, start, 3).select("node").distinct()
    if strategy == "depth":
        return reach(arcs(edges), start, 10).select("node").union(start.select("node")).distinct()
    some = arcs(edges).orderBy(F.rand(seed)).limit(50)
    return some.select(F.col("src").alias("node")).union(some.select("dst")).distinct()


def context_counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """For every symbol: siblings in its file, callers, callees and imports."""
    per_file = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    calls = arcs(edges, ["calls"])
    out = calls.groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("callees"))
    back = calls.groupBy(F.col("dst").alias("fqn")).agg(F.count(F.lit(1)).alias("callers"))
    imports = arcs(edges, ["imports"]).groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("imports"))
    rows = symbols.join(per_file, "file_id").join(out, "fqn", "left").join(back, "fqn", "left").join(imports, "fqn", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("fqn", (F.col("n") - 1).alias("siblings"), zero("callers"), zero("callees"), zero("imports"))
