from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from symloom.operators import graph
from symloom.sources import scip


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, edge_type string")


def seeds(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def reached(spark, pairs, start, depth, up=False, **kw):
    rows = graph.reach(graph.arcs(edges(spark, pairs), reverse=up), seeds(spark, start), depth, **kw).collect()
    return {r.node: r.depth for r in rows}


def test_callers_grow_with_depth(spark):
    pairs = [("a", "b"), ("c", "b"), ("d", "c")]
    assert reached(spark, pairs, "b", 1, up=True) == {"a": 1, "c": 1}
    assert reached(spark, pairs, "b", 2, up=True) == {"a": 1, "c": 1, "d": 2}
    assert reached(spark, pairs, "b", 0, up=True) == {} and reached(spark, pairs, "nobody", 3) == {}


def test_diamond_tree_chain_and_complete_graph(spark):
    assert len(reached(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "d", 2, up=True)) == 3
    assert len(reached(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("b", "f")], "r", 2)) == 6
    chain = [(str(i), str(i + 1)) for i in range(99)]
    assert len(reached(spark, chain, "10", 5, up=True)) == 5
    assert len(reached(spark, chain, "10", None, up=True)) == 10
    k5 = [(a, b) for a in "abcde" for b in "abcde" if a != b]
    assert graph.arcs(edges(spark, k5)).count() == 20 and len(reached(spark, k5, "a", 1, up=True)) == 4


def test_level_search_finds_what_a_long_route_would_hide(spark):
    pairs = [("s", "b"), ("s", "a"), ("b", "d"), ("d", "e"), ("a", "e"), ("e", "f")]
    assert reached(spark, pairs, "s", 3)["f"] == 3


def test_self_loops_parallel_edges_and_null_ends(spark):
    assert reached(spark, [("r", "r")], "r", 2) == {}
    assert reached(spark, [("r", "r")], "r", 2, include_seed_on_cycle=True) == {"r": 1}
    many = spark.createDataFrame([("a", "b", t) for t in ("calls", "imports", "uses")] + [(None, "b", "calls"), ("a", None, "calls")], "src string, dst string, edge_type string")
    assert graph.arcs(many, bag=True).count() == 3 and graph.arcs(many).count() == 1
    assert graph.is_cyclic(graph.arcs(edges(spark, [("r", "r")]))) and graph.strong_components(graph.arcs(edges(spark, [("r", "r")]))).count() == 0


def test_triangle_and_shortest_paths(spark):
    tri = graph.arcs(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert {(r.node, r.component) for r in graph.strong_components(tri).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert graph.shortest_path(tri, "a", "c") == ["a", "b", "c"] and graph.shortest_path(tri, "a", "a") == ["a"]
    two = graph.arcs(edges(spark, [("a", "b"), ("x", "y")]))
    assert graph.shortest_path(two, "a", "y") is None and not graph.is_cyclic(two)


def test_paths(spark):
    pairs = graph.arcs(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]))
    walks = {(tuple(r.path), r.is_recursive) for r in graph.call_paths(pairs, seeds(spark, "a"), 3).collect()}
    assert walks == {(("a", "b"), False), (("a", "c"), False), (("a", "b", "c"), False), (("a", "c", "a"), True), (("a", "b", "c", "a"), True)}
    to = {tuple(r.path) for r in graph.simple_paths(pairs, seeds(spark, "a"), 5, seeds(spark, "c")).collect()}
    assert to == {("a", "b", "c"), ("a", "c")}
    assert [list(r.path) for r in graph.simple_paths(pairs, seeds(spark, "a"), 5, seeds(spark, "a")).collect()] == [["a"]]


def test_neighbourhood_and_relationships(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d")])
    assert {r.node: r.depth for r in graph.neighbourhood(e, seeds(spark, "a"), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted((r.relation, r.node) for r in graph.relationships(e, "c").collect()) == [("outgoing_calls", "b"), ("outgoing_calls", "d")]


def plain_components(pairs):
    nodes = sorted({x for p in pairs for x in p})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    groups = {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {(n, min(g)) for n, g in groups.items() if len(g) > 1}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=12))
def test_components_equal_plain_ones(spark, pairs):
    got = {(r.node, r.component) for r in graph.strong_components(graph.arcs(edges(spark, pairs))).collect()}
    assert got == plain_components(pairs)


def test_components_over_bridges(spark):
    """Rings alone, loops of thin nodes through one node, bridges within bridges,
    parallel paths and rings of rings."""
    ring = lambda name, n: [(f"{name}{i:02}", f"{name}{(i + 1) % n:02}") for i in range(n)]
    pairs = ring("r", 8) + ring("s", 2) + ring("t", 5) + [("t00", "u0"), ("u0", "u1"), ("u1", "t00")]
    pairs += [("h", "x1"), ("x1", "x2"), ("x2", "h"), ("h", "y"), ("y", "h"), ("h", "z1"), ("z1", "z2"), ("z2", "z3")]
    pairs += [("p", "q1"), ("q1", "w"), ("p", "q2"), ("q2", "w"), ("w", "v1"), ("v1", "v2"), ("v2", "p"), ("w", "end")]
    got = {(r.node, r.component) for r in graph.strong_components(graph.arcs(edges(spark, pairs))).collect()}
    assert got == plain_components(pairs)


def _far(kind, n):
    """Long graphs of few components, with names against the direction of the edges."""
    name = lambda i: f"{(n - i) % n:06}"
    chain = [(name(i), name(i + 1)) for i in range(n - 1)]
    if kind == "ring":
        return [*chain, (name(n - 1), name(0))]
    return chain + [(name(i), name(i + 2)) for i in range(n - 2)] if kind == "ladder" else chain


@pytest.mark.parametrize(("kind", "n", "rounds", "members"), [("chain", 100_000, 40, 0), ("ring", 100_000, 40, 100_000), ("ladder", 40, 60, 0)])
def test_components_of_long_graphs_take_few_rounds(spark, monkeypatch, kind, n, rounds, members):
    cuts = []
    monkeypatch.setattr(graph, "stored", lambda df, stored=graph.stored: cuts.append(1) or stored(df))
    found = graph.strong_components(spark.createDataFrame(_far(kind, n), "src string, dst string"))
    assert found.count() == members and found.select("component").distinct().count() == (members > 0)
    assert len(cuts) < rounds


@pytest.mark.parametrize("strategy", ["breadth", "depth", "random"])
def test_explore(spark, strategy):
    e = edges(spark, [("a", "b"), ("b", "c")])
    symbols = spark.createDataFrame([("a", "main"), ("b", "x"), ("c", "y")], "fqn string, name string")
    assert graph.explore(symbols, e, seeds(spark, "a"), strategy).count() == 3
    assert [r.node for r in graph.explore(symbols, e, None).collect()] == ["a"]


def _shortest_cycle(pairs, root):
    """The smallest of the shortest closed cycles through a node, by brute force."""
    level = [[root]]
    for _ in range(len(pairs) + 1):
        level = [[*p, b] for p in level for a, b in sorted(pairs) if a == p[-1] and a != b and b not in p[1:]]
        closed = [p for p in level if p[-1] == root]
        if closed:
            return min(closed)
    return None


def test_cycles_are_closed_and_shortest(spark):
    rng = random.Random(6)
    for _ in range(3):
        pairs = {(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(20)} | {("z", "z")}
        df = spark.createDataFrame(sorted(pairs), "src string, dst string")
        roots = {r.component for r in graph.strong_components(df).collect()}
        got = {r.component: list(r.cycle) for r in graph.cycles(df).collect()}
        members = {r.node for r in graph.strong_components(df).collect()}
        want = {r: _shortest_cycle(pairs, r) for r in roots} | {a: [a, b] for a, b in pairs if a == b and a not in roots}
        assert {k: v for k, v in got.items() if k not in members or k in roots} == {k: v for k, v in want.items() if k in got} and set(roots) <= set(got) and got["z"] == ["z", "z"]


def test_shortest_path_and_local_cycle(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("a", "d", "calls"), ("d", "c", "calls"), ("c", "e", "calls"), ("e", "c", "calls")], "src string, dst string, edge_type string")
    there = graph.arcs(e)
    assert graph.shortest_path(there, "a", "e") == ["a", "b", "c", "e"]
    assert graph.shortest_path(there, "e", "a") is None and graph.shortest_path(there, "a", "e", limit=2) is None
    assert graph.on_cycle(e, "c") and not graph.on_cycle(e, "a")


def test_deep_reach_expands_a_node_once(spark):
    n = 30
    chain = spark.createDataFrame([(f"{i:03}", f"{(i + 1) % n:03}") for i in range(n)], "src string, dst string")
    seeds = spark.createDataFrame([("000",)], "node string")
    assert {r.node: r.depth for r in graph.reach(chain, seeds, 20).collect()} == {f"{i:03}": i for i in range(1, 21)}
    assert {r.node: r.depth for r in graph.reach(chain, seeds, None, include_seed_on_cycle=True).collect()}["000"] == n


def test_unresolved_edges_stay(spark):
    e = spark.createDataFrame([(1, "a", "known", "syntactic"), (2, "a", "lost", "syntactic"), (3, "a", "known", "semantic")], "id long, src string, dst string, resolution string")
    s = spark.createDataFrame([("known", "id:7", 1), ("known", "id:9", 2)], "fqn string, symbol_id string, seq long")
    got = {r.id: (r.dst, r.resolution, r.resolved_by) for r in scip.upgrade(e, s).collect()}
    assert got == {1: ("id:9", "semantic", "scip"), 2: ("lost", "syntactic", None), 3: ("known", "semantic", None)}


def test_a_neighbourhood_makes_no_distinct_pairs(spark):
    """Frontiers alone are made distinct: a step and the least depths, however often edges repeat."""
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "uses"), ("c", "b", "calls"), ("c", "b", "calls"), ("d", "c", "calls"), ("e", "d", "calls")], "src string, dst string, edge_type string")
    found = graph.neighbourhood(edges, spark.createDataFrame([("a",)], "node string"), 2)
    assert sorted((r["node"], r["depth"]) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [src" not in plan
