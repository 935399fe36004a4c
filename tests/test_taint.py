"""Taint by states against all walks."""

import random

from symloom.operators import taint

CLEANS, SINKS = ("clean",), ("exec",)


def _walks(pairs, seed, depth):
    """``(sink, tainted) -> least steps`` over all walks, repeated nodes included."""
    out, front = {}, {(seed, "clean" in seed)}
    for step in range(1, depth + 1):
        front = {(b, c or "clean" in b) for n, c in front for a, b in pairs if a == n}
        for n, c in front:
            if "exec" in n:
                out.setdefault((n, not c), step)
    return out


def _graph(seed, n, m):
    rng = random.Random(seed)
    names = [f"p::{rng.choice(['f', 'f', 'clean', 'exec', 'g'])}{i}" for i in range(n)]
    return names, sorted({(rng.choice(names), rng.choice(names)) for _ in range(m)})


def test_flows_equal_all_walks_and_paths_are_walks(spark):
    for seed in (1, 2):
        names, pairs = _graph(seed, 25, 45)
        edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, edge_type string")
        seeds = names[:4]
        rows = taint.flows(edges, spark.createDataFrame([(s,) for s in seeds], "node string"), SINKS, CLEANS, 7).collect()
        for s in seeds:
            assert {(r["sink"], r["tainted"]): r["depth"] for r in rows if r["source"] == s} == _walks(pairs, s, 7)
        for r in rows:
            p = r["path"]
            assert p[0] == r["source"] and p[-1] == r["sink"] and len(p) == r["depth"] + 1
            assert all(x in pairs for x in zip(p, p[1:], strict=False)) and r["tainted"] == (not any("clean" in x for x in p))


def test_rows_of_a_dense_graph_are_polynomial(spark):
    """Layers of 12 nodes, each calling all of the next: 12 ** 6 walks, few states."""
    pairs = [(f"p::l{k}_{i}", f"p::l{k + 1}_{j}", "calls") for k in range(6) for i in range(12) for j in range(12)] + [(f"p::l6_{i}", "p::exec", "calls") for i in range(12)]
    edges = spark.createDataFrame(pairs, "src string, dst string, edge_type string")
    found = taint.flows(edges, spark.createDataFrame([("p::l0_0",)], "node string"), SINKS, CLEANS, 8).collect()
    assert [(r["sink"], r["tainted"], r["depth"]) for r in found] == [("p::exec", True, 7)]
    states = taint.levels(edges.select("src", "dst"), spark.createDataFrame([("p::l0_0",)], "node string"), CLEANS, 8)
    assert states.count() == 2 + 6 * 12


def test_sources_that_share_states_share_rows(spark, monkeypatch):
    """200 sources over layers of 10 nodes: a state and its sources are a row, whatever their number."""
    pairs = [(f"p::s{i}", f"p::l0_{j}", "calls") for i in range(200) for j in range(10)]
    pairs += [(f"p::l{k}_{i}", f"p::l{k + 1}_{j}", "calls") for k in range(3) for i in range(10) for j in range(10)] + [(f"p::l3_{i}", "p::exec", "calls") for i in range(10)]
    edges = spark.createDataFrame(pairs, "src string, dst string, edge_type string")
    searched = []
    search = taint._search
    monkeypatch.setattr(taint, "_search", lambda *a: searched.extend(search(*a)) or searched)
    found = taint.flows(edges, spark.createDataFrame([(f"p::s{i}",) for i in range(200)], "node string"), SINKS, CLEANS, 5).collect()
    # of equal ways the first nodes
    assert {tuple(r["path"]) for r in found} == {(f"p::s{i}", "p::l0_0", "p::l1_0", "p::l2_0", "p::l3_0", "p::exec") for i in range(200)}
    blocks = searched[0].select("block").distinct().count()
    assert sum(level.count() for level in searched[1:]) <= 41 * blocks


def test_parts_of_a_graph_need_no_rounds(spark, monkeypatch):
    """Flows of parts are those of the rounds, paths too; large parts still go by rounds."""
    names, pairs = [], []
    for g in range(4):
        n, p = _graph(10 + g, 25, 45)
        names += [f"{x}_{g}" for x in n[:6]]
        pairs += [(f"{a}_{g}", f"{b}_{g}") for a, b in p]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, edge_type string").repartition(3)
    seeds = spark.createDataFrame([(x,) for x in [*names, "p::none"]], "node string")
    rows = lambda: sorted(map(str, taint.flows(edges, seeds, SINKS, CLEANS, 5).collect()))
    want = rows()
    monkeypatch.setattr(taint, "LEAST", 0)
    monkeypatch.setattr(taint.parts, "FEW", 1)
    monkeypatch.setattr(taint, "SOURCES", 4)
    monkeypatch.setattr(taint, "ROWS", 10)
    with monkeypatch.context() as m:
        m.setattr(taint, "_search", None)
        assert rows() == want and want
    monkeypatch.setattr(taint.parts, "ARCS", 40)
    assert rows() == want
