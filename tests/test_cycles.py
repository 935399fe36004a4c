"""Cycles off the search trees, on random graphs."""

import random

from symloom.operators import cycles, graph


def _strong(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_cycles_are_simple_closed_and_cover_every_edge(spark):
    rng = random.Random(1)
    for n, m in ((12, 20), (20, 60), (10, 9)):
        pairs = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})
        found = cycles.cycle_basis(spark.createDataFrame(pairs, "src string, dst string")).collect()
        part = _strong(pairs)
        seen, carried = set(), set()
        for r in found:
            c = r["cycle"]
            assert c[0] == c[-1] == min(c) and len(set(c)) == len(c) - 1 and tuple(c) not in seen
            assert all(x in pairs for x in zip(c, c[1:], strict=False)) and {part[x] for x in c} == {r["component"]}
            seen.add(tuple(c))
            carried |= set(zip(c, c[1:], strict=False))
        inner = {(a, b) for a, b in pairs if part[a] == part[b]}
        # each edge off the tree closes its cycle; no edge outside of a component is in one
        assert carried <= inner and {(a, b) for a, b in inner if a == b} <= carried
        closed = [r for r in found if len(r["cycle"]) > 2]
        big = {p for p in part.values() if sum(x == p for x in part.values()) > 1}
        assert {r["component"] for r in closed} == big
        off = len({(a, b) for a, b in inner if a != b}) - sum(sum(x == p for x in part.values()) - 1 for p in big)
        assert len(closed) <= off


def test_a_ring_and_no_cycle(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    assert [r["cycle"] for r in cycles.cycle_basis(spark.createDataFrame(ring, "src string, dst string")).collect()] == [[f"n{i}" for i in range(6)] + ["n0"]]
    none = spark.createDataFrame(ring[:5] + [("n9", "n9")], "src string, dst string")
    assert [r["cycle"] for r in cycles.cycle_basis(none).collect()] == [["n9", "n9"]]
    assert graph.MERGE > 2


def test_rounds_broadcast_small_tables_only(spark, monkeypatch):
    """The bound holds in the rounds and is put back, whatever it was."""
    from symloom.operators import graph
    from symloom.sources import session

    name, seen, stored = "spark.sql.autoBroadcastJoinThreshold", [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(df.sparkSession.conf.get(name)) or stored(df))
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "src string, dst string")
    for given in ("10485760", "-1"):
        before = spark.conf.get(name)
        spark.conf.set(name, given)
        try:
            assert graph.strong_components(pairs).count() == 3
            assert set(seen) == {str(session.SMALL) if given != "-1" else "-1"} and spark.conf.get(name) == given
        finally:
            spark.conf.set(name, before)
        seen.clear()
