"""Similarity joins and the two-ended path search against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from symloom.operators import graph, similar


def _sets(seed, n, hub=True):
    rng = random.Random(seed)
    base = [sorted({f"i{rng.randrange(60)}" for _ in range(rng.randrange(1, 9))}) for _ in range(n // 2)]
    out = []
    for k in range(n):
        s = set(rng.choice(base))
        if rng.random() < 0.5:
            s ^= {f"i{rng.randrange(60)}"}
        out.append((k, sorted(s | {"hub"} if hub else s)))
    return out + [(n, []), (n + 1, ["hub"]), (n + 2, ["hub"])]


@pytest.mark.parametrize("least", [0.2, 0.5, 2 / 3, 0.8, 1.0])
def test_pairs_equal_brute_force(spark, least):
    sets = _sets(int(least * 100), 120)
    got = {(r["a"], r["b"]): r["jaccard"] for r in similar.jaccard_pairs(spark.createDataFrame(sets, "id long, items array<string>"), least).collect()}
    want = {}
    for a, x in sets:
        for b, y in sets:
            if a < b and set(x) & set(y):
                j = len(set(x) & set(y)) / len(set(x) | set(y))
                if j >= least:
                    want[a, b] = j
    assert got == pytest.approx(want)


def test_a_popular_item_brings_no_pairs_together(spark):
    """All sets hold the hub; candidates do not grow with the square of its sets."""
    sets = [(i, ["hub", f"a{i}", f"b{i}"]) for i in range(4000)] + [(9000, ["hub", "a7", "b7"])]
    df = spark.createDataFrame(sets, "id long, items array<string>")
    found = similar.jaccard_pairs(df, 0.8)
    assert [tuple(r) for r in found.collect()] == [(7, 9000, 1.0)]
    size = F.size("items")
    first = df.select(F.explode(F.slice(F.array_remove("items", "hub"), 1, 1)).alias("item"))
    assert first.groupBy("item").count().agg(F.max("count")).first()[0] == 2 and df.select(size).distinct().count() == 1


def _graph(seed, n):
    rng = random.Random(seed)
    names = [f"{rng.choice(['get', 'set', 'put'])}_{rng.choice(['user', 'item', 'order'])}_{k % 7}" for k in range(n)]
    symbols = [(k, 1, f"p::{name}{k}", name, rng.choice(["function", "function", "class"]), "s") for k, name in enumerate(names)]
    edges = sorted({(symbols[a][2], symbols[b][2], "calls") for a in range(n) for b in [0, *rng.sample(range(8), rng.randrange(0, 4))]})
    return symbols, edges


def test_similar_functions_and_duplicates_equal_brute_force(spark):
    symbols, edges = _graph(4, 60)
    s = spark.createDataFrame(symbols, "id long, file_id long, fqn string, name string, kind string, signature string")
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string")
    called = {}
    for a, b, _ in edges:
        called.setdefault(a, set()).add(b.split("::")[1])

    def names(a, b):
        if a == b:
            return 1.0
        if a in b or b in a:
            return 0.8
        x, y = set(a.split("_")), set(b.split("_"))
        return len(x & y) / len(x | y)

    f = sorted((r[2], r[3]) for r in symbols if r[4] == "function" and r[2] in called)
    jac = lambda x, y: len(x & y) / len(x | y)
    for least in (0.4, 0.7, 0.85):
        want = {(a, b): round(0.3 * names(na, nb) + 0.7 * jac(called[a], called[b]), 6) for i, (a, na) in enumerate(f) for b, nb in f[i + 1 :]}
        want = {k: v for k, v in want.items() if v >= least}
        assert {(r["a"], r["b"]): r["similarity"] for r in similar.similar_functions(s, e, least).collect()} == pytest.approx(want) and want
    for over in (0.5, 0.8):
        want = {}
        for i, x in enumerate(symbols):
            for y in symbols[i + 1 :]:
                if x[3].split("_")[0] == y[3].split("_")[0] and x[2] in called and y[2] in called and called[x[2]] & called[y[2]]:
                    v = (jac(set(x[3]), set(y[3])) + jac(called[x[2]], called[y[2]])) / 2
                    if v > over:
                        want[x[0], y[0]] = v
        assert {(r["a"], r["b"]): r["similarity"] for r in similar.duplicates(s, e, over).collect()} == pytest.approx(want) and want


def _first_shortest(pairs, a, b):
    level, seen = {a: [a]}, {a}
    while level:
        if b in level:
            return level[b]
        new = {}
        for x, y in pairs:
            if x in level and y not in seen:
                new[y] = min(new.get(y, ["~"]), level[x] + [y])
        seen |= set(new)
        level = new
    return None


def test_shortest_paths_equal_brute_force(spark):
    rng = random.Random(6)
    for seed in range(3):
        pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40 + 10 * seed)})
        df = spark.createDataFrame(pairs, "src string, dst string")
        for a, b in [("n0", "n9"), ("n3", "n17"), ("n5", "n6")]:
            want = _first_shortest(pairs, a, b)
            assert graph.shortest_path(df, a, b) == want
            if want and len(want) > 1:
                assert graph.shortest_path(df, a, b, limit=len(want) - 1) == want
                assert len(want) == 2 or graph.shortest_path(df, a, b, limit=len(want) - 2) is None


def test_few_items_that_all_share_go_by_blocks(spark, monkeypatch):
    """Sets over few items: every pair would meet in the join, so blocks are compared;
    the pairs and values are those of the join."""
    rng = random.Random(8)
    names = [f"{rng.choice(['get', 'Set', 'put'])}_{rng.choice(['user', 'item'])}{rng.choice(['', '_x', 's', '__'])}" for _ in range(400)] + ["", "_", "_", "a"]
    rows = [(k, f"p::{n}{k}", n, "function") for k, n in enumerate(names)]
    calls = [(r[1], f"p::w{w}", "calls") for r in rows for w in rng.sample(range(10), rng.randrange(1, 8))]
    s, e = spark.createDataFrame(rows, "id long, fqn string, name string, kind string"), spark.createDataFrame(calls, "src string, dst string, edge_type string")
    found, blocks = [], []
    by_blocks = similar._by_blocks
    monkeypatch.setattr(similar, "_by_blocks", lambda *a: (blocks.append(1), by_blocks(*a))[1])
    for least in (0.4, 0.7, 0.9):
        for cheaper in (similar.CHEAPER, 0):
            monkeypatch.setattr(similar, "CHEAPER", cheaper)
            found.append(sorted(tuple(r) for r in similar.similar_functions(s, e, least).collect()))
        monkeypatch.setattr(similar, "CHEAPER", 20)
        assert found[-1] == found[-2] and found[-1]
    assert len(blocks) == 3


def test_blocks_get_numbers_for_callees(spark, monkeypatch):
    """A row goes to many tasks: callees are numbers there, unless two have the same number."""
    f = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"])], "fqn string, callees array<string>")
    assert f.select(similar._short(f).alias("c")).dtypes == [("c", "array<int>")]
    rows = dict(f.select("fqn", similar._short(f)).collect())
    assert rows["a"][1] == rows["b"][0] and len({*rows["a"], *rows["b"]}) == 3
    monkeypatch.setattr(similar.F, "hash", lambda c: F.lit(1))
    assert f.select(similar._short(f).alias("c")).dtypes == [("c", "array<string>")]


def test_short_rows_keep_odd_names(spark):
    """Names whose lower case is another, and numbers or names for callees, give the same pairs."""
    names = ["Get_User", "get_user", "GET_user_2", "ÄB_c", "äb_c_d", "_", "__", "x_X", "x"]
    f = spark.createDataFrame([(f"p::{i}", n, ["a", "b", "c"][: 1 + i % 3]) for i, n in enumerate(names * 3)], "fqn string, name string, callees array<string>")
    got = sorted(map(tuple, similar._by_blocks(f, 0.5).collect()))
    low = lambda i: names[i % 9].lower()
    toks = lambda n: {w for w in n.split("_") if w}

    def alike(i, j):
        a, b = low(i), low(j)
        name = 1.0 if a == b else 0.8 if a in b or b in a else len(toks(a) & toks(b)) / len(toks(a) | toks(b)) if toks(a) and toks(b) else 0.0
        x, y = 1 + (i % 9 + i // 9 * 9) % 3, 1 + (j % 9 + j // 9 * 9) % 3
        return round(0.3 * name + 0.7 * min(x, y) / max(x, y), 6)

    want = sorted((*sorted((f"p::{i}", f"p::{j}")), alike(i, j)) for i in range(27) for j in range(i + 1, 27) if alike(i, j) >= 0.5)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
