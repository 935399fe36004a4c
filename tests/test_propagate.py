"""Propagated flags and counts against plain sets."""

import random

from pyspark.sql import functions as F

from symloom.operators import propagate


def _within(pairs, depth):
    """``node -> nodes`` reached in 1 to ``depth`` steps."""
    out = {}
    for start in {a for a, _ in pairs}:
        seen, front = set(), {start}
        for _ in range(depth):
            front = {b for a, b in pairs if a in front}
            seen |= front
        out[start] = seen
    return out


def _graph(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)} | {("n1", "n1")})


def test_flags_by_depth(spark):
    pairs = _graph(1, 60, 110)
    masks = {f"n{i}": 1 << (i % 3) for i in range(0, 60, 4)} | {"n2": 1 << 62, "n3": 0}
    df = spark.createDataFrame(pairs, "src string, dst string").repartition(3)
    levels = propagate.reach_flags(df.union(df), spark.createDataFrame(list(masks.items()), "node string, mask long"), 3)
    for depth, level in enumerate(levels, 1):
        want = {}
        for node, seen in _within(pairs, depth).items():
            m = 0
            for x in seen:
                m |= masks.get(x, 0)
            if m:
                want[node] = m
        assert dict(level.collect()) == want


def test_counts_are_exact_over_many_blocks(spark):
    pairs = _graph(2, 5000, 9000)
    df = spark.createDataFrame(pairs, "src string, dst string")
    for depth in (1, 3):
        got = dict(propagate.reach_counts(df, df.select(F.col("dst").alias("node")).distinct(), depth).collect())
        assert got == {n: len(s) for n, s in _within(pairs, depth).items()}


def test_counts_of_marks_that_nodes_share(spark):
    pairs = _graph(3, 40, 90)
    marks = [(f"n{i}", f"m{i % 5}") for i in range(0, 40, 2)] + [("n0", "other"), ("n0", "m0")]
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = dict(propagate.reach_counts(df, spark.createDataFrame(marks, "node string, mark string"), 2).collect())
    want = {n: len({m for x, m in marks if x in s}) for n, s in _within(pairs, 2).items()}
    assert got == {n: c for n, c in want.items() if c}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert propagate.reach_counts(none, none.select(F.col("dst").alias("node")), 2).count() == 0
    assert propagate.reach_flags(none, spark.createDataFrame([("a", 1)], "node string, mask long"), 2)[1].count() == 0


def test_the_hub_of_a_star_is_no_table_of_pairs(spark):
    """All callers of a hub: masks grow with the blocks, not with the pairs."""
    n = 3000
    df = spark.range(n).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("hub").alias("dst"))
    df = df.union(spark.range(n).select(F.lit("hub").alias("src"), F.concat(F.lit("b"), "id").alias("dst")))
    got = propagate.reach_counts(df, df.select(F.col("dst").alias("node")).distinct(), 2)
    assert {r["reached"] for r in got.filter("node <> 'hub'").collect()} == {n + 1}


def test_marks_of_parts_of_a_graph_share_blocks(spark):
    """Thirty graphs without an edge between them: a node has rows for the blocks of its
    own graph (parts end blocks early, so a few more), not for those of the others."""
    rng = random.Random(9)
    pairs = sorted({(f"n{rng.randrange(500)}g{g}", f"n{rng.randrange(500)}g{g}") for g in range(30) for _ in range(2500)})
    df = spark.createDataFrame(pairs, "src string, dst string")
    marks = df.select(F.col("dst").alias("node")).distinct().withColumn("mark", F.col("node"))
    at = propagate.numbered(marks, propagate.labels(df))
    assert at.select("block", "at").distinct().count() == at.count() == marks.count()
    blocks = at.groupBy(F.split_part("mark", F.lit("g"), F.lit(2)).alias("g")).agg(F.countDistinct("block").alias("n"))
    assert at.select("block").distinct().count() > 10 and blocks.agg(F.avg("n")).first()[0] <= 3
    got = dict(propagate.reach_counts(df, df.select(F.col("dst").alias("node")).distinct(), 2).collect())
    one = [p for p in pairs if p[0].endswith("g7")]
    assert {n: c for n, c in got.items() if n.endswith("g7")} == {n: len(s) for n, s in _within(one, 2).items()}


def test_steps_are_dealt_by_the_rows_they_merge(spark, monkeypatch):
    """More rows, more partitions; the setting stands as before afterwards."""
    name, parts, stored = "spark.sql.shuffle.partitions", [], propagate.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(propagate, "stored", lambda df: parts.append(int(df.sparkSession.conf.get(name))) or stored(df))
    monkeypatch.setattr(propagate, "TASK", 40)
    pairs = _graph(4, 300, 900)
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = dict(propagate.reach_counts(df, df.select(F.col("dst").alias("node")).distinct(), 2).collect())
    assert got == {n: len(s) for n, s in _within(pairs, 2).items()}
    assert max(parts) >= len(pairs) // 40 > int(before) and spark.conf.get(name) == before


def test_two_steps_need_no_masks(spark, monkeypatch):
    monkeypatch.setattr(propagate, "_by_masks", None)
    pairs = _graph(4, 60, 300) + [(f"n{i}", "hub") for i in range(50)] + [("hub", f"n{i}") for i in range(50)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    marks = spark.createDataFrame([(f"n{i}", f"m{i % 7}") for i in range(0, 60, 2)], "node string, mark string")
    want = {depth: {n: len(s) for n, s in _within(pairs, depth).items()} for depth in (1, 2)}
    shared = {n: len({int(x[1:]) % 7 for x in s if x != "hub" and int(x[1:]) % 2 == 0}) for n, s in _within(pairs, 2).items()}
    for longest, most in ((1024, 10**6), (3, 20)):  # one list a node; hubs by several lists, and dealt by mark
        monkeypatch.setattr(propagate, "LIST", longest)
        monkeypatch.setattr(propagate, "WALKS", most)
        for depth in (1, 2):
            assert dict(propagate.reach_counts(df.union(df), df.select(F.col("dst").alias("node")).distinct(), depth).collect()) == want[depth]
        assert dict(propagate.reach_counts(df, marks, 2).collect()) == {n: c for n, c in shared.items() if c}


def test_parts_of_a_graph_need_no_masks(spark, monkeypatch):
    """Parts that no edge joins, a chain and a star among them, are tasks; nothing of them is shuffled by steps."""
    monkeypatch.setattr(propagate, "_by_masks", None)
    pairs = [(f"{a}g{g}", f"{b}g{g}") for g in range(12) for a, b in _graph(g, 40, 70)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)] + [(f"s{i}", "end") for i in range(0, 80, 3)] + [("own", "own")]
    df = spark.createDataFrame(pairs, "src string, dst string").repartition(5)
    marks = [(n, f"m{i % 9}") for i, n in enumerate(sorted({b for _, b in pairs}))]
    want = {n: len(s) for n, s in _within(pairs, 4).items()}
    shared = {n: len({m for x, m in marks if x in s}) for n, s in _within(pairs, 4).items()}
    for few, width in ((10**5, 8192), (20, 64)):  # in one group; each part in slices of its own
        monkeypatch.setattr(propagate.parts, "FEW", few)
        monkeypatch.setattr(propagate, "SLICE", width)
        assert dict(propagate.reach_counts(df.union(df), df.select(F.col("dst").alias("node")).distinct(), 4).collect()) == want
        assert dict(propagate.reach_counts(df, spark.createDataFrame(marks, "node string, mark string"), 4).collect()) == {n: c for n, c in shared.items() if c}


def test_large_parts_go_by_masks_beside_small_ones(spark, monkeypatch):
    """Parts over the bound, and ones that the contractions leave open, are still counted whole."""
    pairs = _graph(3, 300, 900) + [(f"c{i}", f"c{i + 1}") for i in range(200)] + [(f"x{g}", f"y{g}") for g in range(20)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    want = {n: len(s) for n, s in _within(pairs, 3).items()}
    nodes, masks, went = df.select(F.col("dst").alias("node")).distinct(), propagate._by_masks, []
    monkeypatch.setattr(propagate, "_by_masks", lambda pairs, *a: (went.append(pairs.count()), masks(pairs, *a))[1])
    for most, rounds, left in ((500, 12, 901), (10**6, 1, None), (0, 12, len(pairs))):
        monkeypatch.setattr(propagate.parts, "ARCS", most)
        monkeypatch.setattr(propagate.parts, "ROUNDS", rounds)
        assert dict(propagate.reach_counts(df, nodes, 3).collect()) == want
        assert left is None or abs(went[-1] - left) <= 5
