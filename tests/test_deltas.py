"""Counts from deltas against recomputation, in batch and in a stream."""

import random
from collections import Counter

from symloom.operators import deltas

SCHEMA = "src string, dst string, edge_type string"


def _plain(edges):
    """The four tables, from all edges."""
    whole = [e for e in edges if e[0] is not None and e[1] is not None]
    near = {(a, b) for a, b, _ in whole}
    imports = {(a, b) for a, b, t in whole if t == "imports"}
    modules = Counter((a.split("::")[0], b.split("::")[0]) for a, b in imports if a.split("::")[0] != b.split("::")[0])
    return {
        "pairs": {k: n for k, n in Counter(whole).items()},
        "types": {(t,): n for t, n in Counter(t for _, _, t in whole).items()},
        "degrees": {(x,): n for x, n in Counter(x for p in near for x in p).items()},
        "modules": dict(modules),
    }


def _found(spark, path, commit):
    return {name: {tuple(r[k] for k in keys): r["n"] for r in deltas.read(spark, path, name, commit).collect()} for name, keys in deltas.KEYS.items()}


def _edges(rng, n):
    node = lambda: None if rng.random() < 0.03 else f"m{rng.randrange(4)}::s{rng.randrange(6)}"
    return [(node(), node(), rng.choice(["calls", "imports", "uses"])) for _ in range(n)]


def _df(spark, edges):
    return spark.createDataFrame(edges, SCHEMA)


def test_adds_changes_and_removals_equal_recomputation(spark, tmp_path):
    rng, path, files = random.Random(1), str(tmp_path / "counts"), {}
    for commit in range(1, 5):
        changed = rng.sample(range(6), 3)
        old = [e for f in changed for e in files.get(f, [])]
        for f in changed:
            files[f] = [] if rng.random() < 0.3 else _edges(rng, rng.randrange(0, 15))
        new = [e for f in changed for e in files[f]]
        for _ in range(2 if commit == 3 else 1):  # a commit written again
            deltas.update(spark, path, commit, _df(spark, old), _df(spark, new))
        assert _found(spark, path, commit) == _plain([e for f in files.values() for e in f])
    deltas.update(spark, path, 5, _df(spark, [e for f in files.values() for e in f]), _df(spark, []))
    assert _found(spark, path, 5) == _plain([])


def test_a_stream_of_changes(spark, tmp_path):
    rng, path, folder = random.Random(2), str(tmp_path / "counts"), str(tmp_path / "changes")
    held: list = []
    for commit in range(1, 3):
        gone = rng.sample(held, len(held) // 3)
        for e in gone:
            held.remove(e)
        new = _edges(rng, 30)
        held += new
        rows = [(*e, -1) for e in gone] + [(*e, 1) for e in new]
        spark.createDataFrame(rows, SCHEMA + ", sign int").coalesce(1).write.mode("append").parquet(folder)
        deltas.follow(spark.readStream.schema(SCHEMA + ", sign int").parquet(folder), path, str(tmp_path / "mark")).awaitTermination()
        assert _found(spark, path, commit) == _plain(held)


def test_a_table_alone_brings_only_what_it_needs(spark, tmp_path):
    rng = random.Random(3)
    first, second = _edges(rng, 40), _edges(rng, 25)
    for name, written in (("types", {"types"}), ("degrees", {"pairs", "degrees"}), ("modules", {"pairs", "modules"})):
        path = tmp_path / name
        deltas.update(spark, str(path), 1, _df(spark, []), _df(spark, first), (name,))
        deltas.update(spark, str(path), 2, _df(spark, first[:15]), _df(spark, second), (name,))
        assert {x.name for x in path.iterdir()} == written
        assert _found(spark, str(path), 2)[name] == _plain(first[15:] + second)[name]
