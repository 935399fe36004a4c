from __future__ import annotations

import json

from pyspark.sql import functions as F

from symloom.operators import lookup, search, store
from symloom.sources import scip


def test_commits_are_created_once(spark):
    none = spark.createDataFrame([], "commit_id long, commit_sha string, ts long")
    one = store.get_or_create_commit(none, "abc", now=5)
    assert [tuple(r) for r in store.get_or_create_commit(one, "abc", now=9).collect()] == [(1, "abc", 5)]
    assert {r.commit_id for r in store.get_or_create_commit(one, "def").collect()} == {1, 2}


def test_later_rows_replace(spark):
    rows = spark.createDataFrame([(1, 1, "s", "old"), (2, 1, "s", "new"), (3, 2, "s", "other")], "seq long, commit_id long, symbol_id string, name string")
    assert {(r.commit_id, r.name) for r in store.upsert(rows, ["commit_id", "symbol_id"]).collect()} == {(1, "new"), (2, "other")}


def test_slices_diffs_and_closure(spark):
    s = spark.createDataFrame([(1, "a.py", "f"), (1, "b.py", "g")], "commit_id long, file_path string, name string")
    e = spark.createDataFrame([(1, "imports", "a.py", "b.py"), (1, "imports", "b.py", "c.py"), (1, "calls", None, "c.py")], "commit_id long, edge_type string, file_src string, file_dst string")
    changed = spark.createDataFrame([(1, "a.py")], "commit_id long, path string")
    left = store.delete_slice(s, e, s, changed)
    assert [x.count() for x in left] == [1, 2, 1]
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in store.snapshot_diff(old, new).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    assert {r.path for r in store.changed_files(new, old).collect()} == {"b", "d"}
    assert {r.path for r in store.dirty_closure(spark.createDataFrame([("c.py",)], "path string"), e).collect()} == {"c.py", "b.py"}


SYMBOLS = [(1, "User", "m.User", "validates a user"), (2, "UserService", "m.UserService", None), (3, "getUser", "m.getUser", "fetch"), (4, "order", "m.order", "user validation"), (5, "测试", "m.测试", None)]


def table(spark):
    return spark.createDataFrame(SYMBOLS, "id long, name string, fqn string, docstring string")


def test_search_tiers(spark):
    s = table(spark)
    assert [r.id for r in search.like_ranked(s, "User").collect()] == [1, 2, 3]
    assert search.like_ranked(s, "User", 2).count() == 2
    assert {r.id for r in search.search(s, "valid").collect()} == {1, 4}
    assert {r.id for r in search.search(s, '"user validation"').collect()} == {4}
    assert {r.id for r in search.search(s, "order OR 测试").collect()} == {4, 5}
    assert {r.id for r in search.search(s, "etUse").collect()} == {3}  # only the second tier
    assert search.search(s, "").count() == 5


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "validation": "valid", "formaliti": "formal", "adoption": "adopt", "controll": "control", "rate": "rate"}
    assert {w: search.stem(w) for w in words} == words
    assert search.fold("Éa") == "ea"


def test_stemmed_index(spark):
    index = search.postings(table(spark), ["docstring"], stemmed=True)
    assert {r.id for r in search.match_any(index, [search.stem("validating")]).collect()} == {1, 4}


def test_free_sql_with_parameters(spark):
    s = table(spark)
    assert lookup.sql(spark, {"symbols": s}, "select id from symbols where name = ?", ["User"]).collect()[0][0] == 1
    assert lookup.sql(spark, {"symbols": s}, "select count(*) from {symbols}").collect()[0][0] == 5


def test_hostile_names_are_data(spark):
    s = spark.createDataFrame([(1, "'; DROP TABLE symbols; --", "x", "function")], "id long, name string, fqn string, kind string")
    assert lookup.find(s, "drop table").count() == 1


def test_scip(spark, tmp_path):
    sym = lambda d: f"scip-typescript npm pkg 1.0 {d}"
    docs = [
        {
            "relative_path": "src/a.ts",
            "symbols": [
                {"symbol": sym("src/`a.ts`/User#"), "documentation": ["one", "two"], "relationships": [{"symbol": sym("x/Base#"), "is_implementation": True}, {"symbol": sym("x/other().")}]},
                {"symbol": sym("src/run()."), "documentation": None},
                {"symbol": sym("src/User#save().")},
                {"symbol": "local 1"},
            ],
            "occurrences": [{"range": [1, 2, 3], "symbol": "s", "symbol_roles": 1}, {"range": [1, 2, 3, 4], "symbol": "s", "symbol_roles": 4}, {"range": [1], "symbol": "s"}, {"range": [5, 6, 7], "symbol": "s", "symbol_roles": 9}],
        }
    ]
    (tmp_path / "i.json").write_text(json.dumps({"metadata": {"tool_info": {"name": "t", "version": "2"}, "project_root": "r"}, "documents": docs}))
    index = scip.read(spark, str(tmp_path / "i.json"))
    kinds = {r.name: r.kind for r in scip.symbols(index, "c0").collect()}
    assert kinds == {"User": "class", "run": "function", "User#save": "class"}
    assert "method" in {r.kind for r in scip.symbols(index, strict_kinds=True).collect()}
    assert scip.symbols(index, "c0").filter("name = 'User'").first().symbol_id == "repo://c0/src/a.ts/#sym(typescript:src/a.User:4)"
    assert sorted(r.edge_type for r in scip.edges(index).collect()) == ["calls", "implements"]
    assert scip.edges(index).first().provenance == {"source": "t@2"}
    rows = scip.occurrences(index).orderBy("start_line", "end_line", "role").collect()
    assert [(r.role, r.end_line, r.end_col) for r in rows] == [("definition", 1, 3), ("write", 3, 4), ("reference", 5, 7)]


def test_upgrade_of_bare_names(spark):
    e = spark.createDataFrame([("a", "m.f", "syntactic"), ("b", "none", "syntactic"), ("c", "m.f", "semantic")], "src string, dst string, resolution string")
    s = spark.createDataFrame([("id1", "m.f", 1), ("id2", "m.f", 2)], "symbol_id string, fqn string, seq long")
    got = {(r.src, r.dst, r.resolution) for r in scip.upgrade(e, s).collect()}
    assert got == {("a", "id2", "semantic"), ("b", "none", "syntactic"), ("c", "m.f", "semantic")}


def test_dynamic_overwrite_keeps_other_commits(spark, tmp_path):
    path = str(tmp_path / "symbols")
    store.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "commit_id long, name string"), path)
    store.write_snapshot(spark.createDataFrame([(2, "c")], "commit_id long, name string"), path)
    assert {(r.commit_id, r.name) for r in spark.read.parquet(path).select(F.col("commit_id").cast("long"), "name").collect()} == {(1, "a"), (2, "c")}


def test_search_stems_folds_and_reads_paths(spark):
    s = spark.createDataFrame([(1, 7, "f", "p::f", "a request is handled"), (2, 7, "g", "p::g", "le café"), (3, 8, "h", "p::h", "le cafe\u0301 operation"), (4, 8, "i", "p::i", None)], "id long, file_id long, name string, fqn string, docstring string")
    files = spark.createDataFrame([(7, "src/billing.py"), (8, "src/ledger.py")], "id long, path string")
    ids = lambda q, **x: {r.id for r in search.search(s, q, **x).collect()}
    assert ids("handling requests") == {1}
    assert ids("café") == ids("cafe") == {2, 3}
    assert ids("opera") == {3}
    assert ids("ledger", files=files) == {3, 4} and ids("ledger") == set()
