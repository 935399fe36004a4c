from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from symloom.operators import storage
from symloom.operators.storage import MissingStore, Store

EDGE = "commit_id long, edge_type string, src_symbol string, dst_symbol string, resolution string"


def test_a_store_is_created_once_and_checked(spark, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(MissingStore, match="commits"):
        Store.open(spark, folder)
    with Store.create(spark, folder) as s:
        assert all(s.table(t).count() == 0 for t in storage.TABLES)
        s.append("commits", spark.createDataFrame([(1, "a", 5)], "commit_id long, commit_sha string, ts long"))
    assert Store.create(spark, folder).table("commits").count() == 1
    spark.range(1).write.mode("overwrite").parquet(folder + "/files")
    with pytest.raises(MissingStore, match="commit_id, path"):
        Store.open(spark, folder)


def test_appends_are_bags_in_order(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "g"))
    first = spark.createDataFrame([(1, "calls", "a", "b", "syntactic"), (1, "calls", None, "b", None)], EDGE).withColumn("other", F.lit(1))
    kept = s.keep("edges")
    assert kept.count() == 0
    s.append("edges", first)
    s.append("edges", first)
    rows = s.table("edges").orderBy("seq").collect()
    assert len(rows) == 4 and len({r.seq for r in rows}) == 4
    assert sorted((r.src_symbol or "", r.resolution or "") for r in rows) == [("", ""), ("", ""), ("a", "syntactic"), ("a", "syntactic")]
    low, high = rows[:2], rows[2:]
    assert {r.src_symbol for r in low} == {r.src_symbol for r in high} == {"a", None}
    s.append("occurrences", spark.createDataFrame([(1, "f", "call")], "commit_id long, file_path string, role string"))
    assert [r.role for r in s.table("occurrences").collect()] == ["call"]
    s.append("edges", first.limit(0))
    assert s.table("edges").count() == 4


def test_readers_do_not_write_and_see_news_after_refresh(spark, tmp_path):
    folder = str(tmp_path / "g")
    writer, rows = Store.create(spark, folder), spark.createDataFrame([(1, "calls", "a", "b", None)], EDGE)
    writer.append("edges", rows)
    with Store.open(spark, folder) as reader:
        with pytest.raises(PermissionError):
            reader.append("edges", rows)
        assert reader.keep("edges").count() == 1
        for part in (tmp_path / "g/edges/commit_id=1").glob("*.parquet"):  # as another application writes
            shutil.copy(part, part.with_name("other-" + part.name))
        assert reader.table("edges").count() == 1
        reader.refresh()
        assert reader.table("edges").count() == 2
    writer.close()
    with pytest.raises(PermissionError):
        writer.append("edges", rows)


def test_missing_stores_are_built_half_ones_are_not(spark, tmp_path):
    folder, calls = str(tmp_path / "g"), []

    def build(s):
        calls.append(1)
        s.append("commits", spark.createDataFrame([(1, "a", 5)], "commit_id long, commit_sha string, ts long"))

    for _ in range(2):
        assert Store.open_or_build(spark, folder, build).table("commits").count() == 1
    assert calls == [1]
    spark.range(1).write.parquet(str(tmp_path / "half/edges"))
    with pytest.raises(MissingStore):
        Store.open_or_build(spark, str(tmp_path / "half"), build)


def test_old_commits_go(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "g"))
    s.append("commits", spark.createDataFrame([(i, f"c{i}", i) for i in (1, 2, 3)], "commit_id long, commit_sha string, ts long"))
    s.append("edges", spark.createDataFrame([(i, "calls", "a", "b", None) for i in (1, 2, 2, 3)], EDGE))
    assert s.drop_commits(newest=2) == [1]
    assert sorted(r.commit_id for r in s.table("edges").collect()) == [2, 2, 3]
    assert s.table("commits").count() == 3


def test_an_unchanged_commit_needs_no_scan(spark):
    commits = spark.createDataFrame([(1, "a", 9), (2, "b", 3)], "commit_id long, commit_sha string, ts long")
    assert storage.is_current(commits, "b") and not storage.is_current(commits, "a")
    assert not storage.is_current(commits.limit(0), "a")


def test_dry_runs_count(spark):
    files = spark.createDataFrame([("a", 3, 30, None), ("b", None, 5, "not UTF-8")], "path string, lines int, size_bytes long, error string")
    assert tuple(storage.dry_run(files).first()) == (2, 3, 35, 1)
    assert tuple(storage.dry_run(files.limit(0)).first()) == (0, 0, 0, 0)


def test_a_failing_language_leaves_the_others(spark, tmp_path):
    target, rows = str(tmp_path / "s"), lambda *r: spark.createDataFrame(list(r), "file_path string, name string")

    def broken():
        raise RuntimeError("no indexer")

    late = lambda: rows(("x", "y")).withColumn("name", F.raise_error(F.lit("bad file")))
    out = storage.run_languages(spark, {"go": lambda: rows(("a.go", "f"), ("b.go", "g")), "java": broken, "rust": late}, target, 1)
    got = {r.language: r.error for r in out.collect()}
    assert got["go"] is None and "no indexer" in got["java"] and got["rust"]
    assert {(r.commit_id, r.lang, r.name) for r in spark.read.parquet(target).collect()} == {(1, "go", "f"), (1, "go", "g")}
    # the next commit: one file changed, what else the source gives is not taken
    changed = spark.createDataFrame([("a.go",)], "path string")
    storage.run_languages(spark, {"go": lambda: rows(("a.go", "h"), ("b.go", "z"))}, target, 2, changed)
    assert {(r.file_path, r.name) for r in spark.read.parquet(target).filter("commit_id = 2").collect()} == {("a.go", "h"), ("b.go", "g")}
    assert spark.read.parquet(target).filter("commit_id = 1").count() == 2
