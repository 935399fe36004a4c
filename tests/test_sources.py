from __future__ import annotations

from symloom.sources import walk
from symloom.streaming import incremental


def test_walk(spark, tmp_path):
    for name, text in {"a.py": "x = 1\ny\n", "src/b.ts": "let a", "node_modules/c.js": "x", "distance.py": "z", ".hidden.go": "package x", "gen/d.py": "x", "notes.md": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    rows = {r.path: r for r in walk.walk(spark, str(tmp_path), ["gen/", "# note"]).collect()}
    assert set(rows) == {"a.py", "src/b.ts", "distance.py", "bad.py", ".hidden.go"} or set(rows) == {"a.py", "src/b.ts", "distance.py", "bad.py"}
    assert (rows["a.py"].lines, rows["src/b.ts"].lines, rows["distance.py"].lines, rows["bad.py"].error) == (2, 1, 1, "not UTF-8")
    found = {r.language: (r.files, r.marked) for r in walk.languages(spark.createDataFrame([("x/a.py",), ("pyproject.toml",), ("b.rs",)], "path string")).collect()}
    assert found == {"python": (1, True), "rust": (1, False)}


def test_ignore_patterns_take_back(spark):
    df = spark.createDataFrame([("a.log",), ("keep.log",), ("x/a.log",), ("x/y.py",)], "path string")
    left = df.filter(~walk.ignored(df["path"], ["*.log", "!keep.log"])).collect()
    assert {r.path for r in left} == {"keep.log", "x/y.py"}


IGNORES = {
    ".gitignore": "# notes\n*.log\n!keep.log\n/only_top.py\nout/\ndoc/*.txt\n**/cache\na/**/z.py\nlib/**\n\\#odd.py\nsp.py  \n[ab]?.c\n[!x]y.h\n",
    "sub/.gitignore": "*.py\n!good.py\n!*.log\n/deep/x.rs\n",
    "sub/deep/.gitignore": "!x.py\ngood.py\n",
    "out/.gitignore": "!*\n",
}
#: Paths with what git says of them (check-ignore --no-index), written down once.
TREE = {
    "a.log": True, "keep.log": False, "x/a.log": True, "x/keep.log": False, "only_top.py": True, "x/only_top.py": False, "out/f.py": True, "x/out/f.py": True, "out.py": False,
    "doc/a.txt": True, "doc/x/a.txt": False, "x/doc/a.txt": False, "cache/f.py": True, "x/y/cache": True, "x/caches/f.py": False, "a/z.py": True, "a/b/c/z.py": True, "b/a/z.py": False,
    "lib/f.py": True, "lib/x/f.py": True, "x/lib/f.py": False, "#odd.py": True, "sp.py": True, "a1.c": True, "ab1.c": False, "c1.c": False, "qy.h": True, "xy.h": False,
    "sub/f.py": True, "sub/good.py": False, "sub/x.log": False, "sub/deep/x.rs": True, "sub/deep/x.py": False, "sub/deep/good.py": True, "sub/deep/other.py": True, "sub/x.rs": False, "sub/q/deep/x.rs": False,
}


def test_ignore_files_of_the_tree(spark):
    files = spark.createDataFrame([(p, "kept") for p in TREE] + [("a.log", "again")], "path string, folder string")
    ignores = spark.createDataFrame(list(IGNORES.items()), "path string, content string")
    left = walk.not_ignored(files, ignores)
    assert left.columns == files.columns
    assert sorted(r.path for r in left.collect()) == sorted(p for p, gone in TREE.items() if not gone)
    assert walk.not_ignored(files, ignores.limit(0)).count() == files.count()


def test_stream_replaces_slices(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\n")
    (src / "b.py").write_text("def g(): pass\n")
    incremental.run(incremental.read_files(spark, str(src)), out, check).awaitTermination()
    (src / "c.py").write_text("def h(): pass\n")
    incremental.run(incremental.read_files(spark, str(src)), out, check).awaitTermination()
    rows = spark.read.parquet(out)
    assert {r.name for r in rows.filter("commit_id = 1").collect()} == {"f", "g"}
    assert {r.name for r in rows.filter("commit_id = 2").collect()} == {"f", "g", "h"}
