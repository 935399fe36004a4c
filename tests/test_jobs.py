"""The two jobs: reruns, growing input, cut-off batches and the command line."""

import json
import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import code_report, index_documents
from symloom.operators import text_index

SF, REPO = "/root/testdata/sf0.001", Path(__file__).resolve().parents[1]
SCHEMA = "doc_id long, text string, lang string"


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def _texts(seed, ids):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(["alpha", "beta", "gamma", "Delta"]) for _ in range(rng.randrange(1, 30))) for i in ids}


def _add(spark, folder, texts, name):
    """One more file in the folder, as an upstream writer would leave it."""
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _index(spark, out):
    return sorted((r["term"], r["doc"], r["tf"]) for r in text_index.entries(spark, out).collect())


def _plain(held):
    return sorted((w, i, n) for i, t in held.items() for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items())


@pytest.fixture
def grown(spark, tmp_path):
    """Two runs over a growing folder."""
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "index", "mark"))
    one, two = _texts(1, range(60)), _texts(2, range(50, 90))
    _add(spark, docs, one, "a")
    first = index_documents.run(spark, docs, out, mark)
    assert (first["batches"], first["documents"]) == (1, 60) and _index(spark, out) == _plain(one)
    _add(spark, docs, two, "b")
    second = index_documents.run(spark, docs, out, mark)
    return docs, out, mark, one | two, second


def test_index_takes_only_what_is_new_and_replaces_changed_documents(spark, grown):
    docs, out, mark, held, second = grown
    assert (second["batches"], second["documents"]) == (1, 40)
    assert _index(spark, out) == _plain(held)
    files = sorted(str(p) for p in Path(out).rglob("*.parquet"))
    third = index_documents.run(spark, docs, out, mark)
    assert third["batches"] == third["documents"] == 0
    assert sorted(str(p) for p in Path(out).rglob("*.parquet")) == files


def test_a_batch_that_was_cut_off_is_taken_again_whole(spark, grown):
    docs, out, mark, held, _ = grown
    last = max(Path(mark, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died after the batch wrote, before it was marked
    (Path(mark, "commits") / f".{last.name}.crc").unlink(missing_ok=True)
    again = index_documents.run(spark, docs, out, mark)
    assert again["documents"] == 40 and _index(spark, out) == _plain(held)


def test_small_batches_give_the_same_index(spark, tmp_path):
    docs, held = str(tmp_path / "docs"), {}
    for k in range(3):
        held |= (new := _texts(k, range(k * 20, k * 20 + 30)))
        _add(spark, docs, new, str(k))
    # files of one second arrive in one order of their own: compare keys met once
    got = index_documents.run(spark, docs, str(tmp_path / "index"), str(tmp_path / "mark"), {"files_per_batch": 1})
    assert got["batches"] == 3
    once = [i for i in held if i % 20 >= 10 or i < 20]
    assert [r for r in _index(spark, str(tmp_path / "index")) if r[1] in once] == _plain({i: held[i] for i in once})


def test_index_of_odd_rows_and_an_unknown_setting(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "index", "mark"))
    _add(spark, docs, {1: None, 2: "", None: "lost", 3: "kept"}, "a")
    index_documents.run(spark, docs, out, mark)
    assert _index(spark, out) == [("kept", 3, 1)]
    with pytest.raises(ValueError, match="unknown settings"):
        index_documents.run(spark, docs, out, mark, {"keyy": "id"})


def test_report_is_the_same_after_a_rerun_and_a_broken_one(spark, tmp_path):
    out = str(tmp_path / "report")
    counts = code_report.run(spark, SF, out)
    first = _rows(spark.read.parquet(f"{out}/symbols")), _rows(spark.read.parquet(f"{out}/issues"))
    assert len(first[0]) == counts["symbols"] and len(first[1]) == counts["issues"]
    victim = next(Path(out, "symbols").rglob("*.parquet"))
    victim.unlink()
    assert code_report.run(spark, SF, out) == counts
    assert (_rows(spark.read.parquet(f"{out}/symbols")), _rows(spark.read.parquet(f"{out}/issues"))) == first
    assert {p.name.split("=")[0] for p in Path(out, "issues").iterdir() if p.is_dir()} == {"severity"}


def test_report_settings(spark, tmp_path):
    out = str(tmp_path / "report")
    code_report.run(spark, SF, out, {"rules": ["hardcoded_secrets"], "complex_over": 0})
    assert {r["type"] for r in spark.read.parquet(f"{out}/issues").select("type").distinct().collect()} <= {"hardcoded_secret"}
    assert spark.read.parquet(f"{out}/symbols").filter("not is_complex").count() == 0
    with pytest.raises(ValueError, match="unknown rules"):
        code_report.run(spark, SF, out, {"rules": ["none"]})


@pytest.mark.parametrize(
    ("name", "arguments"),
    [("code_report", ["--tables", SF, "--output", "{t}/out"]), ("index_documents", ["--documents", f"{SF}/documents.parque[t]", "--output", "{t}/out", "--checkpoint", "{t}/mark"])],
)
def test_command_line(tmp_path, name, arguments):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"rules": ["code_smells"]} if name == "code_report" else {"buckets": 8}))
    command = [sys.executable, "-m", f"jobs.{name}", *[a.format(t=tmp_path) for a in arguments], "--config", str(config)]
    done = subprocess.run(command, cwd=REPO, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert list(Path(tmp_path, "out").rglob("*.parquet"))
    assert "wrote" in done.stderr or "took" in done.stderr
