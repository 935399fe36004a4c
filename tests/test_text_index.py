"""The stored index against plain BM25, over commits, replacements and removals."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from symloom.operators import text_index
from symloom.operators.search import K1, B

SCHEMA = "id long, text string, bucket string, term string, chunk int"


def _bm25(texts, terms, k):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    out = []
    df = {t: sum(t in w for w in words.values()) for t in set(terms)}
    for i, w in words.items():
        tf = Counter(w)
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(w) / mean)) for t in set(terms) if tf[t])
        if score:
            out.append((i, round(score, 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


def _rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], SCHEMA).repartition(3)


def _text(rng, n):
    return " ".join(rng.choice(["the"] * 6 + ["graph", "index", "node"] + [f"w{int(rng.paretovariate(0.5)) % 900}"]) for _ in range(n))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Three commits: new, replaced, deleted, empty, null and repeated documents."""
    path, rng = str(tmp_path_factory.mktemp("index")), random.Random(1)
    held = {}
    first = [(i, _text(rng, rng.randrange(1, 60))) for i in range(400)] + [(900, None), (901, ""), (401, ""), (None, "the graph"), (402, "Über graph, GRAPH!"), (403, "rare rare rare"), (403, "rare rare rare")]
    second = [(i, _text(rng, rng.randrange(1, 60))) for i in range(300, 600) if i != 401] + [(401, "graph again")]
    third = [(7, "graph only"), (450, "")]
    gone = [3, 4, 5, 403, 9999]
    held |= {i: t for i, t in first if i is not None} | dict(second)
    for i in gone:
        held.pop(i, None)
    held |= dict(third)
    text_index.extend(_rows(spark, first), path, 0)
    text_index.extend(_rows(spark, second), path, 1)
    text_index.extend(_rows(spark, third), path, 2, deleted=spark.createDataFrame([(i,) for i in gone], "doc long"))
    return path, held


@pytest.mark.parametrize("terms", [["the"], ["graph", "index"], ["the", "w3", "graph"], ["rare"], ["absent"], ["absent", "node"], ["über"], []])
def test_topk_equals_plain_bm25(spark, built, terms):
    path, held = built
    got = [(r["doc"], r["score"]) for r in text_index.topk(spark, path, terms, 12).collect()]
    want = _bm25(held, terms, 12)
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
    assert len({i for i, _ in got} & {i for i, _ in want}) >= len(want) - 1  # last digits may order a tie apart


def test_many_queries_at_once(spark, built):
    path, held = built
    queries = {1: ["the", "graph"], 2: ["rare"], 3: ["index", "index", "w3"]}
    rows = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "q long, term string")
    got = {(r["q"], r["doc"]): r["score"] for r in text_index.Index(spark, path).scores(rows).collect()}
    want = {(q, i): s for q, ts in queries.items() for i, s in _bm25(held, ts, 10**6)}
    assert got == pytest.approx(want, abs=2e-6)


def test_a_batch_written_again_changes_nothing(spark, built):
    path, held = built
    before = sorted(map(tuple, text_index.entries(spark, path).collect()))
    rows = [(7, "graph only"), (450, "")]
    gone = spark.createDataFrame([(i,) for i in (3, 4, 5, 403, 9999)], "doc long")
    text_index.extend(_rows(spark, rows), path, 2, deleted=gone)
    assert sorted(map(tuple, text_index.entries(spark, path).collect())) == before
    words = {(w, i, n) for i, t in held.items() for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items()}
    assert {r[:3] for r in before} == words


def test_only_buckets_of_the_terms_are_read_and_blocks_are_skipped(spark, tmp_path):
    rng = random.Random(2)
    path = str(tmp_path / "index")
    texts = [(i, _text(rng, rng.randrange(5, 80)) + " graph" * (20 if i % 500 == 0 else i % 3)) for i in range(6000)]
    text_index.extend(_rows(spark, texts), path, 0)
    index = text_index.Index(spark, path)
    top, (held, kept, _) = index.topk(["graph", "the"], 5), index._blocks(["graph", "the"], 5)
    want = _bm25(dict(texts), ["graph", "the"], 5)
    assert [r["score"] for r in top.collect()] == pytest.approx([s for _, s in want], abs=2e-6)
    assert kept.count() < held.count()
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull", "") and "In(term" in plan
    files = held.select(F.input_file_name()).distinct().count()
    assert files <= 2


def test_blocks_are_bounded(spark):
    docs = spark.range(5000).select("id", F.lit("common word").alias("text"))
    held = text_index.blocks(text_index.occurrences(docs, chunk_docs=100))
    assert held.agg(F.max("n")).first()[0] < 200 and held.agg(F.sum("n")).first()[0] == 10000


def test_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.extend(_rows(spark, []), path, 0)
    assert text_index.topk(spark, path, ["a"]).count() == 0
    text_index.extend(_rows(spark, [(1, "a b")]), path, 1)
    assert [r["doc"] for r in text_index.topk(spark, path, ["a"]).collect()] == [1]


def test_many_queries_keep_their_best_documents_alone(spark, built, monkeypatch):
    """Blocks of queries and documents give each query's k best of all scores; the plan
    brings no row for every query and document that share a word."""
    path, held = built
    monkeypatch.setattr(text_index, "QUERIES", 3)
    monkeypatch.setattr(text_index, "DOCUMENTS", 100)
    asked = {1: ["the"], 2: ["graph", "index"], 3: ["the", "w3", "graph"], 4: ["absent"], 5: ["über", "node"], 6: ["rare"], 7: ["node", "w1", "w2"], 8: ["the", "the"]}
    rows = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "q int, term string")
    index = text_index.Index(spark, path)
    got = {}
    for r in index.best(rows, 7).collect():
        got.setdefault(r["q"], []).append((r["doc"], r["score"]))
    for q, ts in asked.items():
        want = _bm25(held, ts, 7)
        mine = sorted(got.get(q, []), key=lambda r: (-r[1], r[0]))
        assert [d for d, _ in mine] == [d for d, _ in want] and [s for _, s in mine] == pytest.approx([s for _, s in want])
    pairs = spark.createDataFrame([(2, 5), (2, 6), (3, 500), (4, 1)], "q int, doc long")
    every = {(r["q"], r["doc"]): r["score"] for r in index.scores(rows).collect()}
    some = {(r["q"], r["doc"]): r["score"] for r in index.scores(rows, pairs).collect()}
    assert some == {k: v for k, v in every.items() if k in {(2, 5), (2, 6), (3, 500), (4, 1)}} and some


def test_reading_back_shuffles_no_postings(spark, tmp_path):
    """Batches stand whole while no version is replaced: entries meet no table of documents."""
    path = str(tmp_path / "whole")
    for b in range(2):
        text_index.extend(spark.createDataFrame([(b * 10 + i, f"w{i} common") for i in range(10)], "id long, text string"), path, b)
    held = text_index.entries(spark, path)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "(doc#" not in plan
    assert held.count() == 40
    text_index.extend(spark.createDataFrame([(3, "other"), (3, "older")], "id long, text string"), path, 2)
    now = text_index.entries(spark, path)
    assert now.count() == 39 and [r["term"] for r in now.filter("doc = 3").collect()] == ["other"]


def test_copies_of_texts_are_scored_once(spark, tmp_path, monkeypatch):
    """Six texts, sixty times each, with a word of its own each: blocks meet six documents and six
    queries; of equal scores the first keys are kept, and words of few documents count."""
    texts = ["red fox", "red red cat", "blue fox", "blue cat dog", "dog", "red blue dog"]
    held = {i: f"{texts[i % 6]} own{i}" + (" few" if i in (77, 203) else "") for i in range(360)}
    path = str(tmp_path / "index")
    text_index.extend(_rows(spark, list(held.items())), path, 0)
    met, blocks = [], text_index.Index._met
    monkeypatch.setattr(text_index.Index, "_met", lambda self, q, d, k: (met.append((q.select("q").distinct().count(), d.select("doc").distinct().count())), blocks(self, q, d, k))[1])
    asked = {q: held[q].split() for q in range(0, 360, 20)} | {203: held[203].split(), 1000: ["own5", "few"]}
    index = text_index.Index(spark, path)
    rows = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "q long, term string")
    got = {}
    for r in index.best(rows, 7).collect():
        got.setdefault(r["q"], []).append((r["doc"], r["score"]))
    for q, ts in asked.items():
        want = _bm25(held, ts, 7)
        mine = sorted(got[q], key=lambda r: (-r[1], r[0]))
        assert [d for d, _ in mine] == [d for d, _ in want] and [s for _, s in mine] == pytest.approx([s for _, s in want])
    # the two documents with a word more are longer: classes of their own
    assert met[0][0] <= 6 and met[0][1] <= 8
