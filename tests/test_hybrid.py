"""Vector index against exact search; hybrid search against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.operators import hybrid, text_index, vectors

SCHEMA = "id long, vector array<float>, cell int, chunk string"


def _clustered(seed, n, dims=24, kinds=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(kinds, dims))
    return [(i, [float(x) for x in middles[rng.integers(kinds)] + 0.35 * rng.normal(size=dims)]) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)


def _units(rows):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], np.float32).astype(np.float64)
    return ids, m / np.linalg.norm(m, axis=1, keepdims=True)


def _exact(rows, asked, k):
    ids, m = _units(rows)
    at = {i: j for j, i in enumerate(ids)}
    out = {}
    for q in asked:
        like = np.round(m @ m[at[q]], 9)
        out[q] = sorted(((-c, i) for c, i in zip(like, ids, strict=True)))[:k]
    return out


def _asked(df, ids):
    return df.filter(F.col("id").isin(ids)).select(F.col("id").alias("q"), "vector")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = _clustered(1, 4000)
    path = str(tmp_path_factory.mktemp("vectors"))
    df = _frame(spark, rows)
    vectors.build(df, path)
    return rows, df, vectors.Index(spark, path)


def test_recall_of_the_probed_cells(index):
    rows, df, found = index
    asked = list(range(0, 4000, 20))
    got = {}
    for r in found.knn(_asked(df, asked), 10).collect():
        got.setdefault(r["q"], set()).add(r["id"])
    want = _exact(rows, asked, 10)
    recall = np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in asked])
    assert recall >= 0.9 and found.probes < len(found.centres) / 2, (recall, found.probes, len(found.centres))


def test_all_cells_give_the_exact_answer(index):
    rows, df, found = index
    asked = list(range(3, 4000, 400))
    got = {}
    for r in found.knn(_asked(df, asked), 7, probes=10**6).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((-r["cosine"], r["id"]))
    want = _exact(rows, asked, 7)
    for q in asked:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([c for c, _ in got[q]], [c for c, _ in want[q]], atol=1e-8)


def test_a_crowded_cell_has_many_chunks_and_many_queries_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 50)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(i, [1.0, 1e-3 * i]) for i in range(900)] + [(1000 + i, [-1.0, 1e-3 * i]) for i in range(3)]
    df = _frame(spark, rows)
    vectors.build(df, str(tmp_path / "v"), cells=2)
    found = vectors.Index(spark, str(tmp_path / "v"))
    assert found.rows.groupBy("cell", "chunk").count().agg(F.max("count")).first()[0] < 120
    got = found.knn(_asked(df, list(range(0, 900, 9))), 3, probes=2)
    assert got.count() == 300 and got.filter("rank = 1 and q = id").count() >= 95


def test_odd_vectors(spark, tmp_path):
    odd = [(None, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0])]
    df = _frame(spark, odd)
    vectors.build(df, str(tmp_path / "v"))
    got = vectors.Index(spark, str(tmp_path / "v")).knn(_asked(df, list(range(9))), 2)
    assert sorted((r["q"], r["id"], r["rank"]) for r in got.collect()) == [(7, 7, 1), (7, 8, 2)] + [(8, 7, 1)] * 1 + [(8, 8, 2)] * 1
    none = _frame(spark, [])
    vectors.build(none, str(tmp_path / "none"))
    assert vectors.Index(spark, str(tmp_path / "none")).knn(_asked(df, [7]), 2).count() == 0


def _plain_mmr(ids, scores, like, k, balance):
    """Straight from the formula, over sets."""
    left, taken = set(range(len(ids))), []
    while left and len(taken) < k:
        gain = {i: round(balance * scores[i] - (1 - balance) * max((like[i][j] for j in taken), default=0.0), 9) for i in left}
        best = min(left, key=lambda i: (-gain[i], ids[i]))
        taken.append(best)
        left.discard(best)
    return taken


def test_marginal_relevance_equals_the_formula():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40):
        m = rng.normal(size=(n, 6))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        if n > 5:
            m[3] = m[1]
        like, scores, ids = np.round(m @ m.T, 9), np.round(rng.random(n), 1), rng.permutation(n)
        for balance in (0.0, 0.4, 0.7, 1.0):
            assert hybrid.marginal(ids, scores, like, 10, balance) == _plain_mmr(ids, scores, like, 10, balance)


def test_search_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(3)
    rows = _clustered(2, 120, dims=8, kinds=4)
    texts = {i: " ".join(rng.choice(["red", "green", "blue", "cyan", "pink", "grey"]) for _ in range(rng.randrange(0, 6))) for i in range(130)}
    edges = sorted({(f"n{rng.randrange(130)}", f"n{rng.randrange(130)}") for _ in range(150)})
    vectors.build(_frame(spark, rows), str(tmp_path / "v"))
    text_index.extend(spark.createDataFrame(list(texts.items()), "id long, text string"), str(tmp_path / "t"), 0)
    asked = [0, 7, 64, 125]
    held = dict(rows)
    queries = spark.createDataFrame([(q, held.get(q), f"n{q}") for q in asked], "q long, vector array<float>, node string")
    terms = spark.createDataFrame([(q, t) for q in asked for t in set(texts[q].split())], "q long, term string")
    symbols = spark.createDataFrame([(i, f"n{i}") for i in range(130)], "id long, node string")
    pairs = spark.createDataFrame(edges, "src string, dst string")
    found = vectors.Index(spark, str(tmp_path / "v"))
    found.probes = len(found.centres)
    got = {}
    for r in hybrid.search(queries, terms, symbols, pairs, found, text_index.Index(spark, str(tmp_path / "t")), k=8, candidates=500).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["id"], r["score"]))

    ids, m = _units(rows)
    v = dict(zip(ids, m, strict=True))
    words = {i: t.split() for i, t in texts.items()}
    mean, n = sum(map(len, words.values())) / len(words), len(words)
    for q in asked:
        bm = {}
        for i, w in words.items():
            s = 0.0
            for t in set(words[q]):
                df, tf = sum(t in x for x in words.values()), w.count(t)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0.0
            if s:
                bm[i] = round(s, 6)
        one = {b for a, b in edges if a == f"n{q}"}
        two = {b for a, b in edges if a in one}
        hops = {int(x[1:]): 2 for x in two} | {int(x[1:]): 1 for x in one}
        hops.pop(q, None)
        pool = {i for i in (set(v) if q in v else set()) | set(bm) | set(hops) if i != q}
        cosine = {i: round(float(v[i] @ v[q]), 9) if i in v and q in v else 0.0 for i in pool}
        score = {i: round(0.5 * cosine[i] + 0.3 * bm.get(i, 0.0) / max(bm.values(), default=1.0) + 0.2 * (1 / (1 + hops[i]) if i in hops else 0.0), 9) for i in pool}
        best = sorted(pool, key=lambda i: (-score[i], i))[: hybrid.POOL]
        zero = np.zeros(8)
        like = np.round([[v.get(i, zero) @ v.get(j, zero) for j in best] for i in best], 9)
        want = [best[i] for i in _plain_mmr(best, [score[i] for i in best], like, 8, hybrid.BALANCE)]
        assert [i for i, _ in got[q]] == want
        assert [s for _, s in got[q]] == pytest.approx([score[i] for i in want], abs=1e-6)


def test_vectors_of_unlike_lengths(spark, tmp_path):
    """What a vector has not counts as 0; no row is lost, and longer queries are no error."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=2 + i % 3)]) for i in range(60)]
    vectors.build(_frame(spark, rows), str(tmp_path / "v"))
    asked = [(q, v) for q, v in rows[::7]] + [(100, [1.0, 0.5, -1.0, 2.0, 1.0, 0.1])]
    got = {}
    for r in vectors.Index(spark, str(tmp_path / "v")).knn(_frame(spark, asked).select(F.col("id").alias("q"), "vector"), 5, probes=10**6).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["id"], r["cosine"]))
    wide = lambda v: np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))
    for q, v in asked:
        like = {i: wide(x) @ wide(v) / np.linalg.norm(wide(x)) / np.linalg.norm(wide(v)) for i, x in rows}
        want = sorted(like, key=lambda i: (-round(like[i], 9), i))[:5]
        assert [i for i, _ in got[q]] == want and [c for _, c in got[q]] == pytest.approx([like[i] for i in want])


def test_equal_cosines_of_many_parts_are_in_the_order_of_keys(spark, tmp_path, monkeypatch):
    """Copies over several parts and blocks: the first keys of the nearest, each once."""
    for name, n in (("CHUNK", 20), ("PART", 50), ("BLOCK", 8), ("STRIP", 3)):
        monkeypatch.setattr(vectors, name, n)
    kinds = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.2], [0.5, 0.5, -1.0]]
    df = _frame(spark, [(i, kinds[i % 3]) for i in range(300)])
    vectors.build(df, str(tmp_path / "v"))
    got = {}
    for r in vectors.Index(spark, str(tmp_path / "v")).knn(_asked(df, list(range(0, 300, 10))), 4, probes=10**6).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == {q: [q % 3 + 3 * i for i in range(4)] for q in range(0, 300, 10)}
