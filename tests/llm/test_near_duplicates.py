from __future__ import annotations

import random

import numpy as np
import pytest

from symloom.llm import minhash
from symloom.llm.graph import components


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets.setdefault(i, set()).update(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else sets.setdefault(i, set()).update([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(docs, texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k).collect() if r.doc_id is not None}
    assert got == brute(texts, k)


def test_every_row_stays_and_one_of_a_group_is_kept(docs, texts):
    rows = minhash.near_duplicates(docs, 2).collect()
    assert len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_near_copy_group(spark):
    """Pairs around the threshold: blocks, best partners and the last round."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    old = minhash.BLOCK
    minhash.BLOCK = 32
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    finally:
        minhash.BLOCK = old
    assert got == brute(rows, 2)


def test_empty_table(no_docs):
    assert minhash.near_duplicates(no_docs, 2).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 5000):
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert (minhash.sketch(s) < np.iinfo(np.uint64).max).all()
    both = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = np.unique(np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)])), np.unique(np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    agree = (minhash.sketch(a) == minhash.sketch(b)).mean()
    assert abs(agree - 0.8) < 5 * (0.16 / minhash.T) ** 0.5


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 230)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {100, 7} and got[140] == 100 and got[229] == 7


def test_recall_of_planted_pairs_at_the_threshold(spark):
    """Pairs from just over to just under 0.8, none like another pair."""
    rng, rows, linked = random.Random(9), [], set()
    for p in range(1500):
        words = [f"p{p}x{j}" for j in range(120)]
        other = words[: rng.randrange(94, 108)] + [f"q{p}x{j}" for j in range(rng.randrange(0, 10))]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
        a, b = (set(zip(w, w[1:])) for w in (words, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            linked.add(p)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert 300 < len(linked) < 1450
    for sigmas in (minhash.SIGMAS, None):
        got = {r.doc_id // 2 for r in minhash.near_duplicates(docs, 2, sigmas=sigmas).filter("not kept").collect()}
        assert got == linked
