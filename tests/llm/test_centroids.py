"""Centroid clustering against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from symloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string"


def _plain(rows, k=8, rounds=10):
    """``vec_id -> (cluster, distance, inertias, digest)`` without any screening."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    spread = {j: sum(d for _, d, a in found if a == j) for j in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, spread[j], sum(spread.values()), digest[j]) for i, d, j in found), key=str)


def _run(spark, rows):
    df = spark.createDataFrame([(i, e, 1, "x", "y") for i, e in rows], SCHEMA).repartition(3)
    got = centroids.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def _vectors(seed, n, kinds):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(kinds, 64))
    return [[float(x) for x in (middles[rng.integers(kinds)] + rng.normal(size=64) * 0.3).astype(np.float32)] for _ in range(n)]


def test_equals_plain_lloyd_with_odd_rows(spark):
    rows = list(enumerate(_vectors(1, 150, 5)))
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] * 64)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])] + [(i, rows[5][1]) for i in range(1000, 1040)]
    assert _run(spark, rows) == _plain(rows)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [0.0] * 64) for i in range(12)] + [(20, [1.0] + [0.0] * 63), (21, [-1.0] + [0.0] * 63)]
    got = _run(spark, rows)
    assert got == _plain(rows)


def test_few_and_no_vectors(spark):
    rows = list(enumerate(_vectors(2, 3, 3)))
    assert _run(spark, rows) == _plain(rows)
    assert _run(spark, []) == []
    assert _run(spark, [(1, None)]) == []


def test_a_component_out_of_bounds_is_an_error(spark):
    with pytest.raises(Exception, match="a component reaches"):
        _run(spark, [(1, [1e9] * 64)])


def test_bounds_prune_and_never_lose_the_nearest():
    v = (np.array(_vectors(3, 2000, 8)) * 1024).astype(np.int64)
    norms, _ = centroids.compress(v)
    middles = v[::250].copy()
    best, least, exact = centroids.nearest(v, norms, middles)
    full = ((v[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
    assert exact < full.size
    # vectors of one direction and unlike norms: the bound is tight, one exact distance each suffices
    ray = np.arange(1, 65)[None, :] * np.arange(1, 401)[:, None]
    _, _, exact = centroids.nearest(ray, centroids.compress(ray)[0], ray[::50])
    assert exact < 1.2 * len(ray)
