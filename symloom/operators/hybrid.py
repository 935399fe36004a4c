"""Hybrid search: vectors, text and graph in one score, made diverse.

    score = alpha * cosine + beta * BM25 / the query's greatest BM25 + gamma / (1 + hops)

Candidates of a query are its nearest vectors, its best texts and its neighbours in
the graph; each gets all three parts of the score, whichever brought it in.  Of the
best ``POOL`` candidates, rows are taken one by one by maximal marginal relevance,

    balance * score - (1 - balance) * greatest cosine to a row taken before.

Defined results: a candidate without a vector has cosine 0 to everything, one without
a path to the query's node closeness 0.  The query's own row is no candidate.  Equal
values go to the smaller id.  A query with no candidate gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.sources.session import cut, ship, stored

from . import graph
from .text_index import Index as TextIndex
from .vectors import Index as VectorIndex

ALPHA, BETA, GAMMA, BALANCE = 0.5, 0.3, 0.2, 0.7
#: Candidates by vector and by text each, hops, rows that are made diverse.
CANDIDATES, HOPS, POOL = 50, 2, 50
#: Queries whose rows are made diverse in one group.
QUERIES = 256


def best_within(rows: DataFrame, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), "id"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _held(vectors: VectorIndex) -> DataFrame:
    return vectors.rows.groupBy("id").agg(F.min("v").alias("v"))


def scored(
    queries: DataFrame, terms: DataFrame, symbols: DataFrame, pairs: DataFrame, vectors: VectorIndex, texts: TextIndex,
    alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA, candidates: int = CANDIDATES, hops: int = HOPS,
) -> DataFrame:
    """``(q, id, score, cosine, text, closeness)`` of all candidates.

    ``queries`` is ``(q, vector, node)``, ``terms`` ``(q, term)``, ``symbols``
    ``(id, node)``; ``pairs`` the edges ``(src, dst)`` walked from the node."""
    near = vectors.knn(queries, candidates + 1).select("q", "id")
    read = cut(texts.best(terms, candidates + 1).select("q", F.col("doc").alias("id")))
    seeds = queries.select("q", F.col("node").alias("seed")).filter("seed is not null")
    steps = graph.reach(pairs, seeds.select(F.col("seed").alias("node")), hops)
    linked = cut(steps.join(seeds, "seed").join(symbols.select("id", "node"), "node").select("q", "id", (1 / (1 + F.col("depth"))).alias("closeness")))
    found = cut(near.union(read).union(linked.select("q", "id")).distinct())
    # of the candidates alone; the best of all is one of them
    text = cut(texts.scores(terms, found.select("q", F.col("id").alias("doc"))).select("q", F.col("doc").alias("id"), F.col("score").alias("text")))
    found = found.filter("q <> id")
    held = _held(vectors)
    asked = held.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    cosine = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    most = text.groupBy("q").agg(F.max("text").alias("most"))
    parts = found.join(held, "id", "left").join(asked, "q", "left").join(text, ["q", "id"], "left").join(most, "q", "left").join(linked, ["q", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = parts.select(
        "q", "id", F.round(zero(cosine), 9).alias("cosine"), zero(F.try_divide("text", "most")).alias("text"), zero(F.col("closeness")).alias("closeness")
    )
    return parts.withColumn("score", F.round(alpha * F.col("cosine") + beta * F.col("text") + gamma * F.col("closeness"), 9))


def marginal(ids: np.ndarray, scores: np.ndarray, like: np.ndarray, k: int, balance: float) -> list[int]:
    """Places of the rows taken, in order: maximal marginal relevance."""
    left, taken = np.argsort(ids, kind="stable"), []
    nearest = np.zeros(len(ids))
    while len(left) and len(taken) < k:
        at = int(np.argmax(np.round(balance * scores[left] - (1 - balance) * nearest[left], 9)))
        i = int(left[at])
        nearest = np.maximum(nearest, like[i]) if taken else like[i]
        taken.append(i)
        left = np.delete(left, at)
    return taken


def diverse(rows: DataFrame, held: DataFrame, k: int, balance: float = BALANCE, pool: int = POOL) -> DataFrame:
    """``(q, id, score, rank)``: of each query's ``pool`` best rows, k by marginal
    relevance, with the vectors of ``held`` ``(id, v)``; a group is bounded by the pool of ``QUERIES``."""
    best = stored(best_within(rows.select("q", "id", "score"), "score", pool))
    groups = -(-best.count() // (QUERIES * pool)) or 1

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("q", kind="stable")
        ids, scores, vectors = f["id"].to_numpy(), f["score"].to_numpy(), f["v"].to_numpy()
        edges = np.flatnonzero(np.append(True, f["q"].to_numpy()[1:] != f["q"].to_numpy()[:-1]))
        taken, ranks = [], []
        for start, end in zip(edges, np.append(edges[1:], len(f)), strict=True):
            some = vectors[start:end]
            size = max((len(v) for v in some if v is not None), default=1)
            m = np.vstack([np.zeros(size) if v is None else v for v in some])
            at = marginal(ids[start:end], scores[start:end], np.round(m @ m.T, 9), k, balance)
            taken += [start + i for i in at]
            ranks += range(1, len(at) + 1)
        return f.iloc[taken][["q", "id", "score"]].assign(rank=np.array(ranks, dtype="int32"))

    ship(rows.sparkSession)
    kinds = dict(best.dtypes)
    known = best.join(held, "id", "left").withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups)))
    return known.groupBy("group").applyInPandas(pick, f"q {kinds['q']}, id {kinds['id']}, score double, rank int")


def search(
    queries: DataFrame, terms: DataFrame, symbols: DataFrame, pairs: DataFrame, vectors: VectorIndex, texts: TextIndex, k: int = 10, balance: float = BALANCE, **weights: float
) -> DataFrame:
    """``(q, id, score, rank)`` of ``scored`` rows, made diverse."""
    return diverse(scored(queries, terms, symbols, pairs, vectors, texts, **weights), _held(vectors), k, balance)
