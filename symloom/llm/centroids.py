"""Centroid clustering with block-norm screening, in exact integers.

A vector is stored with the norms of its eight segments, its compressed form.  By
Cauchy and Schwarz the scalar product of a vector and a centroid is at most that of
their compressed forms, so

    |x|^2 + |c|^2 - 2 sum_s |x_s| |c_s|

never exceeds their squared distance.  A vector's centroid of the smallest bound
gets an exact integer distance; so do the other centroids whose bound does not lie
above the least distance found so far.  The rest are pruned.  Bounds are lowered by
more than their rounding error, so no nearest centroid, tied ones included, is
pruned, and the result is that of plain Lloyd rounds.

A task sends one row of sums a centroid and worker batch, which Spark adds up as
decimals: exact at any number of rows.  The driver holds the centroids alone.

Defined results: vectors that are null, of another length, or hold a null or a
non-finite component are left out.  A null id is clustered like any other but
starts no centroid while other vectors remain; equal rows are vectors of their own
(of equal hashes the smaller components start first).  With fewer vectors than
centroids each vector starts one; an empty table gives no rows.  A component of
2^17 or more in absolute value raises an error, since its squared distances need
not fit a long.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, tune

#: Parameters of the registered query.
DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
SEGMENTS = 8
#: Components stay below this in absolute value, before they are scaled.
LARGEST = 1 << 17
#: Relative slack of the bounds, far above the rounding of sums of 64 doubles.
SLACK = 1e-9


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v, norms)``: integer components and the norms of the segments."""
    x = F.col("embedding")
    whole = (F.size(x) == dims) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(x.isNotNull() & whole)
    checked = F.transform(
        x, lambda e: F.when(F.abs(e) < LARGEST, F.floor(e * float(scale))).otherwise(F.raise_error(F.lit(f"a component reaches {LARGEST}")).cast("long"))
    )
    step = -(-dims // SEGMENTS)
    norms = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1), F.lit(step)),
        lambda s: F.sqrt(F.aggregate(F.slice("v", s + 1, F.lit(step)), F.lit(0).cast("long"), lambda a, e: a + e * e).cast("double")),
    )
    return kept.select("vec_id", checked.alias("v")).select("vec_id", "v", norms.alias("norms"))


def start(table: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors of smallest hashes, in their order: ``clusters`` rows at most."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.select(key.alias("k"), "v").orderBy(F.col("k").asc_nulls_last(), "v").limit(clusters)
    return [list(r["v"]) for r in first.collect()]


def compress(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment norms and squared norms."""
    step = -(-centroids.shape[1] // SEGMENTS)
    squares = centroids.astype(np.float64) ** 2
    parts = np.add.reduceat(squares, np.arange(0, centroids.shape[1], step), axis=1)
    return np.sqrt(parts), squares.sum(axis=1)


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many
    exact distances that took."""
    c_norms, c_squares = compress(centroids)
    squares = (norms**2).sum(axis=1)
    both = squares[:, None] + c_squares[None, :]
    bound = both - 2 * (norms @ c_norms.T) - SLACK * both - 1
    best = bound.argmin(axis=1)
    gap = v - centroids[best]
    least = np.einsum("ij,ij->i", gap, gap)
    exact = len(v)
    guess = best.copy()
    for j, c in enumerate(centroids):
        rows = np.flatnonzero((bound[:, j] <= least) & (guess != j))
        gap = v[rows] - c
        d = np.einsum("ij,ij->i", gap, gap)
        better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
        best[rows[better]], least[rows[better]] = j, d[better]
        exact += len(rows)
    return best, least, exact


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """Of each batch a row a centroid: its vectors and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, norms = _matrix(b.column("v"), centroids.shape[1]), _matrix(b.column("norms"), len(b.column("norms")[0]))
            best, _, exact = nearest(v, norms, centroids)
            order = np.argsort(best, kind="stable")
            found, begins = np.unique(best[order], return_index=True)
            sums = np.add.reduceat(v[order], begins, axis=0)
            counts = np.diff(np.append(begins, len(order)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(counts, pa.int64()), pa.array([exact] + [0] * (len(found) - 1), pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))],
                ["cluster", "n", "exact", "sums"],
            )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            best, least, _ = nearest(_matrix(b.column("v"), centroids.shape[1]), _matrix(b.column("norms"), len(b.column("norms")[0])), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def lloyd(table: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> tuple[list[list[int]], list[int]]:
    """Centroids after the rounds, and the exact distances each round took."""
    centroids, took = [list(c) for c in centroids], []
    for _ in range(rounds if centroids else 0):
        partial = table.select("v", "norms").mapInArrow(_sums(np.array(centroids, np.int64)), "cluster int, n long, exact long, sums array<long>")
        # a row a centroid and component, whatever the number of vectors
        wide = F.posexplode(F.concat(F.array("exact", "n"), F.col("sums"))).alias("at", "x")
        total = partial.select("cluster", wide).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        sums = {(r["cluster"], r["at"]): int(r["x"]) for r in total}
        took.append(sum(x for (_, at), x in sums.items() if at == 0))
        for j, c in enumerate(centroids):
            if (j, 1) in sums:
                centroids[j] = [sums[j, i + 2] // sums[j, 1] for i in range(len(c))]
    return centroids, took


def _lookup(key: Column, values: dict, kind: str) -> Column:
    """The value of a cluster's number; as many entries as centroids."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key].cast(kind)


def cluster(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``."""
    spark = vectors.sparkSession
    tune(spark)
    table = materialise(quantised(vectors, dims, scale), "vectors")
    centroids, _ = lloyd(table, start(table, clusters, seed), rounds)
    schema = f"vec_id {dict(table.dtypes)['vec_id']}, cluster int, distance long"
    if not centroids:
        none = spark.createDataFrame([], schema)
        return none.selectExpr("*", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    rows = materialise(table.mapInArrow(_assigned(np.array(centroids, np.int64)), schema), "assigned")
    spread = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids)}
    return rows.select(
        "vec_id", "cluster", "distance",
        _lookup(F.col("cluster"), spread, "long").alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        _lookup(F.col("cluster"), digest, "string").alias("centroid_sha256"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Lloyd rounds as a chain of common table expressions over all centroids."""
    apart = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, 65)])"
    parts = [
        f"""WITH kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
    FROM embeddings WHERE len(embedding) = {DIMS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {DIMS}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
    FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CLUSTERS})
)"""
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d
    FROM (SELECT r, vec_id, v, j, {apart} AS d FROM kept CROSS JOIN c{k}) GROUP BY r
)""")
        if k < ROUNDS:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT o.j, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
        SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
            SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) AS t(i) GROUP BY j, i
        ) GROUP BY j
    ) n USING (j)
)""")
    parts = [", ".join(parts)]
    parts.append(f"""SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} USING (j)""")
    return "\n".join(parts)


ORACLE = _oracle()
