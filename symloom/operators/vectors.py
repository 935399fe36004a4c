"""A stored vector index: coarse cells as partitions, probed cells joined.

Cosine is the measure; vectors are stored with length one.  Centres come from
k-means on a bounded sample (``SAMPLE`` rows by a hash of their keys); every row is
indexed, in the cell of its nearest centre.  On the same sample the number of cells
to probe is measured: the least one that finds ``RECALL`` of the true neighbours of
``PROBED`` rows.  Cells are stored in chunks of about ``CHUNK`` rows; chunks are dealt to
parts and queries to blocks, so neither a crowded cell nor many queries are one task.  A
part and a block meet in a group, where a query is compared with the rows of its cells.

Defined results: rows with a null key, and vectors that are null, empty, all zero or
hold a null or non-finite component are left out, of queries too.  Of vectors of unlike
lengths, components that one has not count as 0.  Equal rows are
rows of their own, a query met again counts once; equal cosines are in the order of keys.  An empty table gives an
index without rows, and a search of it none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.sources.session import stored

#: Rows that the centres are learnt from, cells at most, rows a chunk, rows a part, queries
#: a block, and queries that are multiplied at once.
SAMPLE, CELLS, CHUNK, PART, BLOCK, STRIP = 20_000, 4096, 4096, 16384, 2048, 128
#: Share of true neighbours that probing must find on the sample, neighbours and rows
#: that it is measured by.
RECALL, NEIGHBOURS, PROBED = 0.95, 10, 500


def unit(v: Column) -> Column:
    """The vector at length one; null where it has none."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))  # null if a component is
    # as an element: what stands in a lambda as an expression is computed for every component
    return F.transform(F.array(norm), lambda n: F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), F.transform(x, lambda e: e / n)))[0]


def _units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), unit(F.col(vector)).alias("v")).filter("id is not null and v is not null")


def _wide(v: Column, size: int) -> Column:
    """The vector with ``size`` components: zeros after its own, or its first."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def _probes(sample: np.ndarray, centres: np.ndarray) -> int:
    """Cells that find the wanted share of the sample's true neighbours."""
    cell = (sample @ centres.T).argmax(axis=1)
    asked = sample[:PROBED]
    true = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(rank[np.arange(len(asked))[:, None], cell[true]], axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1


def build(rows: DataFrame, path: str, key: str = "id", vector: str = "vector", cells: int | None = None, seed: int = 7) -> None:
    """Write the index: ``cells/cell=C`` and ``centres``."""
    spark = rows.sparkSession
    held = stored(_units(rows, key, vector))
    n, size, least = held.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.size("v"))).first()
    if size != least:
        held = held.withColumn("v", _wide(F.col("v"), size))
    share = min(1.0, SAMPLE / max(1, n))
    sample = held.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE)
    sample = stored(sample.select("v"))  # one file, in this order
    points = np.array([r["v"] for r in sample.select("v").collect()])  # bounded: see SAMPLE
    if not len(points):
        held.withColumn("chunk", F.lit(0)).withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([], "cell int, c array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centres")
        return
    k = min(cells or max(1, min(CELLS, int(n**0.5))), len(points))
    if k == 1:
        centres = points.mean(axis=0, keepdims=True)
    else:
        model = KMeans(k=k, distanceMeasure="cosine", maxIter=10, seed=seed, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
        centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    probes = _probes(points, centres)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, c array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centres")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cell=(np.vstack(f["v"]) @ centres.T).argmax(axis=1).astype("int32") if len(f) else np.array([], "int32"))

    dealt = held.mapInPandas(assign, f"id {dict(held.dtypes)['id']}, v array<double>, cell int")
    # parts of the rows, so that a crowded cell has as many chunks as it needs
    parts = max(1, -(-n // (CHUNK * k)) * 4)
    dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


class Index:
    """An index opened for searching; ``probes`` is the measured number of cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows = spark.read.parquet(f"{path}/cells").withColumn("cell", F.col("cell").cast("int"))
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most CELLS
        self.centres = np.array([r["c"] for r in found])
        self.probes = found[0]["probes"] if found else 0

    def knn(self, queries: DataFrame, k: int, key: str = "q", vector: str = "vector", probes: int | None = None) -> DataFrame:
        """``(q, id, cosine, rank)``: the k nearest rows in each query's probed cells."""
        asked = _units(queries, key, vector).groupBy(F.col("id").alias("q")).agg(F.min("v").alias("qv"))
        kinds = {"q": dict(asked.dtypes)["q"], "id": dict(self.rows.dtypes)["id"]}
        out = f"q {kinds['q']}, id {kinds['id']}, cosine double"
        if not self.probes:
            return self.spark.createDataFrame([], out + ", rank int")
        probes, centres = min(probes or self.probes, len(self.centres)), self.centres
        asked = stored(asked.withColumn("qv", _wide(F.col("qv"), centres.shape[1])))
        parts, blocks = max(1, -(-self.rows.count() // PART)), max(1, -(-asked.count() // BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
        rows = self.rows.withColumn("part", F.pmod(F.xxhash64("cell", "chunk"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

        def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"q": q["q"].iloc[:0], "id": r["id"].iloc[:0], "cosine": []})
            q, r = q.sort_values("q", kind="stable"), r.sort_values("id", kind="stable")
            ids, cell, m, found = r["id"].to_numpy(), r["cell"].to_numpy(), np.vstack(r["v"]).T, []
            for start in range(0, len(q), STRIP):
                some = q.iloc[start : start + STRIP]
                v = np.vstack(some["qv"])
                asks = np.zeros((len(v), len(centres)), dtype=bool)
                np.put_along_axis(asks, np.argpartition(-(v @ centres.T), probes - 1, axis=1)[:, :probes], True, axis=1)
                like = np.rint((v @ m) * 1e9).astype(np.int64)
                # one number orders by the cosine and, in reverse, by the key
                order = np.where(asks[:, cell], like * len(ids) + np.arange(len(ids) - 1, -1, -1), np.iinfo(np.int64).min)
                top = np.argpartition(-(order + 1), k - 1, axis=1)[:, :k] if k < len(ids) else np.tile(np.arange(len(ids)), (len(v), 1))
                at, of = np.repeat(np.arange(len(v)), top.shape[1]), top.ravel()
                hit = asks[at, cell[of]]
                at, of = at[hit], of[hit]
                found.append(pd.DataFrame({"q": some["q"].to_numpy()[at], "id": ids[of], "cosine": like[at, of] / 1e9}))
            return pd.concat(found, ignore_index=True)

        keys = ["part", "block"]
        found = dealt.groupBy(keys).cogroup(rows.groupBy(keys)).applyInPandas(best, out)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)
