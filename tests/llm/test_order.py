from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from symloom.llm import order


@pytest.mark.parametrize("n", [0, 1, 2, 37, 400])
def test_every_row_meets_the_next_one(spark, n):
    rows = [((i * 37) % max(1, n - 3) - 5, f"t{i}") for i in range(n)] + ([(None, "z"), (None, "a")] if n > 2 else [])
    out = order.with_successors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    parts = out.withColumn("at", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).orderBy("place").collect()
    got, last = [], None
    for r in parts:
        key = (r.doc_id, r.text)
        if last and last[1] == (r["at"], r.part):
            got.append((last[0], key))
        last = None if r.tail else (key, (r["at"], r.part))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(got, key=str) == sorted(((want[i], want[(i + 1) % len(want)]) for i in range(len(want))), key=str)


def test_parts_by_bounds(spark):
    bounds = [-(1 << 63), -4, 0, 3, 9, 12, 40]
    df = spark.createDataFrame([(k,) for k in range(-10, 60)], "k long")
    for r in df.select("k", order._part(F.col("k"), bounds).alias("p")).collect():
        assert r.p == sum(b <= r.k for b in bounds) - 1
