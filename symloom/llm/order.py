"""Each row with the next one in the order of ids, without a global window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import width

_NULL = -(1 << 63)


def _array(bounds: list[int]) -> Column:
    """The bounds as one literal (folded), however many they are."""
    return F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")


def _part(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, less one; two steps
    of a square root of their number each."""
    step = max(1, math.isqrt(len(bounds)))
    at = F.size(F.filter(_array(bounds[::step]), lambda b: b <= key)) - 1
    near = F.slice(_array(bounds), at * step + 1, F.lit(step))
    return at * step + F.size(F.filter(near, lambda b: b <= key)) - 1


def with_successors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt to parts by ranges of ``key``, for a pass in order.

    Adds ``part`` and ``tail``: a part's rows are in one partition, sorted, and
    end with copies (``tail`` true) of the rows of the id that begins the next
    part; the last part ends with those of the very first id.  Bounds come from
    the ids alone; the driver sees one id a part, and the texts move once.
    Rows of one id follow each other in the order of ``text``; null ids come
    first.
    """
    ids = F.coalesce(F.col(key), F.lit(_NULL))
    lows = rows.select(ids.alias("k")).repartitionByRange(width(rows.sparkSession), "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low"))
    bounds = sorted(r["low"] for r in lows.collect()) or [_NULL]
    part = _part(ids, bounds)
    before = F.when(part == 0, F.lit(len(bounds) - 1)).otherwise(part - 1)
    begins = F.element_at(_array(bounds), part + 1) == ids
    own, copy = F.struct(part.alias("part"), F.lit(False).alias("tail")), F.struct(before.alias("part"), F.lit(True).alias("tail"))
    dealt = rows.select(key, text, F.explode(F.when(begins, F.array(own, copy)).otherwise(F.array(own))).alias("_to")).select(key, text, "_to.part", "_to.tail")
    return dealt.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("part", "tail", F.col(key).asc_nulls_first(), text)
