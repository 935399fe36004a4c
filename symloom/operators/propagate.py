"""Flags and counts of what every node reaches, without a table of pairs.

A step pushes masks backwards over the edges: a row a node (flags), or a row a node
and block of marks (counts), merged by bitwise or.  Its cost is the edges times the
width of a mask, however many paths or pairs there are, and partial aggregation
merges the masks of a node before they are shuffled, so a node of many edges is no
single task's row set.  The pairs are read once a step: give a table, or ``cut`` them.

Marks are numbered so that those near each other in the graph share a block: a node then
has rows for the blocks around it, not for nearly all there are.

Within two steps a node reaches few marks of any block, and masks are mostly zeros.  There
a node's marks are a list, and the lists of its neighbours are merged; nodes of very
many neighbours have several lists, and what very many lists reach is dealt by mark.
Where hubs make the lists that meet far more than the edges, masks serve there too.

More steps reach a large share of a part of the graph, and masks of all neighbours would be
shuffled.  A part that a task holds (see ``parts``) is searched there instead, a slice of
its marks at a time; masks serve the parts that are larger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.session import cut, dealt, ship, stored

from . import parts

#: Longs of a block: a row holds the marks of 64 times as many.
WORDS = 16
#: Steps in either direction over which nodes take one label.
ROUNDS = 4
#: Rows of masks a task joins and merges.
TASK = 500_000
#: Marks of a list, walks of two steps that one task merges for a node, walks an edge
#: for which lists are still shorter than masks.
LIST, WALKS, DENSE = 1024, 1_000_000, 256
#: Marks of a slice of a part.
SLICE = 8192


def reach_flags(pairs: DataFrame, own: DataFrame, depth: int) -> list[DataFrame]:
    """``(node, mask)`` for each number of steps from 1 to ``depth``: the or of the
    masks of all nodes within so many steps over ``pairs`` (a node's own only if a
    cycle leads back).  ``own`` is ``(node, mask long)``, once a node; nodes whose
    mask stays 0 have no row."""
    pairs = pairs.select(F.col("src").alias("_src"), F.col("dst").alias("node"))
    own = cut(own.filter("mask <> 0").select("node", F.col("mask").cast("long").alias("mask")))
    levels: list[DataFrame] = []
    for _ in range(depth):
        known = own if not levels else own.union(levels[-1]).groupBy("node").agg(F.bit_or("mask").alias("mask"))
        levels.append(cut(pairs.join(known, "node").groupBy(F.col("_src").alias("node")).agg(F.bit_or("mask").alias("mask"))))
    return levels


def labels(pairs: DataFrame) -> DataFrame:
    """``(key, label)`` by the hash ``key`` of a node: the least hash within ``ROUNDS``
    steps in either direction.  Nodes whose hashes meet only share a label."""
    there = pairs.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))
    both = stored(there.union(there.select("b", "a")))
    held = both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    for _ in range(ROUNDS - 1):
        held = stored(held)
        near = both.join(held.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        held = held.join(near, "key").select("key", F.least("label", "near").alias("label"))
    return stored(held)


def numbered(marks: DataFrame, near: DataFrame) -> DataFrame:
    """Each distinct ``mark`` of ``(node, mark)`` with a ``block`` and a bit ``at`` in it,
    in the order of its nodes' ``labels``."""
    own = marks.select(F.xxhash64("node").alias("key"), "mark").join(near, "key", "left")
    each = own.groupBy("mark").agg(F.coalesce(F.min("label"), F.min("key")).alias("label"))
    # numbers rise within a sorted part; parts begin at multiples of 2 ** 33, so no block lies in two
    at = stored(each.repartitionByRange("label", "mark").sortWithinPartitions("label", "mark").select("mark", F.monotonically_increasing_id().alias("n")))
    width = 64 * WORDS
    return at.select("mark", F.floor(F.col("n") / width).cast("long").alias("block"), (F.col("n") % width).cast("int").alias("at"))


def reach_counts(pairs: DataFrame, marks: DataFrame, depth: int) -> DataFrame:
    """``(node, reached)``: how many distinct marks lie on the nodes within ``depth``
    steps over ``pairs``.

    ``marks`` is ``(node, mark)``, or ``(node)`` alone where each node is its own
    mark.  Blocks of marks that a node does not reach have no row, nor have nodes
    that reach none."""
    if "mark" not in marks.columns:
        marks = marks.withColumn("mark", F.col("node"))
    if depth <= 2:
        found = _by_lists(pairs, marks, depth)
        if found is not None:
            return found
    return _by_parts(pairs, marks, depth)


def _hashed(values: DataFrame, name: str) -> DataFrame | None:
    """``(key, name)`` of the distinct values, the key a hash; None where two values share one."""
    held = stored(values.select(F.xxhash64(name).alias("key"), name).distinct())
    n = held.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    return held if n[0] == n[1] else None


def _by_lists(pairs: DataFrame, marks: DataFrame, depth: int) -> DataFrame | None:
    """``reach_counts`` within two steps; None where hashes do not tell the nodes or marks apart, or
    hubs make too many walks."""
    names = _hashed(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(marks.select("node")), "node")
    if names is None or not marks.filter("node is distinct from mark").isEmpty() and _hashed(marks.select("mark"), "mark") is None:
        return None
    own = marks.select(F.xxhash64("node").alias("node"), F.xxhash64("mark").alias("mark")).distinct()
    arcs = stored(pairs.select(F.xxhash64("src").alias("node"), F.xxhash64("dst").alias("next")))
    each = arcs.join(own.withColumnRenamed("node", "next"), "next").select("node", "mark")
    if depth == 2:
        each = stored(each.union(own))
        sizes = each.groupBy(F.col("node").alias("next")).agg(F.count(F.lit(1)).alias("n"))
        sums = stored(arcs.join(sizes, "next").groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("arcs")))
        n, total, longest = sums.agg(F.sum("arcs"), F.sum("n"), F.max("n")).first()
        if (total or 0) > DENSE * (n or 0):
            return None
        many = stored(sizes.filter(F.col("n") > LIST))
        if many.isEmpty():
            part = F.lit(0)
        else:  # the same mark is in the same list
            each = each.join(many.select(F.col("next").alias("node"), "n"), "node", "left")
            part = F.pmod("mark", F.coalesce(F.ceil(F.col("n") / LIST), F.lit(1)))
        lists = each.groupBy("node", part.alias("part")).agg(F.collect_set("mark").alias("marks"))
        met = arcs.join(lists.select(F.col("node").alias("next"), "marks"), "next").select("node", "marks")
        wide = (longest or 0) > WALKS
        walks = sums.filter(F.col("n") > WALKS).select("node")
        one = met.join(walks, "node", "left_anti") if wide else met
        # a node's lists are shuffled closed; marks are counted where they meet
        counts = one.repartition("node").groupBy("node").agg(F.size(F.array_distinct(F.flatten(F.collect_list("marks")))).cast("long").alias("reached"))
        if wide:
            opened = met.join(walks, "node", "left_semi").select("node", F.explode("marks").alias("mark"))
            counts = counts.union(opened.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("reached")))
        tasks = -(-(n or 0) // TASK)
    else:
        counts, tasks = each.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("reached")), 1
    with dealt(pairs.sparkSession, tasks):
        return stored(counts.join(names.withColumnRenamed("node", "name"), F.col("node") == F.col("key")).select(F.col("name").alias("node"), "reached"))


def _by_parts(pairs: DataFrame, marks: DataFrame, depth: int) -> DataFrame:
    """``reach_counts`` in tasks of a part each; by masks in parts too large, and where hashes do not tell
    the nodes or marks apart."""
    names = _hashed(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(marks.select("node")), "node")
    if names is None or not marks.filter("node is distinct from mark").isEmpty() and _hashed(marks.select("mark"), "mark") is None:
        return _by_masks(pairs, marks, depth)
    own = marks.select(F.xxhash64("node").alias("node"), F.xxhash64("mark").alias("mark")).distinct()
    arcs = stored(pairs.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")))
    small, nodes, rest = parts.split(arcs)
    items = own.join(nodes.withColumnRenamed("key", "node"), "node").select("part", F.col("node").alias("a"), F.col("mark").alias("b"))
    each, items = parts.sliced(small, items, SLICE)
    ship(pairs.sparkSession)
    rows = each.withColumn("own", F.lit(False)).union(items.withColumn("own", F.lit(True)))
    found = rows.groupBy("part", "slice").applyInPandas(lambda rows: _counted(rows, depth), "node long, reached long")
    counts = found.groupBy("node").agg(F.sum("reached").alias("reached"))
    if rest is not None:
        others = own.join(nodes.select(F.col("key").alias("node")), "node", "left_anti")
        counts = counts.union(_by_masks(rest.select(F.col("a").alias("src"), F.col("b").alias("dst")), others, depth))
    return stored(counts.join(names.withColumnRenamed("node", "name"), F.col("node") == F.col("key")).select(F.col("name").alias("node"), "reached"))


def _counted(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    """``(node, reached)`` of a slice of a part's marks, 64 marks at a time."""
    a, b, own = (rows[c].to_numpy() for c in ("a", "b", "own"))
    nodes, at = np.unique(np.concatenate([a, b[~own]]), return_inverse=True)
    src, dst = at[: len(a)][~own], at[len(a) :]
    order = np.argsort(src, kind="stable")
    dst, (heads, starts) = dst[order], np.unique(src[order], return_index=True)
    holders, (marks, mark) = at[: len(a)][own], np.unique(b[own], return_inverse=True)
    order = np.argsort(mark, kind="stable")
    holders, mark = holders[order], mark[order]
    reached = np.zeros(len(nodes), dtype=np.int64)
    for first in range(0, len(marks) if len(dst) else 0, 64):
        some = slice(*np.searchsorted(mark, [first, first + 64]))
        mine = np.zeros(len(nodes), dtype=np.uint64)
        np.bitwise_or.at(mine, holders[some], np.uint64(1) << (mark[some] - first).astype(np.uint64))
        held = mine
        for _ in range(depth):
            step = np.zeros(len(nodes), dtype=np.uint64)
            step[heads] = np.bitwise_or.reduceat(held[dst], starts)
            held = step | mine
        reached += np.bitwise_count(step)
    some = reached > 0
    return pd.DataFrame({"node": nodes[some], "reached": reached[some]})


def _by_masks(pairs: DataFrame, marks: DataFrame, depth: int) -> DataFrame:
    masks = [f"m{i}" for i in range(WORDS)]
    bit = lambda i: F.when(F.floor(F.col("at") / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)).otherwise(F.lit(0).cast("long")).alias(f"m{i}")
    merged = [F.bit_or(m).alias(m) for m in masks]
    own = marks.select("node", "mark").distinct().join(numbered(marks, labels(pairs)), "mark").select("node", "block", *[bit(i) for i in range(WORDS)]).groupBy("node", "block").agg(*merged)
    pairs, own = pairs.select(F.col("src").alias("_src"), F.col("dst").alias("node")), stored(own)
    held, spark, arcs = own, own.sparkSession, pairs.count()
    ones = reduce(lambda a, b: a + b, [F.bit_count(m) for m in masks])
    for i in range(depth):
        size = held.agg(F.count(F.lit(1)), F.approx_count_distinct("node")).first()
        # masks compress so well that a partition of the advised size is many times that in memory: their rows are dealt by number
        with dealt(spark, -(-arcs * size[0] // (max(1, size[1]) * TASK))):
            # masks of few bits are far smaller as files than in memory, so they are not for broadcasts
            step = pairs.join(held.hint("merge"), "node").groupBy(F.col("_src").alias("node"), "block").agg(*merged)
            if i < depth - 1:
                held = stored(step.union(own).groupBy("node", "block").agg(*merged))
            else:  # the last step's masks are only counted
                return stored(step.groupBy("node").agg(F.sum(ones).cast("long").alias("reached")))
    return held.groupBy("node").agg(F.sum(ones).cast("long").alias("reached"))
