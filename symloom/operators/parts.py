"""Parts of a graph that no edge joins.

What a node reaches lies in its own part.  A part of bounded size is the work of a task
there, in arrays, so no step's rows are shuffled; larger ones are left to the rounds of
``propagate`` and ``taint``.

Parts are found by contraction: every node takes the least of itself and its neighbours,
and the labels' edges are the next round's, first over three edges a node, then over what
these leave apart.  Where ``ROUNDS`` are not enough, the labels that still touch are
left to the rounds too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.session import stored

#: Edges of a part that a task holds, and of the parts that become one group together.
ARCS, FEW = 2_000_000, 100_000
#: Contractions, each of which leaves a part of the labels.
ROUNDS = 12


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, label)`` of all ends of ``(a, b)``, and the edges left between labels."""
    held = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select("b", "a"))
        near = stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b")).select("key", F.least("key", "b").alias("label")))
        up = near.select(F.col("key").alias("label"), F.col("label").alias("up"))
        held = near if held is None else stored(held.join(up, "label", "left").select("key", F.coalesce("up", "label").alias("label")))
        x, y = (near.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        edges = stored(edges.join(x, "a").join(y, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if edges.isEmpty():
            break
    return held, edges


def split(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of a table ``(a long, b long)``: ``(a, b, part)`` of the parts of at most ``ARCS`` edges,
    ``(key, part)`` of their nodes, and the edges ``(a, b)`` of the others, None if there are none.

    No edge joins two parts; small ones have a number together."""
    out = arcs.groupBy("a").agg(F.array(F.min("b"), F.max("b")).alias("b")).select("a", F.explode("b").alias("b"))
    some = out.union(arcs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    held, _ = _contracted(stored(some))
    x, y = (held.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    known = stored(arcs.join(x, "a").join(y, "b").select("a", "b", F.col("la").alias("label"), F.col("lb").alias("other")))
    apart = stored(known.filter("label <> other").select(F.col("label").alias("a"), F.col("other").alias("b")).distinct())
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    final = held.select("label").distinct().withColumn("part", F.col("label"))
    open_ = final.select("part").limit(0)
    if not apart.isEmpty():
        more, left = _contracted(apart)
        final = final.drop("part").join(more.select(F.col("key").alias("label"), F.col("label").alias("part")), "label", "left").select("label", F.coalesce("part", "label").alias("part"))
        open_ = left.select(F.explode(F.array("a", "b")).alias("part")).distinct()
    sizes = stored(final.join(sizes, "label", "left").groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(open_.withColumn("open", F.lit(True)), "part", "left"))
    small = sizes.filter(f"open is null and n <= {ARCS}")
    groups = -(-(small.filter(f"n < {FEW}").agg(F.sum("n")).first()[0] or 0) // FEW)
    number = F.when(F.col("n") < FEW, F.pmod(F.xxhash64("part"), F.lit(max(1, groups)))).otherwise(F.col("part"))
    of = stored(final.join(small.select("part", number.alias("group")), "part").select("label", F.col("group").alias("part")))
    rest = None
    if not sizes.filter(f"open is not null or n > {ARCS}").isEmpty():
        rest = known.join(of.select("label"), "label", "left_anti").select("a", "b")
    return known.join(of, "label").select("a", "b", "part"), held.join(of, "label").select("key", "part"), rest


def sliced(arcs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The edges ``(a, b, part)`` once for each slice of their part's ``items`` ``(part, a, b)``,
    and the items in theirs, by ``b``; a slice has about ``width`` items."""
    n = stored(items.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias("slices")))
    each = arcs.join(n, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "a", "b")
    return each, items.join(n, "part").select("part", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), "a", "b")
