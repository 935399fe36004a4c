"""Closed cycles of a directed graph: one for every edge off a search tree.

In each strong component two breadth-first trees start from its smallest node: one
along the edges, one against them.  An edge (u, v) off the first tree closes a cycle:
from v down the second tree to the root, from there along the first to u, and back to
v, cut short where that way meets a node again.  There are fewer cycles than edges,
and every edge of a component lies on one that closes or carries it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.sources.session import cut, few_broadcasts

from . import graph


def cut_short(walk: Column) -> Column:
    """The walk without the rounds between two visits of a node."""
    step = lambda a, x: F.when(F.array_contains(a, x), F.slice(a, F.lit(1), F.array_position(a, x).cast("int"))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(walk, F.array().cast("array<string>"), step)


def turned(cycle: Column) -> Column:
    """The cycle from its smallest node, which also ends it."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle) - at + 1), F.slice(cycle, F.lit(1), at - 1), F.array(F.array_min(cycle)))


@few_broadcasts
def trees(within: DataFrame) -> DataFrame:
    """``(component, against, node, path)``: paths from the root, in the tree along
    the edges, and in the one against them (read from the root, too); the node before
    is the smallest of those one step nearer."""
    both = within.select("component", F.lit(False).alias("against"), F.col("src").alias("node"), "dst")
    both = cut(both.union(within.select("component", F.lit(True), F.col("dst"), F.col("src"))))
    front = both.select("component", "against").distinct().select("*", F.col("component").alias("node"), F.array("component").alias("path"))
    found = [cut(front)]
    while True:
        best = F.min(F.struct(F.col("node"), F.col("path")))["path"]
        new = found[-1].join(both, ["component", "against", "node"]).groupBy("component", "against", F.col("dst").alias("node")).agg(best.alias("path"))
        new = new.select("component", "against", "node", F.concat("path", F.array("node")).alias("path"))
        for level in found:
            new = new.join(level.select("component", "against", "node"), ["component", "against", "node"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        found.append(new)
        if len(found) == graph.MERGE:  # few tables to compare with; the last one is the front
            found = [cut(graph._all(found[:-1])), found[-1]]
    return graph._all(found)


@few_broadcasts
def cycle_basis(pairs: DataFrame) -> DataFrame:
    """``(component, cycle)``: simple cycles, once each, from the smallest node, which
    is repeated at the end; a loop of one node is ``[a, a]`` in its own component or
    that of its node."""
    pairs = cut(pairs.select("src", "dst").filter("src is not null and dst is not null").distinct())
    members = cut(graph.strong_components(pairs))
    of = lambda end, name: members.select(F.col("node").alias(end), F.col("component").alias(name))
    loops = pairs.filter("src = dst").join(of("src", "component"), "src", "left").select(F.coalesce("component", "src").alias("component"), F.array("src", "dst").alias("cycle"))
    within = cut(pairs.filter("src <> dst").join(of("src", "component"), "src").join(of("dst", "other"), "dst").filter("component = other").select("component", "src", "dst"))
    if within.isEmpty():
        return loops
    paths = cut(trees(within))
    along = paths.filter("not against").select("component", F.col("node").alias("src"), F.col("path").alias("there"))
    on_tree = paths.filter("not against and size(path) > 1").select("component", F.element_at("path", -2).alias("src"), F.col("node").alias("dst"))
    home = paths.filter("against").select("component", F.col("node").alias("dst"), F.reverse("path").alias("back"))
    off = within.join(on_tree, ["component", "src", "dst"], "left_anti").join(along, ["component", "src"]).join(home, ["component", "dst"])
    walk = cut_short(F.concat("back", F.slice("there", 2, F.size("there"))))
    return off.select("component", turned(walk).alias("cycle")).distinct().union(loops)
