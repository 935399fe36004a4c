"""Taint by states: which sinks a source reaches with and without a sanitiser between.

A state is a node with a flag that tells whether a sanitiser lies on the way.  There are at
most two states a source and node, however many walks lead there.  States are numbered in the
order of their nodes' names, and the sources that reach a state are bits of masks, as in
``propagate``: a level is a row a state and block of sources, a step merges rows by bitwise
or, and the last step goes to sinks alone.  Of states before one the first is taken, for all
sources of a block at once.  Only what lies on the path of a hit becomes a row a source.

A part of the graph that a task holds (see ``parts``) needs no such rounds: each source is
searched there by itself, and only flows leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.sources.session import ship, stored

from . import graph, parts, propagate
from .propagate import WORDS

#: Sources of a slice of a part, rows of a batch of flows, and edges under which rounds serve.
SOURCES, ROWS, LEAST = 256, 20_000, 5_000

MASKS = [f"m{i}" for i in range(WORDS)]
#: The masks of a second table beside them.
OTHERS = [f"k{i}" for i in range(WORDS)]


def _none() -> Column:
    return F.lit(0).cast("long")


def _named(node: str, words: tuple[str, ...]) -> Column:
    return text.has_any(F.split_part(F.col(node), F.lit("::"), F.lit(-1)), words)


def _less(some: str, others: str) -> Column:
    return F.col(some).bitwiseAND(F.bitwise_not(others))


def _marked(rows: DataFrame) -> DataFrame:
    """Written, with ``some``: whether any bit is set.  Spark infers a condition over each
    choice of the 16 columns and what they were computed from, so it is not a filter here."""
    return stored(rows.withColumn("some", reduce(Column.bitwiseOR, [F.col(m) for m in MASKS]) != 0))


def _names(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, id)``; numbers rise with the names."""
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(seeds.select("node")).distinct()
    return stored(ends.repartitionByRange("node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("id")))


def _steps(pairs: DataFrame, names: DataFrame, cleans: tuple[str, ...]) -> DataFrame:
    """``(s, t)``: the states after each; a state is twice its node's number, and one more where clean."""
    a = names.select(F.col("node").alias("src"), (F.col("id") * 2).alias("a"))
    b = names.select(F.col("node").alias("dst"), (F.col("id") * 2).alias("b"), _named("node", cleans).cast("int").alias("cleans"))
    ends = pairs.join(a, "src").join(b, "dst")
    dirty = F.struct(F.col("a").alias("s"), (F.col("b") + F.col("cleans")).alias("t"))
    clean = F.struct((F.col("a") + 1).alias("s"), (F.col("b") + 1).alias("t"))
    return stored(ends.select(F.inline(F.array(dirty, clean))))


def _start(pairs: DataFrame, seeds: DataFrame, names: DataFrame, cleans: tuple[str, ...]) -> DataFrame:
    """``(s, block, masks)`` of the sources' own states."""
    at = propagate.numbered(seeds.select("node", F.col("node").alias("mark")), propagate.labels(pairs)).withColumnRenamed("mark", "node")
    state = F.col("id") * 2 + _named("node", cleans).cast("int")
    bit = lambda i: F.when(F.floor(F.col("at") / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)).otherwise(_none()).alias(MASKS[i])
    return stored(_merged(at.join(names, "node").select(state.alias("s"), "block", *[bit(i) for i in range(WORDS)])))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s", "block").agg(*[F.bit_or(m).alias(m) for m in MASKS])


def _search(steps: DataFrame, start: DataFrame, depth: int, ends: DataFrame | None = None) -> list[DataFrame]:
    """A table ``(s, block, masks)`` for each number of steps: the sources that need so many
    to a state.  With ``ends`` (column ``s``) the last step goes only there."""
    found, seen = [start], start
    for step in range(1, depth + 1):
        ways = steps
        if step == depth and ends is not None:
            ways, seen = steps.join(ends.withColumnRenamed("s", "t"), "t", "left_semi"), seen.join(ends, "s", "left_semi")
        # masks of few bits are far smaller as files than in memory, so they are not for broadcasts
        new = ways.join(found[-1].hint("merge"), "s").select(F.col("t").alias("s"), "block", *MASKS, *[_none().alias(k) for k in OTHERS])
        old = seen.select("s", "block", *[_none().alias(m) for m in MASKS], *[F.col(m).alias(k) for m, k in zip(MASKS, OTHERS, strict=True)])
        both = new.union(old).groupBy("s", "block").agg(*[F.bit_or(c).alias(c) for c in MASKS + OTHERS])
        both = _marked(both.select("s", "block", *[_less(m, k).alias(m) for m, k in zip(MASKS, OTHERS, strict=True)], *OTHERS))
        level = both.filter("some").select("s", "block", *MASKS)
        if level.isEmpty():
            break
        found.append(level)
        seen = both.select("s", "block", *[F.col(m).bitwiseOR(F.col(k)).alias(m) for m, k in zip(MASKS, OTHERS, strict=True)])
    return found


def _parents(steps: DataFrame, before: DataFrame, need: DataFrame) -> DataFrame:
    """``(s, t, block, masks)``: for which sources of ``need`` a state comes from ``s``, the
    first of the level before that leads there."""
    ways = steps.join(need.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
    asked = need.select(F.col("s").alias("t"), "block", *[F.col(m).alias(k) for m, k in zip(MASKS, OTHERS, strict=True)])
    rows = ways.join(before.hint("merge"), "s").join(asked.hint("merge"), ["t", "block"])
    rows = rows.select("s", "t", "block", *[F.col(m).bitwiseAND(F.col(k)).alias(m) for m, k in zip(MASKS, OTHERS, strict=True)])
    earlier = Window.partitionBy("t", "block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.bit_or(m).over(earlier), _none()).alias(k) for m, k in zip(MASKS, OTHERS, strict=True)])
    return _marked(rows.select("s", "t", "block", *[_less(m, k).alias(m) for m, k in zip(MASKS, OTHERS, strict=True)])).filter("some").drop("some")


def _each(rows: DataFrame) -> DataFrame:
    """A row a bit of the masks, with the number ``n`` of its source."""
    kept = [c for c in rows.columns if c not in MASKS and c != "block"]
    words = F.array(*[F.struct(F.lit(64 * i).alias("from"), F.col(m).alias("word")) for i, m in enumerate(MASKS)])
    some = rows.select(*kept, "block", F.explode(F.filter(words, lambda w: w["word"] != 0)).alias("w"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("w.word"), i) == 1)
    return some.select(*kept, (F.col("block") * (64 * WORDS) + F.col("w.from")).alias("n"), F.explode(bits).alias("bit")).select(*kept, (F.col("n") + F.col("bit")).alias("n"))


def levels(pairs: DataFrame, seeds: DataFrame, cleans: tuple[str, ...], depth: int) -> DataFrame:
    """``(seed, node, clean, depth)``: every state reached in at most ``depth`` steps, with
    the fewest."""
    pairs, seeds = stored(pairs.select("src", "dst").distinct()), seeds.select("node").distinct()
    names = _names(pairs, seeds)
    start = _start(pairs, seeds, names, cleans)
    found = _search(_steps(pairs, names, cleans), start, depth)
    out = reduce(DataFrame.union, [_each(level).withColumn("depth", F.lit(step)) for step, level in enumerate(found)])
    name = lambda as_: names.select(F.col("id"), F.col("node").alias(as_))
    source = _each(start).withColumn("id", F.floor(F.col("s") / 2)).join(name("seed"), "id").select("n", "seed")
    return out.withColumn("id", F.expr("s div 2")).join(name("node"), "id").join(source, "n").select("seed", "node", (F.col("s") % 2 == 1).alias("clean"), "depth")


def flows(edges: DataFrame, seeds: DataFrame, sinks: tuple[str, ...] = text.SINKS, cleans: tuple[str, ...] = text.SANITISERS, depth: int = 8) -> DataFrame:
    """``(source, sink, tainted, depth, path)``: of each source and sink the shortest
    way without a sanitiser, and the shortest with one (``tainted`` false); of these ways
    the one whose states, from the sink back, are first."""
    pairs, seeds = stored(graph.arcs(edges, ["calls"])), seeds.select("node").distinct()
    names = _names(pairs, seeds)
    if pairs.count() < LEAST:
        return _by_rounds(pairs, seeds, names, sinks, cleans, depth)
    a, b = (names.select(F.col("node").alias(end), F.col("id").alias(x)) for end, x in (("src", "a"), ("dst", "b")))
    small, nodes, rest = parts.split(stored(pairs.join(a, "src").join(b, "dst").select("a", "b")))
    found = _by_parts(small, nodes, seeds, names, sinks, cleans, depth)
    if rest is None:
        return found
    left = stored(rest.join(a, "a").join(b, "b").select("src", "dst"))
    own = seeds.join(left.select(F.col("src").alias("node")), "node", "left_semi")
    return found.union(_by_rounds(left, own, _names(left, own), sinks, cleans, depth))


def _by_parts(small: DataFrame, nodes: DataFrame, seeds: DataFrame, names: DataFrame, sinks: tuple[str, ...], cleans: tuple[str, ...], depth: int) -> DataFrame:
    """``flows`` of the parts that a task holds, a slice of their sources at a time."""
    held = names.join(nodes.withColumnRenamed("key", "id"), "id")
    sources = held.join(seeds, "node", "left_semi").select("part", F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    each, sources = parts.sliced(small, sources, SOURCES)
    at = each.select("part", "slice").distinct()
    is_ = lambda words, n: F.when(_named("node", words), n).otherwise(0)
    flags = (is_(cleans, 1) + is_(sinks, 2)).cast("long")
    known = held.join(at, "part").select("part", "slice", flags.alias("a"), F.col("id").alias("b"), F.col("node").alias("name"), F.lit(0).alias("kind"))
    of = lambda rows, kind: rows.select("part", "slice", "a", "b", F.lit(None).cast("string").alias("name"), F.lit(kind).alias("kind"))
    ship(small.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walked(pa.Table.from_batches(list(batches)), depth)

    rows = known.union(of(each, 1)).union(of(sources, 2))
    return rows.groupBy("part", "slice").applyInArrow(search, "source string, sink string, tainted boolean, depth int, path array<string>")


def _ahead(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each node's edges begin, how many there are, and their ends."""
    order, many = np.lexsort((dst, src)), np.bincount(src, minlength=n)
    return np.cumsum(many) - many, many, dst[order]


def _walked(rows: pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    """Flows of the sources of a slice, each by a search level by level.  Nodes are numbered in the order of
    their names, so the first state before another is that of the least number."""
    kind, a, b = (rows[c].to_numpy() for c in ("kind", "a", "b"))
    known = np.flatnonzero(kind == 0)
    known = known[np.argsort(b[known])]
    names, ids = rows["name"].combine_chunks().take(pa.array(known)), b[known]
    cleans, sinks = (a[known] & 1).astype(np.int64), (a[known] & 2) > 0
    n, edge = len(ids), kind == 1
    src, dst = np.searchsorted(ids, a[edge]), np.searchsorted(ids, b[edge])
    every, last = _ahead(src, dst, n), _ahead(src[sinks[dst]], dst[sinks[dst]], n)
    level, before = np.empty(2 * n, dtype=np.int32), np.empty(2 * n, dtype=np.int64)
    held: list[tuple[int, np.ndarray]] = []
    for source in np.searchsorted(ids, b[kind == 2]):
        level.fill(-1)
        front = np.array([2 * source + cleans[source]])
        level[front] = 0
        for step in range(1, depth + 1):
            starts, many, ends = last if step == depth else every
            ways = many[front >> 1]
            states = np.repeat(front, ways)
            to = ends[np.repeat(starts[front >> 1] - np.cumsum(ways) + ways, ways) + np.arange(len(states))]
            to = 2 * to + (cleans[to] | states & 1)
            new = level[to] < 0
            to, states = to[new], states[new]
            before[to[::-1]] = states[::-1]  # the first state before it is the last that is written
            level[to] = step
            front = np.flatnonzero(level == step)
            if not len(front):
                break
            path = [front[sinks[front >> 1]]]
            for _ in range(step):
                path.insert(0, before[path[0]])
            if len(path[0]):
                held.append((step, np.stack(path, axis=1)))
        if sum(len(p) for _, p in held) >= ROWS:
            yield _flows(held, names)
            held = []
    if held:
        yield _flows(held, names)


def _flows(held: list[tuple[int, np.ndarray]], names: pa.Array) -> pa.RecordBatch:
    steps = np.concatenate([np.full(len(p), step, dtype=np.int32) for step, p in held])
    first, last = (np.concatenate([p[:, i] for _, p in held]) for i in (0, -1))
    nodes = names.take(pa.array(np.concatenate([p.ravel() for _, p in held]) >> 1))
    paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(steps + 1)]).astype(np.int32)), nodes)
    return pa.RecordBatch.from_arrays([names.take(pa.array(first >> 1)), names.take(pa.array(last >> 1)), pa.array(last % 2 == 0), pa.array(steps), paths], names=["source", "sink", "tainted", "depth", "path"])


def _by_rounds(pairs: DataFrame, seeds: DataFrame, names: DataFrame, sinks: tuple[str, ...], cleans: tuple[str, ...], depth: int) -> DataFrame:
    """``flows`` of a whole graph, a table a step."""
    steps = _steps(pairs, names, cleans)
    ends = stored(names.filter(_named("node", sinks)).select(F.inline(F.array(F.struct((F.col("id") * 2).alias("s")), F.struct((F.col("id") * 2 + 1).alias("s"))))))
    found = _search(steps, _start(pairs, seeds, names, cleans), depth, ends)
    # back from the hits: which states, for which sources, lie on their paths
    ways: list[DataFrame] = []
    need = None
    for step in range(len(found) - 1, 0, -1):
        hits = found[step].join(ends, "s", "left_semi")
        need = stored(hits if need is None else _merged(hits.union(need)))
        ways.insert(0, _parents(steps, found[step - 1], need))
        need = ways[0].select("s", "block", *MASKS)
    # and on from the sources, a row a state of such a path
    state = names.select("node", F.inline(F.array(F.struct((F.col("id") * 2).alias("t")), F.struct((F.col("id") * 2 + 1).alias("t")))))
    begun = found[0] if need is None else _merged(need)
    rows = _each(begun.join(state.withColumnRenamed("t", "s"), "s")).select("n", "s", F.array("node").alias("path"))
    out = [rows.limit(0).withColumn("depth", F.lit(0))]
    for step, way in enumerate(ways, 1):
        known = way.join(state, "t").join(ends.select(F.col("s").alias("t"), F.lit(True).alias("hit")), "t", "left")
        rows = stored(_each(known).join(rows, ["n", "s"]).select("n", F.col("t").alias("s"), F.concat("path", F.array("node")).alias("path"), "hit"))
        out.append(rows.filter("hit").select("n", "s", "path", F.lit(step).alias("depth")))
        rows = rows.drop("hit")
    return reduce(DataFrame.union, out).select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("sink"), (F.col("s") % 2 == 0).alias("tainted"), "depth", "path")
