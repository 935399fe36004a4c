"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, its expected number of copies.  Of all rates between 0
and ``cap`` that give each source its target of words, those of least relative
entropy to one copy a document are

    rate = min(cap, exp(lambda_source * size / mean size of the source)),

where the multipliers solve the convex dual problem, one for each source.  Newton
steps, all sources at once, solve it: a step is one aggregation over the table of
``(source, size, documents)``, since documents of one source and size have one
rate.  A bracket guards each step, because the second derivative jumps where rates
reach the cap and vanishes where all have.

Rates become copies in three steps.  Along each source's sizes the copies of a
``(source, size)`` group follow the running sum of rates, so all groups together
are less than one of the longest documents off.  At most one group for each power of
two then takes copies more or less, longest first, until what is left is about half
of the shortest document among them.  Within a group, the documents of smallest
hashes get one copy more.

All sums are of integers or decimals (rates are fixed-point numbers), so neither
the order of rows nor their partitions change a result: reruns agree.  Only
DataFrame functions are used.  The hash cells of a group (a square root of all
documents) are ranked apart, so a group that holds a third of all rows is no single
task.  The driver sees single numbers and one row a partition of the sources.

Defined results: a null text has size 0, and a document of size 0 takes 0 words.
Null sources are one source, the last one.  Null ids and repeated rows are documents
of their own (equal rows share a hash cell).  A source without words has target 0,
as have all if there are no words.  An empty table gives no rows.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, materialise, tune, width

#: Parameters of the registered query: weights by the rank of a source, the share of
#: all words that the mix holds, and the most copies of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: A rate of one, as a fixed-point number.
ONE = 1 << 32
#: Newton steps end when every source is this near its target, or after so many.
NEAR, STEPS = 1e-9, 60
_WS = " \t\n\x0b\x0c\r"
_WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Runs of characters other than a space and U+0009 to U+000D; null: 0."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(marks, _WS, "")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source_key, size, h)``: keys sort by code point, the null one last."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    return docs.select("doc_id", key.alias("source_key"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source_key, source_size, documents, target)`` from ``(source_key, size, n)``.

    Targets are ``min(cap * source_size, level * weight)`` with one level that makes
    them sum up to the share; it rises as sources reach their bounds."""
    total = groups.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    parts = materialise(total.repartitionByRange(width(groups.sparkSession), "source_key").withColumn("part", F.spark_partition_id()), "sources")
    before, begins = 0, []
    for r in parts.groupBy("part").count().orderBy("part").collect():
        begins += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    if not begins:
        return parts.select("source_key", "source_size", "documents", F.lit(0.0).alias("target"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1 + F.create_map(*begins)[F.col("part")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sources = materialise(parts.withColumn("weight", weight), "sources")
    bound = F.lit(cap) * F.col("source_size")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    full, open_weight = 0, None
    while True:
        if open_weight is None:
            capped = F.lit(False)
        else:
            # at the bound if the level so far lifts the source to it or above
            capped = (share * words - full) * F.col("weight") >= bound.cast("double") * open_weight
        r = sources.agg(
            F.sum(F.when(capped, bound).otherwise(0)).alias("full"), F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("open")
        ).first()
        if (r["full"], r["open"]) == (full, open_weight) or not r["open"]:
            break
        full, open_weight = r["full"], r["open"]
    level = (share * words - full) * F.col("weight") / open_weight
    return sources.select("source_key", "source_size", "documents", F.least(bound.cast("double"), level).alias("target"))


def _rate(z: Column, multiplier: Column, cap: int) -> Column:
    """The fixed-point rate; exponents beyond the cap's are not raised."""
    return F.round(F.least(F.lit(float(cap)), F.exp(F.least(multiplier * z, F.lit(math.log(cap) + 1)))) * ONE).cast(_WHOLE)


def balance(groups: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source_key, multiplier, full)`` by Newton steps on the dual.

    ``full`` sources take every document ``cap`` times.  A source's words rise with
    its multiplier, so a multiplier below the target's is a lower end of the
    bracket, one above it an upper end."""
    mean = F.col("source_size") / F.col("documents")
    state = sources.filter("source_size > 0").select(
        "source_key", "target", mean.alias("mean"), (F.col("target") >= cap * F.col("source_size")).alias("full"), F.lit(0.0).alias("multiplier"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("near"),
    )
    state = materialise(state, "multipliers")
    words = F.col("n") * F.col("size")
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        rate = _rate(z, F.col("multiplier"), cap)
        spread = groups.filter("size > 0").join(state.filter("not full and not near"), "source_key").groupBy("source_key").agg(
            F.sum(words.cast("decimal(20,0)") * rate).cast("double").alias("got"),
            # the derivative of a group's words, in whole units; none at the cap
            F.sum(F.when(rate < cap * ONE, (words.cast("decimal(20,0)") * rate * F.col("size").cast("decimal(12,0)")).cast(_WHOLE)).otherwise(0)).cast("double").alias("slope"),
        )
        gap = F.col("got") / ONE - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - F.try_divide(gap * F.col("mean") * ONE, F.col("slope"))
        # outside the bracket, or without slope: its middle, or a doubled step
        outside = step.isNull() | F.isnan(step) | (step <= low) | (step >= high)
        wide = F.greatest(F.lit(1.0), F.abs(F.col("multiplier")))
        middle = F.when(low.isNull(), F.col("multiplier") - wide).when(high.isNull(), F.col("multiplier") + wide).otherwise((low + high) / 2)
        near = F.abs(gap) <= NEAR * F.col("target")
        done = F.col("got").isNull() | near
        moved = state.join(spread, "source_key", "left").select(
            "source_key", "target", "mean", "full",
            F.when(done, F.col("multiplier")).when(F.coalesce(outside, F.lit(False)) | (F.col("slope") == 0), middle).otherwise(step).alias("multiplier"),
            F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"),
            (F.col("near") | F.coalesce(near, F.lit(False))).alias("near"),
        )
        state = materialise(moved, "multipliers")
        if not state.filter("not full and not near").limit(1).count():
            break
    return state.select("source_key", "mean", "multiplier", "full")


def group_copies(groups: DataFrame, sources: DataFrame, multipliers: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source_key, size, n, rate, copies)``: copies of all documents of a group."""
    rate = F.when(F.col("full"), F.lit(cap * ONE).cast(_WHOLE)).otherwise(
        F.coalesce(_rate(F.col("size") / F.col("mean"), F.col("multiplier"), cap), F.lit(ONE).cast(_WHOLE))
    )
    rated = groups.join(multipliers, "source_key", "left").select("source_key", "size", "n", rate.alias("rate"))
    ordered = Window.partitionBy("source_key").orderBy("size")
    upto = F.sum(F.col("n").cast("decimal(18,0)") * F.col("rate").cast("decimal(12,0)")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(37,0)")
    follow = rated.withColumn("upto", upto + F.lit(ONE // 2)).withColumn("upto", F.expr(f"upto div {ONE}"))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(ordered), F.lit(0).cast("long"))
    rounded = materialise(follow.select("source_key", "size", "n", "rate", copies.alias("copies")), "copies")

    # what is left of each target goes to one group a power of two, the longest first
    level = F.floor(F.log2("size")).cast("int")
    roomy = F.max_by(F.struct("size", "n", "copies"), F.struct("n", -F.col("size"))).alias("g")
    chosen = rounded.filter("size > 0").groupBy("source_key", level.alias("level")).agg(roomy).groupBy("source_key").agg(F.sort_array(F.collect_list("g"), False).alias("gs"))
    left = rounded.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).join(sources, "source_key")
    left = left.select("source_key", F.round(F.col("target") - F.col("words")).cast("long").alias("left"))

    def add(state: Column, g: Column) -> Column:
        want = F.round(state["left"] / g["size"]).cast("long")
        more = F.greatest(-g["copies"], F.least(want, cap * g["n"] - g["copies"]))
        return F.struct((state["left"] - more * g["size"]).alias("left"), F.concat(state["out"], F.array(F.struct(g["size"].alias("size"), more.alias("more")))).alias("out"))

    begin = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))
    more = chosen.join(left, "source_key").select("source_key", F.explode(F.aggregate("gs", begin, add)["out"]).alias("m")).select("source_key", "m.size", "m.more")
    return rounded.join(more.filter("more <> 0"), ["source_key", "size"], "left").select(
        "source_key", "size", "n", (F.col("rate").cast("double") / ONE).alias("rate"), (F.col("copies") + F.coalesce("more", F.lit(0).cast("long"))).alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, rate, copies)``, a row a document."""
    tune(docs.sparkSession)
    rows = materialise(sized(docs), "sizes")
    groups = materialise(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "groups")
    sources = materialise(targets(groups, weights, share, cap), "targets")
    plan = materialise(group_copies(groups, sources, balance(groups, sources, cap), cap).join(sources.drop("documents"), "source_key"), "plan")
    cells = max(1, math.isqrt(rows.count()))
    in_cells = rows.select("doc_id", "source_key", "size", "h", F.pmod("h", F.lit(cells)).alias("cell"))
    group, cell = ["source_key", "size"], ["source_key", "size", "cell"]
    counts = in_cells.groupBy(cell).agg(F.count(F.lit(1)).alias("here"))
    earlier = F.sum("here").over(Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    offsets = counts.select(*cell, earlier.alias("earlier")).join(plan, group)
    ranked = in_cells.withColumn("rank", F.row_number().over(Window.partitionBy(cell).orderBy("h", "doc_id")))
    copies = F.expr("copies div n") + F.when(F.col("earlier") + F.col("rank") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    return ranked.join(offsets, cell).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "rate", copies.cast("long").alias("copies")
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))
