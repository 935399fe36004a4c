"""Set-similarity joins: pairs of sets with a Jaccard index of a bound or more.

A set's items are ordered by how rare they are.  Two sets of the wanted likeness
share one of their first ``n - ceil(least * n) + 1`` items, and their sizes differ by
no more than the bound; only such pairs are compared.  So an item that all sets share
stands last in each and brings none together.  Equal sets are joined once, as a class.

Where the items are so few that nearly all pairs share one, this finds nothing to leave
out.  Then functions are compared block by block, by products of 0/1 matrices; the work is
quadratic, but a task holds two blocks, and only pairs near the bound leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.sources.session import cut, ship

from . import graph

#: Rows of a block, rows and items that are multiplied at once.
BLOCK, STRIP, ITEMS = 16384, 128, 1024
#: Pairs of a block that cost as much as one that a join brings together.
CHEAPER = 20


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """``(a, b, jaccard)``, a before b, of ``(id, items)`` or ``(id, within, items)``:
    pairs (of equal ``within``) of a Jaccard index of ``least`` and above 0.  Items are
    distinct strings; ids occur once; empty sets meet none."""
    return _met(sets, _first(sets, least), least)


def _first(sets: DataFrame, least: float) -> DataFrame:
    """``(id, size, item)``, and ``within``: the rarest items, of which alike sets share one."""
    keys = [c for c in ("within",) if c in sets.columns]
    each = sets.select("id", *keys, F.explode("items").alias("item"))
    rare = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(rare, "item").groupBy("id", *keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    size = F.size("items")
    return ordered.select("id", *keys, size.alias("size"), F.explode(F.slice("items", F.lit(1), size - F.ceil(size * least - 1e-9).cast("int") + 1)).alias("item"))


def _met(sets: DataFrame, first: DataFrame, least: float) -> DataFrame:
    keys = [c for c in ("within",) if c in sets.columns]
    other = first.select(*[F.col(c).alias(c) for c in keys], F.col("item").alias("item"), F.col("id").alias("b"), F.col("size").alias("size_b"))
    met = first.withColumnRenamed("id", "a").join(other, ["item", *keys]).filter("a < b").filter(F.least("size", "size_b") >= F.greatest("size", "size_b") * least - 1e-9)
    pairs = met.select("a", "b").distinct()
    a, b = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    found = pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("items_a"), F.col("items_b")).alias("jaccard"))
    return found.filter(F.col("jaccard") >= least)


def callee_sets(symbols: DataFrame, edges: DataFrame, of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Symbols that call, with the names they call: ``(id, fqn, name, kind, callees)``;
    ``of`` may make unlike names one."""
    name = of(F.split_part(F.col("dst"), F.lit("::"), F.lit(-1)))
    called = graph.arcs(edges, ["calls"]).groupBy(F.col("src").alias("fqn")).agg(F.sort_array(F.collect_set(name)).alias("callees"))
    return symbols.select("id", "fqn", "name", "kind").join(called, "fqn")


def similar_functions(symbols: DataFrame, edges: DataFrame, least: float = 0.7, of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``(a, b, similarity)`` of all functions: 0.3 of the names' and 0.7 of the
    callees' likeness, ``least`` or more; a and b are full names, a before b.

    With unlike callees no pair can reach ``least`` above 0.3."""
    if least <= 0.3:
        raise ValueError("the least similarity must be over 0.3")
    f = cut(callee_sets(symbols, edges, of).filter("kind = 'function'").select("fqn", "name", "callees").dropDuplicates(["fqn"]))
    classes = f.groupBy("callees").agg(F.min("fqn").alias("id"), F.count(F.lit(1)).alias("n"))
    members = f.join(classes.drop("n"), "callees").select("id", "fqn", "name")
    bound = (least - 0.3) / 0.7 - 1e-6  # a score that rounds up to the least counts
    sets = classes.select("id", F.col("callees").alias("items"))
    first = cut(_first(sets, bound))
    # pairs that the join would bring together, members of classes too
    brought = first.join(classes.select("id", "n"), "id").groupBy("item").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    if brought * CHEAPER > float(f.count()) ** 2:
        return _by_blocks(f, least)
    alike = _met(sets, first, bound)
    alike = alike.union(alike.select(F.col("b"), F.col("a"), "jaccard")).union(classes.select("id", F.col("id"), F.lit(1.0)))
    left = members.select(F.col("id").alias("a"), F.col("fqn").alias("fa"), F.col("name").alias("na"))
    right = members.select(F.col("id").alias("b"), F.col("fqn").alias("fb"), F.col("name").alias("nb"))
    score = F.round(text.name_similarity(F.col("na"), F.col("nb")) * 0.3 + F.col("jaccard") * 0.7, 6)
    met = alike.join(left, "a").join(right, "b").filter("fa < fb")
    return met.select(F.col("fa").alias("a"), F.col("fb").alias("b"), score.alias("similarity")).filter(F.col("similarity") >= least)


def _shared(a: list, b: list) -> Callable[[slice], np.ndarray]:
    """Of rows of items: how many each of a slice of ``a`` shares with each of ``b``."""
    code = {x: i for i, x in enumerate({x for r in a for x in r} & {x for r in b for x in r})}
    coded = lambda rows: [np.array([code[x] for x in r if x in code], dtype=np.int64) for r in rows]
    a, b = coded(a), coded(b)

    def ones(rows: list, at: int) -> np.ndarray:
        m = np.zeros((len(rows), min(ITEMS, len(code) - at)), dtype=np.float32)
        for i, r in enumerate(rows):
            m[i, r[(r >= at) & (r < at + ITEMS)] - at] = 1
        return m

    once = ones(b, 0).T if len(code) <= ITEMS else None

    def of(rows: slice) -> np.ndarray:
        out = np.zeros((len(a[rows]), len(b)), dtype=np.float32)
        for at in range(0, len(code), ITEMS):
            out += ones(a[rows], at) @ (ones(b, at).T if once is None else once)
        return out

    return of


def _letters(names: list[str]) -> np.ndarray:
    """64 bits of the pairs of letters: those of a part are among those of the whole."""
    bits = lambda n: sum({1 << (ord(x) * 31 + ord(y)) % 64 for x, y in zip(n, n[1:], strict=False)})
    return np.array([bits(n) for n in names], dtype=np.uint64)


def _near(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of two blocks that may reach ``least``: a name that may hold the other counts
    as one that does."""
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    rows = rows.assign(low=rows["low"].where(rows["low"].notna(), rows["name"]), callees=rows["callees"].map(lambda c: c.tolist()))
    rows["words"] = [list(dict.fromkeys(w for w in n.replace("_", " ").split(" ") if w)) for n in rows["low"]]
    x, y = (rows[rows["own"] == k].reset_index(drop=True) for k in (i, j))
    calls, words = _shared(list(x["callees"]), list(y["callees"])), _shared(list(x["words"]), list(y["words"]))
    sizes = lambda f, c: f[c].map(len).to_numpy(dtype=np.float32)
    letters_x, letters_y = _letters(list(x["low"])), _letters(list(y["low"]))
    out = []
    for start in range(0, len(x), STRIP):
        at = slice(start, start + STRIP)
        both, same = calls(at), words(at)
        either = sizes(x, "callees")[at, None] + sizes(y, "callees")[None] - both
        need = (least - 0.7 * both / np.maximum(either, 1) - 1e-5) / 0.3
        named = same / np.maximum(sizes(x, "words")[at, None] + sizes(y, "words")[None] - same, 1)
        p, q = letters_x[at, None], letters_y[None]
        named = np.where(((p & ~q) == 0) | ((q & ~p) == 0), np.maximum(named, 0.8), named)
        # equal names have equal words; ones without words are still equal
        hit = (need <= named + 1e-5) | ((need <= 1) & (p == q) & (named >= 0.8))
        if i == j:
            hit &= np.arange(start, start + len(hit))[:, None] < np.arange(len(y))[None]
        a, b = np.nonzero(hit)
        out.append(pd.DataFrame({"fa": x["fqn"].to_numpy()[a + start], "fb": y["fqn"].to_numpy()[b], "na": x["name"].to_numpy()[a + start], "nb": y["name"].to_numpy()[b], "both": both[a, b].astype("int32"), "either": either[a, b].astype("int32")}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"fa": [], "fb": [], "na": [], "nb": [], "both": [], "either": []})


def _short(f: DataFrame) -> Column:
    """The callees as numbers, where these tell them apart."""
    each = f.select(F.explode("callees").alias("item")).distinct()
    n, numbers = each.agg(F.count(F.lit(1)), F.count_distinct(F.hash("item"))).first()
    return F.transform("callees", lambda x: F.hash(x)) if n == numbers else F.col("callees")


def _by_blocks(f: DataFrame, least: float) -> DataFrame:
    """``similar_functions`` of ``(fqn, name, callees)`` by all pairs of blocks."""
    f = f.filter("name is not null")
    n = f.count()
    # as many blocks as keep the cores busy, as few as tasks can hold
    blocks = max(1, -(-n // BLOCK), min(16, n // 64))
    own = F.pmod(F.xxhash64("fqn"), F.lit(blocks)).cast("int")
    # a row goes to as many tasks as there are blocks: what can be made there is not sent
    low = F.lower("name")
    rows = f.select("fqn", "name", F.when(low != F.col("name"), low).alias("low"), _short(f).alias("callees"), own.alias("own"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    ship(f.sparkSession)
    # every pair of blocks is a group; a task takes a few of them in turn
    met = dealt.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(lambda rows: _near(rows, least), "fa string, fb string, na string, nb string, both int, either int")
    score = F.round(text.name_similarity(F.col("na"), F.col("nb")) * 0.3 + F.col("both") / F.col("either") * 0.7, 6)
    return met.filter("both > 0").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), score.alias("similarity")).filter(F.col("similarity") >= least)


def duplicates(symbols: DataFrame, edges: DataFrame, over: float = 0.8) -> DataFrame:
    """``(a, b, similarity)``: ids of one name prefix whose mean of name and callee
    likeness is above ``over``.

    The mean cannot pass it unless the callees' likeness passes ``2 * over - 1``.
    Symbols of equal callees and equal letters are compared as one."""
    if over < 0.5:
        raise ValueError("the threshold must be at least 0.5")
    s = callee_sets(symbols, edges).select("id", text.prefix(F.col("name")).alias("within"), F.sort_array(text.chars(F.col("name"))).alias("chars"), "callees")
    key = ["within", "chars", "callees"]
    classes = s.groupBy(key).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    members = s.join(classes, key).select("class", "id")
    alike = jaccard_pairs(classes.select(F.col("class").alias("id"), "within", F.col("callees").alias("items")), 2 * over - 1)
    a, b = (classes.select(F.col("class").alias(x), F.col("chars").alias(f"chars_{x}")) for x in "ab")
    score = (jaccard(F.col("chars_a"), F.col("chars_b")) + F.col("jaccard")) / 2
    alike = alike.join(a, "a").join(b, "b").select("a", "b", score.alias("similarity")).filter(F.col("similarity") > over)
    if over < 1:
        alike = alike.union(classes.filter("n > 1").select("class", F.col("class"), F.lit(1.0)))
    left, right = (members.select(F.col("class").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
    met = alike.join(left, "a").join(right, "b").filter("a <> b or id_a < id_b")
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")
