"""Near-duplicate components by fast similarity sketches.

A document's set of word shingles is sketched in rounds: in round i every
element draws a bin and a value in [i, i+1); a bin keeps its smallest value.
Bins left empty after t rounds take the smallest value of round t + bin over
all elements, so every coordinate is filled.  Coordinates of two sketches agree
with the sets' Jaccard similarity as probability, and their mean concentrates
as that of independent draws.

A sketch is kept as the low byte of each coordinate.  ``BANDS`` bands of ``ROWS``
of these bytes find candidates: a pair at the least similarity shares a bucket
with probability 1 - (1 - 0.8**8)**64 or more, that is all but 8 in a million.
Links are confirmed on the full sets.

Equal sets meet first, by a 128-bit digest, and go on as one class.  Then
1. each class is compared with the smallest class of its buckets;
2. in buckets that still hold several components, each member is compared with
   its likeliest partner in a larger one, in as many rounds as ``BEST`` has
   entries (of so many partners from each bucket one not yet tried is taken);
   true groups become one component here, without all their pairs; then
3. all pairs of different components whose sketches do not rule them out
   (agreement under the threshold by ``sigmas`` standard deviations; None: by
   nothing) are compared on their sets, which join only the members that have
   such a partner.
Buckets of any size are compared in blocks of ``BLOCK`` members against each
other inside tasks, which emit links or one candidate a member, not all pairs.

Defined results: a null or empty text, or one without words, has an empty set
and no links; fewer words than a shingle form one shingle; equal rows and ties
fall to the smallest id; a null id is kept and linked with nothing; rows of one
id are one node; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, texts, tune
from .graph import components

BANDS, ROWS = 64, 8
T = BANDS * ROWS
SIGMAS = 5
BLOCK = 2048  # members of a block; a large set counts as one more for every BLOCK_WORDS
BLOCK_WORDS = 512
#: Bytes of rows a task holds before it compares the groups that are whole.
HELD_BYTES = 32 << 20
BEST = (1, 3)
MEMO_WORDS = 500_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_VALUE_BITS = np.uint64(40)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's k-word shingles, ascending."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * _A + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """The t coordinates of a non-empty set's fast similarity sketch."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << int(_VALUE_BITS)) - 1)
    done, step = 0, max(1, math.ceil(t * (math.log(t) + 1) / len(s)))
    while done < t:
        rounds = np.arange(done, min(t, done + step), dtype=np.uint64)[:, None]
        h = mix(s[None, :] ^ mix((rounds + np.uint64(1)) * _A))
        bins = ((h >> np.uint64(44)) * np.uint64(t)) >> np.uint64(20)
        np.minimum.at(out, bins.astype(np.int64).ravel(), ((rounds << _VALUE_BITS) | (h & low)).ravel())
        done += step
        step = max(1, step // 4)
        empty = np.flatnonzero(out == np.iinfo(np.uint64).max)
        if not len(empty):
            return out
    for b in empty:
        r = np.array([t + b], np.uint64)
        out[b] = (r[0] << _VALUE_BITS) | (mix(s ^ mix((r + np.uint64(1)) * _A)) & low).min()
    return out


_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _A)


def band_keys(coords: bytes) -> np.ndarray:
    """The bucket of each band of a sketch's bytes."""
    return mix(np.frombuffer(coords, "<u8") ^ _SALTS).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two ascending arrays."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both, len(a) + len(b) - both


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids, n, key, coords = batch.column(0), [], [], []
            seen: dict[bytes, bytes] = {}
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, k)
                n.append(len(s))
                if doc_id is None or not len(s):
                    key.append(None), coords.append(None)
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest not in seen:
                    seen[digest] = (sketch(s) & np.uint64(255)).astype(np.uint8).tobytes()
                key.append(digest), coords.append(seen[digest])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(coords, pa.binary())], ["doc_id", "n_shingles", "key", "coords"])

    return run


def _explode_bands(batches):
    for batch in batches:
        ids = np.asarray(batch.column(0))
        keys = [band_keys(b.as_py()) for b in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(ids, BANDS))], ["k", "id"])


def _confirm(k: int, percent: int):
    def run(batches):
        last, mine = None, None
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if (a, ta) != last:
                    last, mine = (a, ta), shingles(ta, k)
                both, union = jaccard(mine, shingles(tb, k))
                if 100 * both >= percent * union:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the similarity.

    ``docs`` is ``(doc_id, text)``; the smaller id of a pair may be shared by
    very many pairs, so it joins last and the join may be split by AQE."""
    side = lambda c, t: docs.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    wide = pairs.join(side("b", "tb"), "b").join(side("a", "ta"), "a").select("a", "b", "ta", "tb")
    return wide.mapInArrow(_confirm(k, percent), "a long, b long").distinct()


def _groups(batches, key: int):
    """Whole groups of rows that agree in the first ``key`` columns, as lists of
    tables with the groups' borders; the rows come sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows < 2 * BLOCK and held.nbytes < HELD_BYTES:
            continue
        held = held.combine_chunks()
        last = np.flatnonzero(np.any([(x := np.asarray(held.column(c))) != x[-1] for c in range(key)], axis=0))
        if len(last):
            upto = int(last[-1]) + 1
            yield held.slice(0, upto), _borders(held.slice(0, upto), key)
            held = held.slice(upto)
    if held is not None and held.num_rows:
        yield held, _borders(held, key)


def _borders(table: pa.Table, key: int) -> list[int]:
    step = np.any([np.diff(np.asarray(table.column(c))) != 0 for c in range(key)], axis=0)
    return [0, *(np.flatnonzero(step) + 1).tolist(), table.num_rows]


def _cross(percent: int, best: int | None, sigmas: float | None):
    """Likely pairs of different components in the pairs of blocks of buckets.

    With ``best``, each member's likeliest partners in larger components as
    ``(a, b, s)``, a being the member and s the coordinates that agree.  Without, all likely pairs are
    compared: on ``set`` where the rows have it, and the links come out, one for
    each two components; else the ids that take part come out, as a."""
    cut = 0 if sigmas is None else T * (percent / 100) - sigmas * math.sqrt(T * percent / 100 * (1 - percent / 100))

    def run(batches):
        for table, edges in _groups(batches, 3):
            i, j, block, ids, comp, n, size = (np.asarray(table.column(c)) for c in range(1, 8))
            grid = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(len(ids), T)
            sets = table.column(9).to_pylist() if table.num_columns > 9 else None
            out = set()
            for lo, hi in zip(edges, edges[1:], strict=False):
                root: dict[int, int] = {}

                def of(c: int, root=root) -> int:
                    while (up := root.get(c, c)) != c:
                        root[c] = c = root.get(up, up)
                    return c

                left = lo + np.flatnonzero(block[lo:hi] == i[lo])
                right = lo + np.flatnonzero(block[lo:hi] == j[lo])
                both = best is not None and i[lo] != j[lo]
                for m, right in [*((m, right) for m in left.tolist()), *((m, left) for m in right.tolist() if both)]:
                    rc, rn = comp[right], n[right]
                    ok = (rc != comp[m]) & (100 * np.minimum(rn, n[m]) >= percent * np.maximum(rn, n[m]))
                    if best is not None:  # the smaller component proposes
                        ok &= (size[right] > size[m]) | ((size[right] == size[m]) & (rc < comp[m]))
                    elif i[lo] == j[lo]:
                        ok &= right > m
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    same = (grid[right[at]] == grid[m]).sum(1)
                    hit = np.flatnonzero(same >= cut)
                    if not len(hit):
                        continue
                    hit = hit[np.argsort(-same[hit], kind="stable")]
                    me = int(ids[m])
                    if best is not None:
                        out.update((me, r, s) for r, s in zip(ids[right[at[hit[:best]]]].tolist(), same[hit[:best]].tolist(), strict=True))
                    elif sets is None:
                        out.add((me, 0, 0))
                        out.update((r, 0, 0) for r in ids[right[at[hit]]].tolist())
                    else:
                        mine = np.frombuffer(sets[m], "<u8")
                        for r in right[at[hit]].tolist():
                            if of(int(comp[m])) == of(int(comp[r])):
                                continue
                            other = np.frombuffer(sets[r], "<u8")
                            place = np.searchsorted(mine, other)
                            shared = int((mine[np.minimum(place, len(mine) - 1)] == other).sum())
                            if 100 * shared >= percent * (len(mine) + len(other) - shared):
                                root[of(int(comp[m]))] = of(int(comp[r]))
                                out.add((min(me, int(ids[r])), max(me, int(ids[r])), 0))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64()), pa.array([p[2] for p in rows], pa.int32())], ["a", "b", "s"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, k).astype("<u8").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "set"])

    return run


def _mixed(stars: DataFrame, classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold more than one component, dealt to pairs
    of blocks ``(k, i, j, block, id)``, and every class with its component."""
    part = classes.select("id", "n", "coords").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    part = part.join(part.groupBy("component").agg(F.count(F.lit(1)).alias("csize")), "component")
    comp = part.select("id", "component")
    mixed = (
        stars.join(comp, "id")
        .join(comp.select(F.col("id").alias("rep"), F.col("component").alias("of_rep")), "rep")
        .filter("component <> of_rep")
        .select("k")
        .distinct()
    )
    inside = stars.join(mixed, "k", "left_semi")
    ids = inside.select("k", "id").union(inside.select("k", F.col("rep").alias("id")).distinct())
    members = materialise(ids.join(classes.select("id", (1 + F.floor(F.col("n") / BLOCK_WORDS)).alias("weight")), "id"), "bucket-members")
    # buckets of the same members are compared once
    one = members.groupBy("k").agg(F.sum("weight").alias("size"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"))
    kept = one.groupBy("size", "x", "y").agg(F.min("k").alias("k")).select("k", F.floor((F.col("size") - 1) / BLOCK).cast("int").alias("last"))
    whole = members.join(kept.filter("last = 0"), "k").select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "id")
    split = (
        members.join(kept.filter("last > 0"), "k")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        .select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    )
    dealt = whole.union(split)
    return dealt, part


def _compared(dealt: DataFrame, part: DataFrame, percent: int, best: int | None, sigmas: float | None, sets: DataFrame | None = None) -> DataFrame:
    columns = ["k", "i", "j", "block", "id", "component", "n", "csize", "coords"]
    rows = dealt.join(part, "id")
    if sets is not None:
        rows, columns = rows.join(sets, "id"), [*columns, "set"]
    groups = rows.select(*columns).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "block", "id")
    return groups.mapInArrow(_cross(percent, best, sigmas), "a long, b long, s int")


def _best(dealt: DataFrame, part: DataFrame, tried: DataFrame, percent: int, best: int) -> DataFrame:
    """The likeliest pair, not yet tried, of each member."""
    found = _compared(dealt, part, percent, best, SIGMAS)
    fresh = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "s").distinct()
    fresh = fresh.join(tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    return fresh.groupBy("a").agg(F.max(F.struct("s", -F.col("x"), -F.col("y"), "x", "y")).alias("m")).select(F.col("m.x").alias("a"), F.col("m.y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, sigmas: float | None = SIGMAS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document."""
    tune(docs.sparkSession)
    rows = texts(docs)
    signed = materialise(rows.mapInArrow(_signatures(words), "doc_id long, n_shingles long, key binary, coords binary"), "signatures")
    classes = materialise(
        signed.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "coords")).alias("m")).select("key", "m.*"),
        "classes",
    )
    # a bucket's smallest class is found by partial aggregation, whatever its size
    banded = classes.select("id", "coords").mapInArrow(_explode_bands, "k long, id long")
    reps = banded.groupBy("k").agg(F.min("id").alias("rep"), F.max("id").alias("most")).filter("rep <> most").select("k", "rep")
    stars = materialise(banded.join(reps, "k").filter("rep <> id").select("k", "id", "rep"), "stars")
    # only texts that share a bucket are compared: they are set apart once
    shared = stars.select(F.col("id").alias("doc_id")).union(stars.select("rep")).distinct()
    near = materialise(rows.join(shared, "doc_id", "left_semi"), "near-texts")
    pairs = stars.groupBy(F.col("id").alias("b")).agg(F.min("rep").alias("a")).select("a", "b")
    links = materialise(confirm(pairs, near, words, percent), "near-links")
    tried = pairs
    for best in BEST:
        dealt, part = _mixed(stars, classes, components(links))
        pairs = materialise(_best(dealt, part, tried, percent, best), "near-pairs")
        if not pairs.limit(1).count():
            break
        tried = tried.union(pairs)
        links = materialise(links.union(confirm(pairs, near, words, percent)), "near-links")
    dealt, part = _mixed(stars, classes, components(links))
    dealt = materialise(dealt, "dealt")
    left = materialise(_compared(dealt, part, percent, None, sigmas).select(F.col("a").alias("id")).distinct(), "undecided")
    sets = near.join(left.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(words), "id long, set binary")
    # rows of one id are one node: its class has the set of one of them
    sets = sets.join(classes.select("id", "n"), "id").filter(F.length("set") == F.col("n") * 8).groupBy("id").agg(F.min("set").alias("set"))
    last = _compared(dealt.join(left, "id", "left_semi"), part, percent, None, sigmas, sets).select("a", "b")
    links = materialise(links.union(last.distinct()), "near-links")
    labels = components(links)
    of = classes.select("key", F.col("id")).join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "key")
        .join(of, "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), words=2)


#: The same rows in DuckDB SQL, by an exact join: two sets of n and m items with 80 % in
#: common share one of the first n - ceil(0.8 n) + 1 of n, and of m, in order of rarity.
ORACLE = r"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w
),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, s FROM sets WHERE len(s) > 0 GROUP BY s),
term AS (SELECT x, row_number() OVER (ORDER BY count(*), x) AS r FROM (SELECT unnest(s) AS x FROM classes) GROUP BY x),
item AS MATERIALIZED (
    SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY r) AS nth, count(*) OVER (PARTITION BY id) AS n
    FROM (SELECT id, unnest(s) AS x FROM classes) JOIN term USING (x)
),
first AS MATERIALIZED (SELECT id, r, n FROM item WHERE nth <= n - (4 * n + 4) // 5 + 1),
pair AS (SELECT DISTINCT a.id AS a, b.id AS b FROM first a JOIN first b USING (r) WHERE a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
link AS MATERIALIZED (
    SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS shared, len(x.s) + len(y.s) AS n FROM pair JOIN classes x ON x.id = a JOIN classes y ON y.id = b)
    WHERE 100 * shared >= 80 * (n - shared)
),
reach AS (SELECT id, id AS other FROM classes UNION SELECT reach.id, CASE WHEN a = other THEN b ELSE a END FROM reach JOIN link ON a = other OR b = other),
least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(coalesce(component, doc_id) AS BIGINT) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN least USING (id)"""
