"""Lexical retrieval packing.

A document's ids (with an end id) first fill whole windows by itself; only its
tail, shorter than a window, is packed with others.  Tails are sorted by
content and cut into shards of ``SHARD_DOCS``: the key is ``SKETCH`` min-hashes
of a tail's ids, weighted by how rare an id is, so two tails begin with the same
hash with the probability of their weighted overlap, and those of a hot hash
part by the next.  A shard builds a BM25 inverted index over its tails' token
ids.  The next unused tail is a seed: the index, asked with all of its ids,
returns unused neighbours, which fill the window greedily, best first, as far
as they fit whole; the best neighbour left is cut to close the gap, and its rest
stays in the shard.  The index is asked again while the window has room and a
neighbour is left.  So every sequence but a shard's last is full.

Defined results: a null or empty text is a document of the end id alone; equal
rows are packed like any others; score ties fall to the earlier tail in the
order of id, then row; a null id is kept; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import load, materialise, texts, tune

WINDOW = 1024
SHARD_DOCS = 2048
#: Min-hashes of a tail, in the order in which they sort.
SKETCH = 3
#: Neighbours the index returns at once.
NEIGHBOURS = 64
K1, B = 1.2, 0.75
DENSE = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "doc_id long, row long, doc_tokens long, first long, full array<long>, tail binary"


def _cut(path: str, end_id: int, window: int):
    """Whole windows as checksums, the tail as ids."""

    def run(batches):
        enc = tokens.pieces(path)
        end, serial = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId() << 36
        row = serial
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, enc.dtype)
                whole = len(ids) // window
                wide = ids[: whole * window].astype("<u4")
                full = [zlib.crc32(wide[i * window : (i + 1) * window]) for i in range(whole)]
                out.append((doc_id, row, len(ids), serial, full, ids[whole * window :].astype("<u4").astype("<u2" if enc.dtype.itemsize == 2 else "<u4").tobytes()))
                serial += whole
                row += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary())],
                ["doc_id", "row", "doc_tokens", "first", "full", "tail"],
            )

    return run


class Index:
    """BM25 inverted index over short documents of token ids.

    Terms of more than one in ``DENSE`` documents are kept as rows of a matrix,
    whose product with all documents is made once; the others as postings."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int64), size)
        both, tf = np.unique(owner << 32 | np.concatenate(docs).astype(np.int64), return_counts=True)
        owner, term = both >> 32, both & 0xFFFFFFFF
        _, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, size.mean()))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        often = df * DENSE > self.n
        row, of = np.cumsum(often) - 1, often[term]
        has = np.zeros((self.n, int(often.sum())), np.float32)
        has[owner[of], row[term[of]]] = 1
        dense = np.zeros_like(has)
        dense[owner[of], row[term[of]]] = weight[of]
        self.common = has @ dense.T
        of = ~of & (df[term] > 1)
        owner, term, weight = owner[of], term[of], weight[of]
        self.begin = np.searchsorted(owner, np.arange(self.n + 1))  # a document's terms
        self.terms, self.df = term, np.bincount(term, minlength=len(df))
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = owner[order], weight[order]
        self.post_at = np.concatenate([[0], np.cumsum(self.df)])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document, asked with all terms of ``doc``."""
        terms = self.terms[self.begin[doc] : self.begin[doc + 1]]
        each = self.df[terms]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.post_at[terms] - ends + each, each)
        return self.common[doc] + np.bincount(self.post_doc[at], self.post_weight[at], self.n)

    def neighbours(self, doc: int, unused: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The k best unused documents with a term in common, best first; ties to
        the earlier one."""
        score = self.scores(doc)
        found = np.flatnonzero(unused & (score > 0))
        score = score[found]
        if len(found) > k:
            near = score >= -np.partition(-score, k - 1)[k - 1]
            found, score = found[near], score[near]
        return found[np.argsort(-score, kind="stable")[:k]]


def fill(docs: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, begin, end); every id lies in one of them."""
    if not docs:
        return []
    index = Index(docs)
    begin, size = np.zeros(len(docs), np.int64), np.array([len(d) for d in docs], np.int64)
    unused, windows = size > 0, []
    for seed in range(len(docs)):
        while unused[seed]:
            take, room = [], window

            def use(d: int, n: int, take=take):
                take.append((d, int(begin[d]), int(begin[d]) + n))
                begin[d] += n
                unused[d] = begin[d] < size[d]

            n = int(min(room, size[seed] - begin[seed]))
            use(seed, n)
            room -= n
            while room:
                near = index.neighbours(seed, unused)
                if not len(near):
                    break
                for d in near:
                    left = int(size[d] - begin[d])
                    if left <= room:
                        use(d, left)
                        room -= left
                    if not room:
                        break
                for d in near:
                    if room and unused[d]:
                        n = int(min(room, size[d] - begin[d]))
                        use(d, n)
                        room -= n
            at = seed
            while room:  # no neighbour is left: the next tails in order
                rest = np.flatnonzero(unused[at:])
                if not len(rest):
                    break
                at += int(rest[0])
                n = int(min(room, size[at] - begin[at]))
                use(at, n)
                room -= n
            windows.append(take)
    return windows


def _pack(dtype: str, window: int):
    def run(key, table):
        shard = key[0].as_py()
        rows = sorted(table.select(["doc_id", "row", "doc_tokens", "tail"]).to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["row"]))
        docs = [np.frombuffer(r["tail"], dtype) for r in rows]
        out = []
        for w, take in enumerate(fill(docs, window)):
            offset = 0
            for d, a, b in take:
                r = rows[d]
                base = r["doc_tokens"] - len(docs[d])
                out.append((r["doc_id"], base + a, b - a, zlib.crc32(docs[d][a:b].astype("<u4")), r["doc_tokens"], 1 << 62 | shard << 24 | w, offset))
                offset += b - a
        cols = list(zip(*out, strict=True)) or [[]] * 7
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def _holders(dtype: str):
    """The number of tails that hold each id, of each batch."""

    def run(batches):
        for batch in batches:
            tails = [np.frombuffer(t, dtype) for t in batch.column(0).to_pylist()]
            if tails:
                owner = np.repeat(np.arange(len(tails), dtype=np.int64), [len(t) for t in tails])
                both = np.unique(owner << 32 | np.concatenate(tails).astype(np.int64))
                ids, n = np.unique(both & 0xFFFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    return run


def _ranks(df: np.ndarray, tails: int) -> np.ndarray:
    """``SKETCH`` orders of the ids; the first of a tail's ids is its min-hash.

    Exponential times with the inverse document frequency as rate; ids of one
    tail alone, which nothing can share, come last."""
    rate = np.log1p((tails - df + 0.5) / (df + 0.5))
    with np.errstate(divide="ignore"):
        times = np.stack([-np.log(np.random.default_rng(i).random(len(df))) / rate for i in range(SKETCH)])
    times[:, df < 2] = np.inf
    return np.argsort(np.argsort(times, axis=1, kind="stable"), axis=1, kind="stable").astype(">u4")


def _sketch(dtype: str, ranks: np.ndarray):
    """The sort key of a tail: its min-hashes, then its row."""

    def run(batches):
        for batch in batches:
            key = []
            for row, tail in zip(batch.column("row").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                key.append(ranks[:, np.frombuffer(tail, dtype)].min(1).astype(">u4").tobytes() + row.to_bytes(8, "big"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], [*batch.schema.names, "key"])

    return run


def _bounds(keyed: DataFrame) -> list[bytes]:
    """The first key of every shard but the first, in order: every
    ``SHARD_DOCS``-th of the sorted keys."""
    at = F.monotonically_increasing_id()
    keys = materialise(keyed.select("key").orderBy("key").withColumn("at", at), "packing-keys")
    part = F.shiftright("at", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    if total <= SHARD_DOCS:
        return []
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), part + 1)
    place = first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    chosen = keys.filter((place > 0) & (place % SHARD_DOCS == 0)).select("key").collect()
    return sorted(bytes(r["key"]) for r in chosen)


def _deal(bounds: list[bytes]):
    def run(batches):
        for batch in batches:
            shard = [bisect_right(bounds, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc_tokens", "tail", "row")), pa.array(shard, pa.int64())], ["doc_id", "doc_tokens", "tail", "row", "shard"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents; see ``PIECES``."""
    spark = docs.sparkSession
    tune(spark)
    dtype = tokens.pieces(tokenizer).dtype.str
    cut = materialise(texts(docs).mapInArrow(_cut(tokenizer, end_id, window), _CUT), "packing-cut")
    whole = cut.select("doc_id", "doc_tokens", "first", F.posexplode("full").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    tails = cut.filter(F.length("tail") > 0).select("doc_id", "doc_tokens", "tail", "row")
    n = tails.count()
    held = tails.select("tail").mapInArrow(_holders(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(max(held.column("id").to_pylist(), default=0) + 1, np.int64)
    df[held.column("id").to_numpy()] = held.column("n").to_numpy()
    if n > SHARD_DOCS:
        fields = "doc_id long, doc_tokens long, tail binary, row long"
        keyed = materialise(tails.mapInArrow(_sketch(dtype, _ranks(df, n)), f"{fields}, key binary"), "packing-keyed")
        tails = keyed.mapInArrow(_deal(_bounds(keyed)), f"{fields}, shard long")
    else:
        tails = tails.withColumn("shard", F.lit(0).cast("long"))
    packed = tails.groupBy("shard").applyInArrow(_pack(dtype, window), PIECES)
    return whole.union(packed)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"))
