"""Improbable-feature digests of documents.

Every window of ``W`` bytes has an entropy; how rare its (quantised) entropy is
in the whole corpus ranks it.  In every run of ``RUN`` windows the rarest
(leftmost on ties) gets a point; windows with ``POINTS`` points are features.
Windows of almost no entropy are never features.  A feature's hash sets
``HASHES`` bits of a Bloom filter of ``BITS`` bits; a filter takes at most
``FILL`` features, then the next of the chain begins.

Two digests compare filter by filter: the share of common bits between what two
unrelated filters of these sizes would share and what they could share at most;
the smaller digest's filters take their best match, and the mean counts.

Defined results: a text shorter than a window, or without a feature, is one
feature of its own, so equal texts have likeness 1; the empty text has an empty
digest, alike (1) only to another empty one; null texts are empty; the next of
the last document is the first; ties in id follow the text; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import load, texts, tune
from .order import with_successors

W = 64
RUN = 64
POINTS = 16
LEVELS = 1024
LOWEST = 100  # quantised entropies under this are no features
BITS, HASHES, FILL = 2048, 5, 128
BLOCK = 1 << 16
TOGETHER = 1 << 18  # bytes of short texts whose windows are looked at in one go

_G = np.round(np.arange(W + 1) * np.log2(np.maximum(np.arange(W + 1), 1)) * (1 << 20)).astype(np.int64)
_UP = np.diff(_G)  # _UP[n]: from n to n + 1 of a byte
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def entropies(b: np.ndarray) -> np.ndarray:
    """Quantised entropy (0 to LEVELS - 1) of every window of the bytes."""
    m = len(b) - W + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    back, ahead = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for lo in range(0, len(b), BLOCK):  # stays in the cache
        hi = min(len(b), lo + BLOCK)
        for k in range(1, W):
            a = max(lo, k)
            if a >= hi:
                break
            same = (b[a:hi] == b[a - k : hi - k]).view(np.uint8)
            back[a:hi] += same
            ahead[a - k : hi - k] += same
    total = np.empty(m, np.int64)
    total[0] = _G[np.bincount(b[:W], minlength=256)].sum()
    if m > 1:
        # byte i - W leaves (of 1 + ahead), byte i enters (to back of the last W - 1)
        total[1:] = total[0] + np.cumsum(_UP[back[W:]] - _UP[ahead[: m - 1]])
    h = 6.0 - total / (W << 20)
    return np.clip((h * (LEVELS / 6.0)).astype(np.int64), 0, LEVELS - 1)


def entropies_of(texts: list[bytes]) -> list[np.ndarray]:
    """``entropies`` of each text.  Short texts are taken together, as most of their time
    is that of starting a step; windows over two texts are left out."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= TOGETHER:
            size += len(texts[end])
            end += 1
        e, begin = entropies(np.frombuffer(b"".join(texts[at:end]), np.uint8)).astype(np.int16), 0
        for text in texts[at:end]:
            out.append(e[begin : begin + max(0, len(text) - W + 1)])
            begin += len(text)
        at = end
    return out


def features(e: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Begins of the selected windows of these entropies, ascending."""
    m = len(e)
    if not m:
        return np.zeros(0, np.int64)
    keys = rank[e].astype(np.int64) << 32 | np.arange(m)
    run, span = keys, 1
    while span < RUN and len(run) > 1:  # minimum over windows of 2, 4, ... windows
        step = min(span, len(run) - 1)
        run = np.minimum(run[:-step], run[step:])
        span += step
    points = np.bincount(run & 0xFFFFFFFF, minlength=m)
    need = min(POINTS, len(run))
    return np.flatnonzero((points >= need) & (e >= LOWEST))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def digest(text: str, rank: np.ndarray) -> np.ndarray:
    """The chained filters, one a row."""
    raw = utf8(text)
    return _digest(raw, entropies_of([raw])[0], rank)


def _digest(raw: bytes, e: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not raw:
        return np.zeros((0, BITS // 8), np.uint8)
    b = np.frombuffer(raw, np.uint8)
    at = features(e, rank)
    if len(at):
        words = np.lib.stride_tricks.sliding_window_view(b, W)[at].copy().view("<u8")
        h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for i in range(words.shape[1]):
            h = (h ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        _, first = np.unique(h, return_index=True)
        h = h[np.sort(first)]
    else:
        h = np.array([xxhash.xxh3_64_intdigest(raw)], np.uint64)
    n = -(-len(h) // FILL)
    out = np.zeros((n, BITS), bool)
    owner = np.arange(len(h)) // FILL
    for k in range(HASHES):
        out[owner, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1)


def written(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def read(text: str) -> np.ndarray:
    n, _, body = text.partition(":")
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(int(n), BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric but for digests of equally many filters."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    na, nb = _ONES[a].sum(1, dtype=np.int64), _ONES[b].sum(1, dtype=np.int64)
    total = 0.0
    for row, n in zip(a, na, strict=True):
        common = _ONES[row & b].sum(1, dtype=np.int64)
        most = np.minimum(n, nb)
        chance = n * nb / BITS
        cut = chance + 0.3 * (most - chance)  # what unrelated filters may share
        total += float(np.max(np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1)))
    return min(1.0, total / len(a))


def _histogram(batches):
    total = np.zeros(LEVELS, np.int64)
    for batch in batches:
        for e in entropies_of([utf8(text) for text in batch.column(0).to_pylist()]):
            total += np.bincount(e, minlength=LEVELS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank by entropy level: 0 for the rarest over all windows of all texts."""
    from pyspark.sql import functions as F

    tune(docs.sparkSession)
    n = np.zeros(LEVELS, np.int64)
    for r in texts(docs).select("text").mapInArrow(_histogram, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        n[r["level"]] = r["n"]
    # levels of almost no entropy come last
    order = np.lexsort([np.arange(LEVELS), n, np.arange(LEVELS) < LOWEST])
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(rank: np.ndarray):
    def run(batches):
        part, last = None, None
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            raws = [utf8(text) for text in texts]
            for doc_id, text, p, tail, raw, e in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), raws, entropies_of(raws), strict=True):
                if tail and (last is None or part != p):
                    continue  # only the first of the next part's rows counts
                own = _digest(raw, e, rank)
                if last is not None and part == p:
                    rows.append((*last, text, own))
                part, last = p, None if tail else (doc_id, text, own)
            new = [utf8(edited(text, following)) for _, text, _, following, _ in rows]
            out = [_row(doc_id, text, own, other, raw, _digest(raw, e, rank)) for (doc_id, text, own, _, other), raw, e in zip(rows, new, entropies_of(new), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return run


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: np.ndarray, other: np.ndarray, new: bytes, changed: np.ndarray):
    return (doc_id, len(text), hashlib.sha256(new).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, other))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Digests of all documents and of their edited texts; see ``OUT``."""
    rank = rarity(docs)
    rows = with_successors(texts(docs), "doc_id", "text")
    return rows.select("doc_id", "text", "part", "tail").mapInArrow(_compare(rank), OUT)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(load(spark, sf_dir, "documents"))
