"""Language identification: multinomial naive Bayes over hashed n-grams.

Features are character 2-, 3- and 4-grams of the lower-cased letters, with any
run of other characters as one space, hashed into ``BUCKETS`` buckets.  Counts
by language are summed in Spark from a sample of at most about
``TRAIN_DOCS`` labelled documents a language (all, where there are fewer).  All
languages are learnt.  The log-probability matrix (languages x buckets) is cut
into blocks of ``BLOCK_LANGS`` languages, each a broadcast of its own; a worker
holds one block at a time, and the best over the blocks counts.  Batches of
documents are scored together.

The score is the posterior that the text's mean evidence would give over
``EVIDENCE`` n-grams, so it does not saturate with a text's length.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing is labelled; equal texts get equal predictions;
score ties fall to the smaller language; very long texts count whole; a null id
is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import load, materialise, texts, tune

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
TRAIN_DOCS = 20_000
BLOCK_LANGS = 64
ALPHA = 0.5
EVIDENCE = 24
#: Characters scored at once (a longer text is a batch of its own).
BATCH_CHARS = 1 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Letters as code points, runs of anything else as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, c, np.uint32(32))[keep].astype(np.uint64)


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text after text, and each text's first place."""
    parts = [_codes(t) for t in batch]
    gap = np.zeros(1, np.uint64)
    c = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    doc = np.repeat(np.arange(len(parts)), sizes)
    found, owner = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        bad = np.zeros(m, bool)
        for i in range(n):
            x = c[i : m + i]
            h = (h ^ x) * _K
            h ^= h >> np.uint64(29)
            bad |= x == 0
        found.append((h >> np.uint64(40)).astype(np.int64)[~bad] & (BUCKETS - 1))
        owner.append(doc[:m][~bad])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def _batches(rows):
    """Lists of rows whose texts are about BATCH_CHARS together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(batches, *columns: int):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for held in _batches(_rows(batches, 0, 1)):
        bucket, owner = features([t for _, t in held])
        langs = np.array([x for x, _ in held], object)
        for lang in set(langs):
            own = bucket[(langs == lang)[owner]]
            total[lang] = total.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
            if len(total) >= BLOCK_LANGS:  # bounds what a worker holds
                yield from _counted(total)
                total.clear()
    yield from _counted(total)


def _counted(total: dict[str, np.ndarray]):
    for lang, n in total.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """A block of languages, or all of them."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def blocks(self):
        yield self

    def best(self, bucket: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[tuple[float, str, float, float]]:
        """Of each text: the best language's evidence, that language, its
        evidence over EVIDENCE n-grams, and all languages' sum relative to it."""
        logp = np.stack([np.bincount(owner, row[bucket], len(n)) for row in self.matrix], 1)
        out = []
        for k, row in zip(n, logp, strict=True):
            best = int(np.argmax(row + self.prior))
            z = (row + self.prior) * min(1.0, EVIDENCE / max(1, k))
            top = z.max()
            out.append((float((row + self.prior)[best]), self.langs[best], float(top), float(np.exp(z - top).sum())))
        return out

    def predict(self, batch: list[str]) -> list[tuple[str, float]]:
        bucket, owner = features(batch)
        n = np.bincount(owner, minlength=len(batch))
        found: list[tuple[float, str, float, float]] = []
        for block in self.blocks():
            if not block.langs:
                continue
            here = block.best(bucket, owner, n)
            found = [_better(x, y) for x, y in zip(found, here, strict=True)] if found else here
        if not found:
            return [("und", 0.0)] * len(batch)
        return [(lang, 1.0 / total) if k or any(map(str.isalpha, text)) else ("und", 0.0) for text, k, (_, lang, _, total) in zip(batch, n, found, strict=True)]


def _better(x: tuple[float, str, float, float], y: tuple[float, str, float, float]) -> tuple[float, str, float, float]:
    """The best of two blocks, with the sum over both; ties to the first."""
    if y[0] > x[0]:
        x, y = y, x
    return (*x[:3], x[3] + y[3] * float(np.exp(y[2] - x[2])))


class Blocks(Model):
    """A model of many languages: broadcasts of blocks, in order of language."""

    def __init__(self, parts: list):
        self.parts = parts

    def blocks(self):
        for part in self.parts:
            path = getattr(part, "_path", None)
            # read anew: a worker keeps no block; (encrypted ones have no file)
            yield Model(*(part.load_from_path(path) if path else part.value))


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, block_langs: int = BLOCK_LANGS) -> Model:
    """Learn from ``(doc_id, text, lang)``; rows without a language are skipped.

    The driver holds a number a language, and one block of the matrix."""
    spark = labelled.sparkSession
    tune(spark)
    known = labelled.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    large = [x for lang in langs if sizes[lang] > train_docs for x in (F.lit(lang), F.lit(train_docs / sizes[lang]))]
    if large:
        share = F.coalesce(F.create_map(*large)[F.col("lang")], F.lit(1.0))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < share * 1_000_000)
    summed = known.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    if len(langs) <= block_langs:
        return Model(langs, _matrix(summed, langs), prior)
    summed, parts = materialise(summed, "langid-counts"), []
    for i in range(0, len(langs), block_langs):
        block = langs[i : i + block_langs]
        parts.append(spark.sparkContext.broadcast((block, _matrix(summed.filter(F.col("lang").isin(block)), block), prior[i : i + block_langs])))
    return Blocks(parts)


def _matrix(summed: DataFrame, langs: list[str]) -> np.ndarray:
    counts = np.zeros((len(langs), BUCKETS))
    table = summed.toArrow()
    at = {x: i for i, x in enumerate(langs)}
    rows = np.array([at[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[rows, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    counts += ALPHA
    return np.log(counts / counts.sum(1, keepdims=True))


def _predict(model: Model):
    def run(batches):
        for held in _batches(_rows(batches, 0, 1, 2)):
            found = model.predict([t for *_, t in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document."""
    tune(docs.sparkSession)
    rows = texts(docs).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _annotate(model: Model):
    def run(batches):
        for batch in batches:
            text = ["" if t is None else t for t in batch.column(1).to_pylist()]
            found = [x for held in _batches((t,) for t in text) for x in model.predict([t for (t,) in held])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["row", "lang", "score"])

    return run


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is identified with at least this score."""
    tune(docs.sparkSession)
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    # the row travels as a struct, so no column of it can clash
    rows = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"))
    marked = rows.mapInArrow(_annotate(model), StructType([rows.schema["row"], StructField("lang", StringType()), StructField("score", DoubleType())]))
    return marked.filter((F.col("lang") != "und") & (F.col("score") >= least)).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs.filter(~held_out())))
