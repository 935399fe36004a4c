"""Token-id output: canonical length-limited Huffman containers.

``encode`` turns documents into container rows, ``decode`` reads them back.

Documents are dealt by ranges of their id, so containers ascend with it.  Pass
one tokenises and stores packed ids in units of about ``UNIT`` tokens; pass two
sums the ids' counts over all units (the driver gets one row for each id of the
vocabulary and one for each shard); pass three codes each unit by itself.  A
container carries bit offsets every ``interval`` tokens, so its blocks decode
independently: all of them advance together through one table.  The code table
(a checksummed code length an id) is stored beside the containers, so a reader
needs the files alone.

Defined results: a null or empty text is a document of the end id alone; equal
rows are separate documents; rows of one id follow each other by a hash of the
text, then the text; a null id sorts first; a very long text is a unit of its
own; other columns are ignored; an empty table gives the code table alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import load, materialise, texts, tune, width

UNIT = 1 << 18
INTERVAL = 128
MAX_LENGTH = 20
#: Tokens coded at once, so that the arrays stay in the cache.
PACKED_AT_ONCE = 1 << 14
MAGIC = b"CHF1"
_HEAD = struct.Struct("<4sIQIIIQI")  # magic, documents, start, tokens, interval, checkpoints, payload bytes, crc
TABLE_MAGIC = b"CHT1"
_TABLE_HEAD = struct.Struct("<4sII")  # magic, ids, crc
#: The shard number of the row that holds the code table.
TABLE_SHARD = -1

UNIT_SCHEMA = "shard int, unit int, start long, n_tokens long, doc_ids binary, lengths binary, ids binary"
OUT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_NULL_ID = np.iinfo(np.int64).min


# ---- codes -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits (package-merge).

    Ids that never occur get length 0.  Bounded by the vocabulary.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    rows, packages = [], leaves[:0]
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        rows.append(order < len(leaves))
        both = both[order]
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    take, lengths = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for is_leaf in reversed(rows):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id and ids by code; codes of one length ascend with the id."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    n = lengths[ids].astype(np.int64)
    left = np.zeros(len(ids), np.int64)
    np.cumsum((1 << (MAX_LENGTH - n))[:-1], out=left[1:])
    codes = np.zeros(len(lengths), np.uint64)
    codes[ids] = (left >> (MAX_LENGTH - n)).astype(np.uint64)
    return codes, ids


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, interval: int) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids``, first bit highest, and the bit offset of each block."""
    n = lengths[ids]
    total = int(n.sum(dtype=np.int64))
    words, marks, at = np.zeros(total // 64 + 2, np.uint64), np.zeros(len(ids), np.int64), 0
    for lo in range(0, len(ids), PACKED_AT_ONCE):
        some = n[lo : lo + PACKED_AT_ONCE].astype(np.int64)
        ends = np.cumsum(some)
        begins = ends - some + at
        marks[lo : lo + len(some)] = begins
        at += int(ends[-1])
        word = begins >> 6
        code = codes[ids[lo : lo + len(some)]]
        right = 64 - (begins & 63) - some  # below 0: the code runs on into the next word
        here = np.where(right >= 0, code << np.maximum(right, 0).astype(np.uint64), code >> np.maximum(-right, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(right < 0)
        words[word[over] + 1] |= code[over] << (64 + right[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], marks[::interval].astype("<u8")


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next MAX_LENGTH bits."""
    _, ids = canonical(lengths)
    span = 1 << (MAX_LENGTH - lengths[ids].astype(np.int64))
    pad = (1 << MAX_LENGTH) - int(span.sum())
    return (
        np.concatenate([np.repeat(ids, span), np.zeros(pad, np.int64)]).astype(np.uint32),
        np.concatenate([np.repeat(lengths[ids], span), np.ones(pad, np.uint8)]),
    )


def unpack(payload: bytes, marks: np.ndarray, n_tokens: int, interval: int, tab) -> np.ndarray:
    """Decode all blocks side by side, one token of each at a time."""
    by_id, by_len = tab
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((interval, len(marks)), np.uint32)
    at = marks.astype(np.int64)
    full = n_tokens - interval * (len(marks) - 1)  # tokens of the last block
    for k in range(min(interval, n_tokens)):
        live = at if k < full else at[:-1]
        peek = (window[live >> 3] << (live & 7).astype(np.uint32)) >> np.uint32(32 - MAX_LENGTH)
        out[k, : len(live)] = by_id[peek]
        live += by_len[peek]
    return out.T.reshape(-1)[:n_tokens]


# ---- containers ------------------------------------------------------------


def write_container(start: int, doc_ids: bytes, doc_lengths: bytes, ids: np.ndarray, lengths, codes, interval=INTERVAL) -> bytes:
    payload, marks = pack(ids, lengths, codes, interval)
    body = doc_ids + doc_lengths + marks.tobytes() + payload
    return _HEAD.pack(MAGIC, len(doc_lengths) // 4, start, len(ids), interval, len(marks), len(payload), zlib.crc32(body)) + body


def read_container(blob: bytes, tab) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Start, document ids, document lengths and token ids; checks the checksum."""
    magic, docs, start, n, interval, marks, size, crc = _HEAD.unpack_from(blob)
    body = blob[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a container, or a damaged one")
    ids, rest = np.frombuffer(body, "<i8", docs), body[8 * docs :]
    lengths, rest = np.frombuffer(rest, "<u4", docs), rest[4 * docs :]
    at, rest = np.frombuffer(rest, "<u8", marks), rest[8 * marks :]
    return start, ids, lengths, unpack(rest[:size], at, n, interval, tab)


def write_table(lengths: np.ndarray) -> bytes:
    """The code lengths by id; the canonical codes follow from them."""
    raw = lengths.astype(np.uint8).tobytes()
    return _TABLE_HEAD.pack(TABLE_MAGIC, len(raw), zlib.crc32(raw)) + zlib.compress(raw)


def read_table(blob: bytes) -> np.ndarray:
    magic, n, crc = _TABLE_HEAD.unpack_from(blob)
    raw = zlib.decompress(blob[_TABLE_HEAD.size :]) if magic == TABLE_MAGIC else b""
    if magic != TABLE_MAGIC or len(raw) != n or zlib.crc32(raw) != crc:
        raise ValueError("not a code table, or a damaged one")
    return np.frombuffer(raw, np.uint8)


# ---- Spark -----------------------------------------------------------------


def _units(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = tokens.pieces(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        ids, lens, parts, n, unit, start = [], [], [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "unit": unit, "start": start, "n_tokens": n, "doc_ids": np.array(ids, "<i8").tobytes(), "lengths": np.array(lens, "<u4").tobytes(), "ids": b"".join(parts)}],
                pa.schema([("shard", pa.int32()), ("unit", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = enc.encode(text) + end
                ids.append(_NULL_ID if doc_id is None else doc_id)
                lens.append(len(coded) // enc.dtype.itemsize)
                parts.append(coded)
                n += lens[-1]
                if n >= UNIT:
                    yield flush()
                    start, unit, n = start + n, unit + 1, 0
                    ids, lens, parts = [], [], []
        if ids:
            yield flush()

    return run


def _counts(dtype: str, vocab: int):
    def run(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_py(), dtype), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def _containers(dtype: str, lengths: np.ndarray, starts: dict[int, int], interval: int):
    def run(batches):
        codes, _ = canonical(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                blob = write_container(starts[row["shard"]] + row["start"], row["doc_ids"], row["lengths"], np.frombuffer(row["ids"], dtype), lengths, codes, interval)
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "unit": row["unit"], "container": blob}], pa.schema([("shard", pa.int32()), ("unit", pa.int32()), ("container", pa.binary())]))

    return run


def encode(docs: DataFrame, tokenizer: str, end_id: int = 1, interval: int = INTERVAL) -> DataFrame:
    """Stored containers ``(shard, unit, container)``, ascending with the document
    id; the row of shard ``TABLE_SHARD`` holds the code table.

    ``docs`` has ``doc_id`` and ``text``.  The broadcast state is the code
    lengths (one byte for each id of the vocabulary) and one offset a shard.
    """
    spark = docs.sparkSession
    tune(spark)
    enc = tokens.pieces(tokenizer)
    vocab, dtype = max(enc.size, end_id + 1), enc.dtype.str
    mixed = F.xxhash64("text")
    rows = texts(docs).repartitionByRange(width(spark), "doc_id", mixed).sortWithinPartitions("doc_id", mixed, "text")
    units = materialise(rows.mapInArrow(_units(tokenizer, end_id), UNIT_SCHEMA), "token-units")
    counts = np.zeros(vocab, np.int64)
    for r in units.select("ids").mapInArrow(_counts(dtype, vocab), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    starts, at = {}, 0
    for r in units.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        starts[r["shard"]], at = at, at + r["n"]
    schema = "shard int, unit int, container binary"
    codes = spark.createDataFrame([(TABLE_SHARD, 0, bytearray(write_table(lengths)))], schema)
    return materialise(codes.union(units.mapInArrow(_containers(dtype, lengths, starts, interval), schema)), "token-containers", "none")


def _decoded(containers: DataFrame, digest: bool, schema: str) -> DataFrame:
    """Reads the code table from the containers themselves."""
    row = containers.filter(F.col("shard") == TABLE_SHARD).select("container").first()
    if row is None:
        raise ValueError("the containers have no code table")
    return containers.filter(F.col("shard") != TABLE_SHARD).select("container").mapInArrow(_read(read_table(bytes(row[0])), digest), schema)


def decode(containers: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of every document in stored containers."""
    return _decoded(containers, False, "doc_id long, start long, ids array<int>")


def describe(containers: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in stored containers."""
    return _decoded(containers, True, OUT_SCHEMA)


def _read(lengths: np.ndarray, digest: bool):
    def run(batches):
        tab = table(lengths)
        for batch in batches:
            for blob in batch.column(0):
                start, ids, sizes, toks = read_container(blob.as_py(), tab)
                ends = np.cumsum(sizes, dtype=np.int64)
                toks = toks.astype("<u4")
                each = [toks[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                cols = [pa.array(ids, pa.int64(), mask=ids == _NULL_ID), pa.array(start + ends - sizes, pa.int64())]
                if digest:
                    cols += [pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([x.astype("i4") for x in each], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return run


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(encode(load(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json")))
