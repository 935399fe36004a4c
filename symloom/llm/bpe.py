"""BPE encoding and decoding through a table of distinct words.

Documents are split into blocks of about ``BLOCK_WORDS`` words.  A block is a
list of word numbers by position and a dictionary (number, word).  Only the
dictionaries are shuffled by word: sorted, they are the distinct-word table, in
which each distinct word of the corpus is encoded once.  Its ids are joined with
the (id, piece) table of the vocabulary, which gives the word's pieces; ids and
pieces go back to the numbers of every block that has the word, packed by block.
Joined with its numbers, a block's positions become ids and decoded text.  A word
occurs once a block there, so the most frequent word meets as many rows as there
are blocks, not occurrences.  What is broadcast is the (id, piece) table, of the
size of the vocabulary.

The documents are read twice, for the dictionaries and for the positions, and
must come in the same order: ``docs`` is a stored table or made from one without
a shuffle.  A checksum a block makes any difference an error.

Defined results: a null or empty text has no ids and decodes to the empty
string; equal rows give equal rows; other columns are ignored; a null id is
kept; a very long text is a block of its own; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import load, texts, tune

BLOCK_WORDS = 8_000_000
BLOCK_DISTINCT = 1 << 20
#: Dictionary entries a task packs at once.
PACK = 1 << 18
#: Stand between the pieces of a word, and between words; in no piece.
BETWEEN, AFTER = "\0", "\1"

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def split_words(enc: tokens.Pieces, text: str) -> list[str]:
    """The words BPE sees, in order; special tokens stand as words of their own."""
    words = enc.split(text)
    if words is not None:
        return words
    out, at = [], 0
    for m in [*enc.special.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        if part:
            norm = enc.lib.normalizer.normalize_str(part) if enc.lib.normalizer else part
            out += [norm[a:b] for _, (a, b) in enc.lib.pre_tokenizer.pre_tokenize_str(norm)]
        if m:
            out.append(m[0])
            at = m.end()
    return out


def encode_word(enc: tokens.Pieces, word: str) -> list[int]:
    """Ids of one split word, by the vocabulary's merges alone."""
    if enc.special.fullmatch(word):
        return [enc.lib.token_to_id(word)]
    return [t.id for t in enc.model.tokenize(tokens.byte_level(word))]


def _check(crcs: np.ndarray, numbers: np.ndarray) -> int:
    """A sum over a block's dictionary, in any order."""
    with np.errstate(over="ignore"):
        return int((crcs.astype(np.uint64) * (2 * numbers.astype(np.uint64) + 1)).sum(dtype=np.uint64).view(np.int64))


def _blocks(path: str, emit_words: bool):
    """Blocks of this partition: their dictionaries, or their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.pieces(path), TaskContext.get().partitionId()
        ids, lens, seqs, number, words, n = [], [], [], {}, 0, 0

        def flush():
            block = part << 32 | n
            if emit_words:
                yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(np.full(len(number), block)), pa.array(np.arange(len(number)), pa.int32())], ["word", "block", "no"])
            else:
                seq = np.concatenate(seqs) if seqs else np.zeros(0, "<u4")
                planes = zstandard.compress(seq.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)
                crcs = np.fromiter((zlib.crc32(w.encode()) for w in number), np.uint32, len(number))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([planes], pa.binary()), pa.array([_check(crcs, np.arange(len(crcs)))], pa.int64())], ["block", "doc_ids", "lengths", "seq", "check"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = split_words(enc, text)
                if emit_words:
                    for w in pieces:
                        if w not in number:
                            number[w] = len(number)
                else:
                    seqs.append(np.fromiter((number.setdefault(w, len(number)) for w in pieces), "<u4", len(pieces)))
                    ids.append(doc_id)
                    lens.append(len(pieces))
                words += len(pieces)
                if words >= BLOCK_WORDS or len(number) >= BLOCK_DISTINCT:
                    yield from flush()
                    ids, lens, seqs, number, words, n = [], [], [], {}, 0, n + 1
        if words or ids:
            yield from flush()

    return run


_ENTRY = np.dtype([("block", "<i8"), ("no", "<u4"), ("crc", "<u4")])
_ID = "id int, serial long, entries binary"
_NO_ID = -1


def _encode_words(path: str):
    """The distinct-word table, from rows ``(word, block, no)`` sorted by word:
    a row for each id of each distinct word; the first one holds the word's
    entries in the blocks' dictionaries.  A word without ids has ``_NO_ID``."""

    def run(batches):
        enc = tokens.pieces(path)
        ids, serials, entries, serial = [], [], [], 0
        word, blocks, numbers = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(serials, pa.int64()), pa.array(entries, pa.binary())], ["id", "serial", "entries"])

        def end():
            own = np.empty(len(blocks), _ENTRY)
            own["block"], own["no"], own["crc"] = blocks, numbers, zlib.crc32(word.encode())
            coded = encode_word(enc, word) or [_NO_ID]
            ids.extend(coded)
            serials.extend(range(serial, serial + len(coded)))
            entries.extend([own.tobytes(), *[None] * (len(coded) - 1)])
            return serial + len(coded)

        for batch in batches:
            for w, block, no in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if w != word:
                    if word is not None:
                        serial = end()
                    word, blocks, numbers = w, [], []
                blocks.append(block)
                numbers.append(no)
            if len(ids) >= PACK:
                yield flush()
                ids, serials, entries = [], [], []
        if word is not None:
            serial = end()
        if ids:
            yield flush()

    return run


def _pack_words(dtype: str):
    """Ids and pieces of each distinct word, packed by block, from the joined rows
    in their order."""

    def run(batches):
        held, expected = [], 0

        def flush(table: pa.Table):
            starts = np.flatnonzero(np.asarray(table.column("entries").is_valid()))
            ids = np.asarray(table.column("id"))
            piece = table.column("piece").to_pylist()
            ends = np.append(starts[1:], len(ids))
            raw = [x for x in table.column("entries").to_pylist() if x is not None]
            entries = np.frombuffer(b"".join(raw), _ENTRY)
            owner = np.repeat(np.arange(len(raw)), [len(x) // _ENTRY.itemsize for x in raw])
            coded = [ids[a:b][ids[a:b] != _NO_ID].astype(dtype).tobytes() for a, b in zip(starts, ends, strict=True)]
            text = [BETWEEN.join(piece[a:b]) if ids[a] != _NO_ID else "" for a, b in zip(starts, ends, strict=True)]
            order = np.argsort(entries["block"], kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(entries["block"][order])) + 1).tolist(), len(order)]
            width = np.dtype(dtype).itemsize
            for lo, hi in zip(edges, edges[1:], strict=False):
                own, words = entries[order[lo:hi]], owner[order[lo:hi]].tolist()
                each = [coded[w] for w in words]
                parts = [own["no"].tobytes(), np.array([len(x) // width for x in each], "<u4").tobytes(), b"".join(each), AFTER.join([text[w] for w in words]).encode()]
                yield (int(own["block"][0]), _check(own["crc"], own["no"]), *[zstandard.compress(x, 3) for x in parts])

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:2]] + [pa.array(c, pa.binary()) for c in cols[2:]], ["block", "check", "no", "n", "ids", "pieces"])

        for batch in batches:
            if not batch.num_rows:
                continue
            serial = np.asarray(batch.column("serial"))
            if serial[0] != expected or (np.diff(serial) != 1).any():
                raise ValueError("the join has changed the order of the words")
            expected = int(serial[-1]) + 1
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(np.asarray(table.column("entries").is_valid()))[-1])
                if last:
                    yield batch_of(list(flush(table.slice(0, last))))
                    held = table.slice(last).to_batches()
        if held:
            yield batch_of(list(flush(pa.Table.from_batches(held).combine_chunks())))

    return run


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """``(id, piece)`` of the whole vocabulary."""
    enc = tokens.pieces(tokenizer)
    table = [(i, enc.lib.id_to_token(i)) for i in range(enc.size)]
    if any(p is not None and (BETWEEN in p or AFTER in p) for _, p in table):
        raise ValueError("a piece of this vocabulary holds a separator")
    return spark.createDataFrame(table, "id int, piece string")


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a block: its documents, their word numbers by position, and the
    packed ids and pieces of the numbers.  ``per_document`` turns that into rows a
    document."""
    spark = docs.sparkSession
    tune(spark)
    rows = texts(docs)
    entries = rows.mapInArrow(_blocks(tokenizer, True), "word string, block long, no int")
    table = entries.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(tokenizer), _ID)
    joined = table.join(F.broadcast(piece_table(spark, tokenizer)), "id", "left").select("id", "serial", "entries", "piece")
    packed = joined.mapInArrow(_pack_words(tokens.pieces(tokenizer).dtype.str), "block long, check long, no binary, n binary, ids binary, pieces binary")
    words = packed.groupBy("block").agg(F.collect_list(F.struct("check", "no", "n", "ids", "pieces")).alias("words"))
    blocks = rows.mapInArrow(_blocks(tokenizer, False), "block long, doc_ids array<bigint>, lengths array<int>, seq binary, check long")
    return blocks.join(words, "block", "left").select("doc_ids", "lengths", "seq", "check", "words")


def _documents(path: str, digest: bool):
    def run(batches):
        enc = tokens.pieces(path)
        decoder = enc.lib.decoder
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lens, raw, check, packed = (batch.column(c)[row].as_py() for c in range(5))
                if (sum(p["check"] for p in packed or ()) - check) % (1 << 64):
                    raise ValueError("the documents came in another order when read again; store them first")
                seq = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)
                size = int(seq.max()) + 1 if len(seq) else 0
                of: list[list[int]] = [[]] * size
                pieces: list[str] = [""] * size
                for p in packed or ():
                    no, n, ids, text = (zstandard.decompress(p[c]) for c in ("no", "n", "ids", "pieces"))
                    flat, at = np.frombuffer(ids, enc.dtype).tolist(), 0
                    for k, n, t in zip(np.frombuffer(no, "<u4").tolist(), np.frombuffer(n, "<u4").tolist(), text.decode().split(AFTER), strict=True):
                        of[k], pieces[k] = flat[at : at + n], t
                        at += n
                count = np.array([len(x) for x in of], np.int64)
                if digest:
                    ids_of = [" ".join(map(str, x)).encode() for x in of]
                    text_of = [x.replace(BETWEEN, " ").encode() for x in pieces]
                out, at = [], 0
                for doc_id, n in zip(doc_ids, lens, strict=True):
                    own = seq[at : at + n]
                    at += n
                    each = count[own]
                    numbers = own.tolist() if each.all() else own[each > 0].tolist()
                    if digest and decoder is None:
                        out.append((doc_id, int(each.sum()), hashlib.sha256(b" ".join(map(ids_of.__getitem__, numbers))).hexdigest(), hashlib.sha256(b" ".join(map(text_of.__getitem__, numbers))).hexdigest()))
                    else:
                        ids = [i for k in numbers for i in of[k]]
                        found = BETWEEN.join([pieces[k] for k in numbers])
                        text = found.replace(BETWEEN, " ") if decoder is None else decoder.decode(found.split(BETWEEN)) if ids else ""
                        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digest else (doc_id, ids, text))
                    if len(out) >= 256:
                        yield _rows(out, digest)
                        out = []
                if out:
                    yield _rows(out, digest)

    return run


def _rows(out: list, digest: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    if digest:
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.string())], ["doc_id", "ids", "decoded"])


def per_document(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` from ``encode``'s blocks."""
    return blocks.mapInArrow(_documents(tokenizer, False), "doc_id long, ids array<int>, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.public("word_bpe_49k.json")
    return encode(load(spark, sf_dir, "documents"), path).mapInArrow(_documents(path, True), OUT)
