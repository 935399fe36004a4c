from __future__ import annotations

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import bpe, packing, token_output, tokens

WORD, BYTE = tokens.public("word_bpe_49k.json"), tokens.public("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("'’“—€→😀日本 \n\t\x1c")), max_size=60))
def test_memoised_ids_equal_the_library(path, text):
    enc = tokens.pieces(path)
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_split_words_encode_like_the_text(text):
    enc = tokens.pieces(WORD)
    ids = [i for w in bpe.split_words(enc, text) for i in bpe.encode_word(enc, w)]
    assert ids == library(WORD).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 70))
def test_huffman_round_trip(ids, interval):
    counts = np.bincount(ids, minlength=301)
    lengths = token_output.code_lengths(counts)
    used = lengths[lengths > 0].astype(int)
    assert (2.0 ** -used).sum() <= 1 and used.max() <= token_output.MAX_LENGTH
    codes, _ = token_output.canonical(lengths)
    payload, marks = token_output.pack(np.array(ids), lengths, codes, interval)
    assert token_output.unpack(payload, marks, len(ids), interval, token_output.table(lengths)).tolist() == ids


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([2**i for i in range(30)], np.int64)
    limited = token_output.code_lengths(counts, 20)
    assert limited.max() == 20
    small = token_output.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 20)
    assert (small * np.array([5, 9, 12, 13, 16, 45])).sum() == 224  # the textbook optimum


def test_containers_hold_all_documents_in_order(docs, texts):
    made = token_output.encode(docs, WORD)
    stored = docs.sparkSession.read.parquet(os.path.dirname(made.inputFiles()[0]))  # the files are enough
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, list(r.ids)) for r in token_output.decode(stored).collect()))
    lib, start = library(WORD), 0
    want = []
    described = {r.start: r for r in token_output.describe(stored).collect()}
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i is not None, i or 0, start, ids))
        row = described[start]
        assert (row.doc_id, row.n_tokens, row.ids_crc32) == (i, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    assert got == want
    with pytest.raises(ValueError):
        token_output.decode(stored.filter("shard >= 0"))


def test_damaged_container_is_refused():
    lengths = token_output.code_lengths(np.array([3, 1, 1]))
    codes, _ = token_output.canonical(lengths)
    blob = token_output.write_container(0, np.array([7], "<i8").tobytes(), np.array([4], "<u4").tobytes(), np.array([0, 1, 2, 0]), lengths, codes)
    token_output.read_container(blob, token_output.table(lengths))
    with pytest.raises(ValueError):
        token_output.read_container(blob[:-1] + b"\xff", token_output.table(lengths))
    kept = token_output.write_table(lengths)
    assert (token_output.read_table(kept) == lengths).all()
    with pytest.raises((ValueError, zlib.error)):
        token_output.read_table(kept[:-1] + b"\xff")


def test_a_vocabulary_with_a_decoder(docs, texts):
    lib = library(BYTE)
    got = {(r.doc_id, r.decoded) for r in bpe.per_document(bpe.encode(docs, BYTE), BYTE).collect()}
    assert got == {(i, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in texts}


def test_blocks_read_differently_are_refused(spark, docs, monkeypatch):
    blocks = bpe.encode(docs, WORD)
    with pytest.raises(Exception, match="another order"):
        bpe.per_document(blocks.withColumn("check", blocks["check"] + 1), WORD).collect()


def test_distinct_word_table(docs, texts):
    lib = library(WORD)
    got = sorted((r.doc_id or -1, list(r.ids), r.decoded) for r in bpe.per_document(bpe.encode(docs, WORD), WORD).collect())
    want = []
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_packing_covers_every_id_once(docs, texts):
    rows = packing.pack(docs, BYTE).collect()
    lib, by = library(BYTE), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in {(i, t) for i, t in texts if i != 58}:
        ids, at = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert len(by[58]) >= 2
    seqs: dict[int, list] = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert sum(sum(n for _, n in p) < packing.WINDOW for p in seqs.values()) <= 1


def test_related_tails_meet_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    topics = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}zq{i * 31 + j}" for j in range(12)) for i in range(60)]
    rows = [(j * 60 + i, f"the text number {j} is about " + t) for i, t in enumerate(topics) for j in range(8)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTE).collect()
    held = {}
    for r in out:
        held.setdefault(r.doc_id % 60, set()).add(r.sequence_id >> 24)
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values()) and len({r.doc_id for r in out}) == 480
    shards = {}
    for r in out:
        shards.setdefault(r.sequence_id >> 24, set()).add(r.doc_id)
    assert len(shards) == 30 and all(len(x) == 16 for x in shards.values())
    assert sum(len(x) <= 2 for x in held.values()) >= 55


def test_equal_tails_part_into_bounded_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    out = packing.pack(spark.createDataFrame([(i, "all the same") for i in range(100)], "doc_id long, text string"), BYTE).collect()
    shards = {}
    for r in out:
        shards.setdefault(r.sequence_id >> 24, set()).add(r.doc_id)
    assert sorted(map(len, shards.values())) == [4, *[16] * 6]


def test_the_index_is_asked_until_a_window_is_full():
    copies = [np.array([1, 2], np.uint16)] * 100
    mixed = [x for i, c in enumerate(copies) for x in (c, np.array([1000 + 2 * i, 1001 + 2 * i], np.uint16))]
    assert sorted(d for d, _, _ in packing.fill(mixed, 200)[0]) == list(range(0, 200, 2))


def test_all_ids_of_the_seed_are_scored():
    seed = np.arange(40, dtype=np.uint16)
    rare = [np.array([i, 500 + i], np.uint16) for i in range(24)]
    common = [np.arange(24, 40, dtype=np.uint16)] * 3
    found = packing.Index([seed, *rare, *common]).neighbours(0, np.ones(28, bool))
    assert set(found[:4]) == {0, 25, 26, 27}


def test_index_returns_the_lexical_neighbour():
    docs = [np.array([1, 2, 3, 4]), np.array([9, 8, 7]), np.array([1, 2, 3, 5]), np.array([8, 20, 21])]
    index = packing.Index(docs)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    assert index.neighbours(1, np.array([True, False, True, True])).tolist() == [3]


def test_scores_are_plain_bm25():
    rng = random.Random(5)
    docs = [np.array([min(int(rng.expovariate(0.05)), 200) for _ in range(rng.randrange(1, 60))], np.uint16) for _ in range(120)]
    index, mean = packing.Index(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in set(d.tolist()) for d in docs) for t in range(201)}
    for q in range(0, 120, 7):
        found = index.scores(q)
        for d, doc in enumerate(docs):
            tf = {t: doc.tolist().count(t) for t in set(doc.tolist()) & set(docs[q].tolist())}
            want = sum(math.log1p((120 - df[t] + 0.5) / (df[t] + 0.5)) * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)) for t, n in tf.items() if df[t] > 1)
            assert d == q or found[d] == pytest.approx(want, rel=1e-4)


def test_empty_tables(no_docs):
    assert token_output.decode(token_output.encode(no_docs, WORD)).count() == 0
    assert bpe.per_document(bpe.encode(no_docs, WORD), WORD).count() == 0
    assert packing.pack(no_docs, BYTE).count() == 0


def test_digest_columns(spark, docs, texts):
    rows = {r.doc_id: r for r in bpe.encode(docs, WORD).mapInArrow(bpe._documents(WORD, True), bpe.OUT).collect()}
    lib = library(WORD)
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_new_piece_needs_no_array_of_its_own(monkeypatch):
    encoder = tokens.Pieces(tokens.public("byte_bpe_50k.json"))
    texts = ["plain words, 12 of them's", "tab\tand\x7f\x00 é  ñ\n x", "~!@ #"]
    want = [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]
    plain = lambda piece: piece.encode().decode("latin-1").translate(tokens._ALPHABET)
    assert all(tokens.byte_level(a + chr(i)) == plain(a + chr(i)) for i in range(384) for a in ("", " ", "b"))
    monkeypatch.setattr(tokens, "np", None)
    assert [np.frombuffer(encoder.encode(t), encoder.dtype).tolist() for t in texts] == want
