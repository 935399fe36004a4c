from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from symloom.llm import langid, packing, registry, tokens

from .test_near_duplicates import brute


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 13))


def test_stages_equal_plain_versions(spark, tmp_path):
    en, de = "the quick brown fox jumps over the lazy dog and runs far away from it", "der schnelle braune Fuchs springt über den faulen Hund und läuft davon"
    rows = [(i, (en if i % 2 else de) + f" number{i} und{i * 7} extra{i * 3} more{i} words{i} here{i} now{i}" * (1 + i % 3), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[3][1] + " tail", "en", "s", 1), (102, None, None, None, None), (103, "12 34 !!", "en", "s", 1), (104, en + " mail me at joe@x.org", "en", "s", 1), (40, rows[5][1], "en", "s", 1)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.language_id(spark, read, folder)
    assert one.columns == read.columns
    assert {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {102, 103}
    left = [(r.doc_id, r.text) for r in one.collect()]
    two = corpus_pipeline.near_dedup(spark, one, folder)
    want = {i for i, (_, c) in brute(left, 5).items() if i == c}
    assert sorted(r.doc_id for r in two.collect()) == sorted(want)
    three = corpus_pipeline.mask_pii(spark, two, folder)
    assert {r.doc_id: r.text for r in three.collect()}[104].endswith("mail me at [EMAIL]")
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} == want
    enc = tokens.pieces(tokens.public("byte_bpe_50k.json"))
    kept = {r.doc_id: r.text for r in three.collect()}
    for r in final:
        ids = np.frombuffer(enc.encode(kept[r.doc_id]), enc.dtype).astype("<u4").tolist() + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))
    assert max(r.offset + r.length for r in final) <= packing.WINDOW
    assert langid.BUCKETS == 1 << 16


def test_stages_on_odd_rows_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, __lang_pred string, __copy long, __kept string"
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(1, text, "en", "a", 2, "x"), (1, text, "en", "a", 1, "x"), (1, text, "en", None, 1, "x"), (None, text, "en", "a", 1, "x"), (None, text, "en", "a", 1, "x"), (2, "", None, None, None, None), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    one = corpus_pipeline.language_id(spark, docs, "")
    assert one.columns == docs.columns and sorted(one.collect(), key=str) == sorted(rows[:5], key=str)
    two = corpus_pipeline.near_dedup(spark, docs, "")
    assert two.columns == docs.columns and sorted(two.collect(), key=str) == sorted([rows[2], *rows[3:]], key=str)
    folder = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_registered_queries_equal_their_operators(spark, tmp_path):
    """Every registered query runs on a small table and gives a row a document or page, or its pieces."""
    folder = str(tmp_path)
    docs = [(i, f"A text, number {i}, of some few words for all. " * (1 + i % 5), "en" if i % 2 else "fr", "s", 1) for i in range(1, 30)] + [(50, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"u{i}", f"<article><p>Page, {i % 4}, of words.</p></article>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, [i / 7] * 64) for i in range(12)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    for name, query in registry.QUERIES.items():
        found = query(spark, folder).collect()
        key = {"op7_html": "page_id", "op9_warc": "page_id", "op11_centroids": "vec_id"}.get(name, "doc_id")
        want = set(range(12)) if key != "doc_id" else {r[0] for r in docs}
        assert {r[key] for r in found} == want, name
        assert name == "op6_packing" or len(found) == len(want), name


def test_stages_on_columns_of_any_name_and_type(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(1, text, "en", {"k": 2}, "x", 1), (1, text, "en", {"k": 1}, "y", 2), (2, text + " tail", "en", None, "z", 3), (None, text, "en", {}, None, None), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, a map<string,int>, `b.c` string, `rest``d` int")
    one = corpus_pipeline.language_id(spark, docs, "")
    assert one.columns == docs.columns and sorted(map(str, one.collect())) == sorted(map(str, docs.filter("text is not null").collect()))
    two = corpus_pipeline.near_dedup(spark, docs, "")
    assert two.columns == docs.columns
    assert sorted((r["doc_id"] or 0, str(r["a"]), r["b.c"], r["rest`d"]) for r in two.collect()) == [(0, "{}", None, None), (1, "{'k': 1}", "y", 2), (3, "None", None, None)]
    three = corpus_pipeline.mask_pii(spark, docs, "")
    assert three.columns == docs.columns and three.count() == len(rows)
    assert corpus_pipeline.pack(spark, docs, "").count() == len(rows)
