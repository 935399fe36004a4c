"""Queries with SQL, against that SQL: on the given tables and on odd rows."""

from __future__ import annotations

import duckdb
import pytest

from symloom.llm import registry

SF = "/root/testdata/sf0.001"
READS = {"op8_minhash": "documents", "op9_warc": "pages", "op11_centroids": "embeddings"}


def compare(spark, name, folder, files=""):
    con = duckdb.connect()
    con.sql(f"create view {READS[name]} as select * from read_parquet('{folder}/{READS[name]}.parquet{files}')")
    got, want = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    return len(rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, SF)


def test_odd_documents(spark, tmp_path):
    long = " ".join(f"w{i % 997} v{i % 31}" for i in range(4000))
    base = [f"t{i}" for i in range(60)]
    texts = [None, "", " \t\n", "One", "one", "a b", "A B", "a b a b", "É é", "é É", long, long.upper(), long + " end", *(" ".join([*base[:k], "X", *base[k:]]) for k in range(0, 60, 7)), " ".join(base)]
    spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, "op8_minhash", str(tmp_path), "/*.parquet") == len(texts)


def test_odd_pages(spark, tmp_path):
    pages = [(1, "u1", None), (2, "u2", ""), (3, None, "<p>a</p>"), (4, "u4", "<p>a</p>"), (5, "u5", "<p>é日\x00</p>"), (6, "u6", "x" * 300000), (7, "u7", "x" * 300000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert compare(spark, "op9_warc", str(tmp_path), "/*.parquet") == len(pages)
