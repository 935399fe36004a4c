"""File summaries against counts by hand."""

from symloom.operators import stats


def test_file_summary_needs_no_distinct_rows_of_files_and_edges(spark):
    symbols = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("d", 3), ("e", 4)], "fqn string, file_id long")
    files = spark.createDataFrame([(i, f"f{i}") for i in (1, 2, 3, 4)], "id long, path string")
    # within a file, across, to a name of two files, to none, a loop, an end without a name
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "gone"), ("a", "a"), ("c", None)], "src string, dst string")
    found = {r["path"]: (r["symbol_count"], r["edge_count"]) for r in stats.file_summary(symbols, files, edges).collect()}
    assert found == {"f1": (2, 4), "f2": (2, 4), "f3": (1, 1), "f4": (1, 0)}
