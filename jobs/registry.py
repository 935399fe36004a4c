"""The jobs as queries over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.operators import text_index
from symloom.plans import catalog
from symloom.plans.bridge import ORACLE
from symloom.sources.session import scratch

from . import code_report, index_documents


def job1_code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it stands after two runs into one folder."""
    out = scratch(spark, "job1")
    for _ in range(2):
        code_report.run(spark, sf_dir, out)
    return spark.read.parquet(f"{out}/symbols")


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that stand after two runs into one folder and checkpoint.

    The pattern serves a table of one file too: a stream takes no single file."""
    out = scratch(spark, "job2")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet*", f"{out}/index", f"{out}/checkpoint")
    return text_index.entries(spark, f"{out}/index").withColumnRenamed("doc", "doc_id")


QUERIES = {"job1_code_report": job1_code_report, "job2_index_documents": job2_index_documents}


def _part(name: str) -> str:
    """The statement of a registered query, without the common expressions."""
    return catalog.oracle_sql()[name].removeprefix(ORACLE).lstrip(" ,\n")


def _job1() -> str:
    fan, smells = _part("code_smells").split(") SELECT", 1)
    found = " UNION ALL ".join(f"SELECT type, severity, symbol FROM ({x})" for x in ("SELECT" + smells, *map(_part, ("hardcoded_secrets", "missing_auth", "command_injection"))))
    return ORACLE + f""", {fan}), issue AS MATERIALIZED (SELECT symbol, count(*) AS issues,
    max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS worst FROM ({found}) GROUP BY symbol),
up AS (SELECT dst AS node, src AS by FROM calls UNION SELECT a.dst, b.src FROM calls a JOIN calls b ON b.dst = a.src),
reached AS (SELECT node, count(*) AS impact FROM up GROUP BY node)
SELECT coalesce(language, 'unknown') AS language, split_part(fan.fqn, '::', 1) AS module, fan.fqn, kind, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out,
    CAST(coalesce(impact, 0) AS BIGINT) AS impact, CAST(n_out + 1 AS BIGINT) AS cyclomatic, n_out + 1 > 10 AS is_complex, CAST(coalesce(issues, 0) AS BIGINT) AS issues, CAST(coalesce(worst, 0) AS INTEGER) AS worst
FROM fan LEFT JOIN files f ON f.id = fan.file_id LEFT JOIN reached ON node = fqn LEFT JOIN issue ON symbol = fqn"""


_JOB2 = r"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS w FROM documents WHERE doc_id IS NOT NULL),
each AS (SELECT doc_id, CAST(len(w) AS INTEGER) AS dl, unnest(w) AS term FROM words)
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, dl FROM each GROUP BY term, doc_id, dl"""

ORACLES = {"job1_code_report": _job1(), "job2_index_documents": _JOB2}
