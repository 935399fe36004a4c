"""Cleaning and packing pipeline over ``documents``: see ``STAGES``.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from symloom.llm import langid, minhash, packing, pii, tokens
from symloom.llm.common import materialise, tune

#: Least language score of a document that stays.
LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go.

    A null or empty text, or one without a letter, has no language and goes; so
    do all if nothing is labelled.  A null label or id is learnt from or kept
    like any other.  Equal rows are judged alike, very long texts by all their words;
    other columns stay as they are; an empty table stays empty."""
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    return langid.keep_identified(docs, model, LANGUAGE_SCORE)


def is_ordered(kind: DataType) -> bool:
    """Whether Spark can compare values of the type."""
    if isinstance(kind, ArrayType):
        return is_ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(is_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType | VariantType)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): the smallest id.

    A document without words or with a null id is a group of its own; of rows
    equal in id and text one stays, with the smallest of the other columns, which may
    be of any type (those without an order count as JSON) and name.  Very long texts
    are compared whole.  An empty table stays empty."""
    kept = minhash.near_duplicates(docs, words=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    # the other columns under names of no meaning; maps and the like have no order but as JSON
    order = F.struct(F.lit(0), *[named[c] if is_ordered(docs.schema[c].dataType) else F.to_json(F.struct(named[c])) for c in others])
    left = docs.join(kept, "doc_id", "left_semi").select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[named[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"), order.alias("order"))
    # equal rows meet by partial aggregation, which the join's partitioning serves
    one = left.groupBy("doc_id", "text").agg(F.min_by("rest", "order").alias("rest"))
    one = one.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[f"c{others.index(c)}"].alias(c) for c in docs.columns])
    return one.unionByName(docs.filter("doc_id is null"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind.

    A null or empty text stays as it is, as do all other columns; equal rows stay
    equal; very long texts are searched whole; an empty table stays empty."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    A null or empty text is the end id alone; equal rows and null ids are packed
    like any others; very long texts are cut into windows; other columns are not
    read, whatever their names; an empty table gives no pieces."""
    return packing.pack(docs, tokens.public("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", mask_pii),
    ("packing", pack),
]

#: The stages need tokenisers, sketches and iteration, which SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
