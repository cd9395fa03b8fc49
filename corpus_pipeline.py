"""A training corpus from documents: five stages, each one operator, each written and read again.

Quality rules drop documents that read badly, near copies are reduced to one of
each group, passages that an earlier document has are cut out, documents that
hold benchmark passages go, and what is left is mixed by source.

Null texts and texts of few words go with the first stage.  A null doc_id is a
document like any other: of a group of copies it goes rather than one with an
id, and it comes first where passages repeat.  Repeated rows are copies.  An
empty table gives an empty result.  Columns besides those of documents are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import Scratch
from quarry.llm.decontaminate import decontaminate
from quarry.llm.mixing import mix
from quarry.llm.quality_rules import keep_good
from quarry.llm.repeats import drop_repeats
from quarry.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", repeats),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: No SQL: the second and third stage work on hashes and suffix order that it can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: rows of documents, repeated as often as the mix takes them."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
