"""The registered queries of this folder: thin wrappers that read a table and apply one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_cnn, chat, decontaminate, html_tree, licenses, mixing, pitman_yor, quality_rules, repeats, simhash
from .common import documents



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": lambda spark, d: html_tree.op1(_table(spark, d, "pages")),
    "op2_quality": lambda spark, d: byte_cnn.op2(documents(spark, d), _table(spark, d, "labels")),
    "op3_chat": lambda spark, d: chat.op3(_table(spark, d, "conversations")),
    "op4_mixing": lambda spark, d: mixing.op4(documents(spark, d)),
    "op5_licenses": lambda spark, d: licenses.op5(documents(spark, d)),
    "op6_simhash": lambda spark, d: simhash.op6(documents(spark, d)),
    "op7_language_model": lambda spark, d: pitman_yor.op7(documents(spark, d)),
    "op8_decontaminate": lambda spark, d: decontaminate.op8(documents(spark, d), _table(spark, d, "benchmark")),
    "op9_repeats": lambda spark, d: repeats.op9(documents(spark, d)),
    "op10_quality_rules": lambda spark, d: quality_rules.op10(documents(spark, d)),
}

ORACLES: dict[str, str] = {"op3_chat": chat.OP3_SQL, "op4_mixing": mixing.OP4_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
