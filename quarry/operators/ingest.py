"""Identity, manifests, and what happens to text before it is chunked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def break_evidence(pairs: DataFrame, vocabulary: DataFrame, joined: Column, apart: Column) -> DataFrame:
    """left_half, right_half, joined, apart, sign: which form of a broken word the corpus uses; ties join, unseen pairs go."""
    keyed = pairs.withColumns({"kj": joined, "ka": apart})
    a, b = vocabulary.select(F.col("t").alias("kj"), F.col("n").alias("nj")), vocabulary.select(F.col("t").alias("ka"), F.col("n").alias("na"))
    counted = keyed.join(a, "kj", "left").join(b, "ka", "left").select("l", "r", F.coalesce("nj", F.lit(0)).alias("joined"), F.coalesce("na", F.lit(0)).alias("apart"))
    seen = counted.where(F.col("joined") + F.col("apart") > 0)
    return seen.select(F.col("l").alias("left_half"), F.col("r").alias("right_half"), "joined", "apart", F.when(F.col("joined") >= F.col("apart"), "").otherwise("-").alias("sign"))


def ambiguous_names(manifest: DataFrame) -> DataFrame:
    """Names that stand for more than one id."""
    return manifest.groupBy("name_norm").agg(F.countDistinct("id").alias("n")).where("n > 1")


def assign_ids(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, text, ...) with id: by path, else by a name that is unambiguous, else by content."""
    by_path = manifest.groupBy("path_norm").agg(F.min("id").alias("path_id"))
    names = manifest.groupBy("name_norm").agg(F.min("id").alias("name_id"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    keyed = files.withColumns({"path_norm": T.normal_path(F.col("path")), "name_norm": F.lower(T.file_name(F.col("path")))})
    found = keyed.join(by_path, "path_norm", "left").join(names, "name_norm", "left")
    return found.withColumn("id", F.coalesce("path_id", "name_id", T.content_id(F.col("text")))).drop("path_norm", "name_norm", "path_id", "name_id")


def not_done(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Resuming: rows whose keys aren't in ``done``."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")
