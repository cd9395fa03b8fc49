"""JSON, tables, manifests, query files, and what is written back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields that carry links, not text.
LINK_FIELDS = ("url", "link", "links", "href", "image", "images", "thumbnail")
TEXT_FIELDS = ("title", "body_paragraphs", "body", "abstract")


#: What Windows-1252 has where Latin-1 has control characters.
_C1 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def first_text(*fields: Column) -> Column:
    """The first field that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(f), F.lit("")) for f in fields))


def json_text(rows: DataFrame, column: str) -> DataFrame:
    """``text``: title as a heading, then the list of paragraphs or the body or the abstract, then the other fields as ``key: value``."""
    j = F.col(column)
    get = lambda k: F.get_json_object(j, f"$.{k}")
    listed = F.array_join(F.from_json(get("body_paragraphs"), "array<string>"), "\n\n")
    body = first_text(listed, get("body"), get("abstract"))
    keys = F.filter(F.json_object_keys(j), lambda k: ~k.isin(*TEXT_FIELDS, *LINK_FIELDS))
    values = F.from_json(j, "map<string,string>")
    fields = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at(values, k))), "\n")
    title = F.concat(F.lit("# "), first_text(get("title")))
    return rows.withColumn("text", F.concat_ws("\n\n", title, body, F.nullif(fields, F.lit(""))))


def flat_fields(rows: DataFrame, column: str) -> DataFrame:
    """One row a field (key, value), links left out."""
    out = rows.withColumn("_m", F.from_json(column, "map<string,string>")).select("*", F.explode("_m").alias("key", "value"))
    return out.where(~F.col("key").isin(*LINK_FIELDS)).drop("_m")


def string_leaves(rows: DataFrame, column: str) -> DataFrame:
    """pos, leaf: all quoted values of a JSON text, in order, their escapes read; what can't be read stays as it is."""
    swap = lambda c, *pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    # escaped backslashes and quotes step aside for control characters, which JSON never has: a group in a loop would recurse once a character
    plain = swap(F.col(column), ("\\\\", "\x01"), ('\\"', "\x02"))
    found = F.regexp_extract_all(plain, F.lit('[:\\[,]\\s*"([^"]*+)"(?=\\s*[,}\\]])'), F.lit(1))
    read = lambda x: F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), 0)
    found = F.transform(F.transform(found, lambda x: swap(x, ("\x02", '\\"'), ("\x01", "\\\\"))), lambda x: F.coalesce(read(x), x))
    return rows.select("*", F.posexplode(found).alias("pos", "leaf"))


def first_rows(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each file."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def read_table(spark: SparkSession, path: str, sep: str = ",", rows: int = 500) -> DataFrame:
    """CSV files with a header, bad lines dropped, at most ``rows`` of each file, with ``text``."""
    t = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").csv(path)
    names = t.columns
    t = t.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_ord"))
    first = t.withColumn("_k", F.row_number().over(Window.partitionBy("_file").orderBy("_at", "_ord"))).where(F.col("_k") <= rows)
    return first.withColumn("text", row_text(first, names)).drop("_file", "_at", "_ord", "_k")


def row_text(rows: DataFrame, columns: list[str]) -> Column:
    """``column: value | column: value``, empty cells left out."""
    return F.concat_ws(" | ", *(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def distinct_features(rows: DataFrame, group: str, attributes: str, order: str) -> DataFrame:
    """Each distinct set of attributes of a layer once, with the first place where it stands."""
    return rows.groupBy(group, attributes).agg(F.min(order).alias("first_event"))


def _present(df: DataFrame, *names: str) -> Column:
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def canonical_queries(raw: DataFrame) -> DataFrame:
    """ord, query_id, text from a file with any of the accepted column names; blank queries go."""
    q = raw.select("ord", _present(raw, "query_id", "id").alias("query_id"), reduce(lambda a, b: F.coalesce(a, b), [F.col(c) for c in ("text", "query", "consulta") if c in raw.columns]).alias("text"))
    return q.where(F.trim("text") != "")


def canonical_manifest(raw: DataFrame) -> DataFrame:
    """ord, name, path, id."""
    return raw.select("ord", _present(raw, "name", "nombre").alias("name"), _present(raw, "path", "ruta").alias("path"), _present(raw, "doc_id", "id").alias("id"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of queries in file order; UTF-8 with or without a mark, else Windows-1252."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.translate(F.decode("content", "iso-8859-1"), _C1, _CP1252))
    lines = raw.select(F.posexplode(F.split(F.replace(utf8, F.lit("﻿"), F.lit("")), "\r?\n")).alias("ord", "line")).where(F.trim("line") != "")
    return canonical_queries(lines.select("ord", F.from_json("line", "query_id string, id string, text string, query string, consulta string").alias("j")).select("ord", "j.*"))


def patch_metadata(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Image rows renamed to the format that they were read from, rows without text added at the end."""
    renamed = rows.withColumn("format", F.when(F.col("format") == "img", "jpg").otherwise(F.col("format")))
    added = extra.withColumns({"format": F.lit("jpg"), "text": F.lit(""), "indexed": F.lit(False)})
    return renamed.unionByName(added, allowMissingColumns=True)


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that aren't are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def load_index(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Chunks with their vectors; refuses a table in which any is missing or of another length."""
    t = spark.read.parquet(path)
    bad = t.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).select("chunk_id").limit(3).collect()
    if bad:
        raise ValueError(f"vectors don't fit their chunks, such as {[r[0] for r in bad]}")
    return t


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """src, dst and the data fields of each edge by key; of a graph in parts, which aren't documents by themselves.

    The newer XML parser takes a file for one document and leaves it at the end of its first element.
    """
    e = spark.read.format("xml").option("rowTag", "edge").option("useLegacyXMLParser", True).schema("_source string, _target string, data array<struct<_VALUE string, _key string>>").load(path)
    return e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.map_from_entries(F.transform("data", lambda x: F.struct(x["_key"], x["_VALUE"]))).alias("fields"))


def read_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, content of all files below ``root`` with these suffixes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    return found.select("path", "content")
