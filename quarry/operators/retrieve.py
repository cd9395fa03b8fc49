"""Term statistics, BM25, rank fusion and pools.

A pool has query_id, rank, chunk_id and score; ranks are explicit, and every
order ends in a key, because sorts aren't stable.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text as T
from .vectors import MAX_QUERIES

K1, B, TF_CAP, RRF_K = 1.5, 0.75, 65_535, 60


def ranked(pool: DataFrame, score: str, *ties: str, by: tuple[str, ...] = ("query_id",), limit: int | None = None) -> DataFrame:
    """pool with rank 1, 2, ... by score, highest first."""
    out = pool.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """key, term, tf, length, of the terms of ``only`` if given: others go before anything is counted or shuffled."""
    terms = docs.select(key, T.search_terms(F.col(text)).alias("w"))
    out = terms.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    out = out if only is None else out.join(only.select("term").distinct(), "term", "left_semi")
    return out.groupBy(key, "term").agg(F.least(F.count(F.lit(1)), F.lit(TF_CAP)).alias("tf"), F.first("length").alias("length"))


def _query_terms(queries: DataFrame) -> tuple[list, list[list[str]]]:
    """Ids and distinct terms of the queries, a bounded set."""
    found = queries.select("query_id", F.array_distinct(T.search_terms(F.col("text"))).alias("w")).limit(MAX_QUERIES + 1).collect()
    if len(found) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries at once; search the rest in another block")
    return [r["query_id"] for r in found], [r["w"] or [] for r in found]


def _occurrences(terms: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: row, number and frequency of the words that are in the vocabulary."""
    ids = pc.index_in(pc.list_flatten(terms), value_set=vocabulary)
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(terms).to_numpy()[known].astype(np.int64)
    cell, tf = np.unique(row * len(vocabulary) + ids.filter(pa.array(known)).to_numpy().astype(np.int64), return_counts=True)
    return cell // len(vocabulary), cell % len(vocabulary), np.minimum(tf, TF_CAP)


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, rank, key, score: Okapi BM25 of the distinct query terms.

    A document is scored where it is read: the queries' terms, a bounded set, go
    to every task, which keeps the k best of each query, and only those are
    shuffled.  One pass before that counts in how many documents each term is.
    """
    spark = docs.sparkSession
    ids, terms = _query_terms(queries)
    vocabulary = pa.array(sorted({t for w in terms for t in w}), pa.string())
    rows = docs.select(F.col(key).alias("key"), T.search_terms(F.col("text")).alias("w"))
    out = T_.StructType([T_.StructField("query_id", queries.schema["query_id"].dataType), T_.StructField(key, docs.schema[key].dataType), T_.StructField("score", T_.DoubleType())])
    if not len(vocabulary):
        return ranked(spark.createDataFrame([], out), "score", key, limit=k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            length += pc.sum(pc.list_value_length(batch.column("w"))).as_py() or 0
            df += np.bincount(_occurrences(batch.column("w"), vocabulary)[1], minlength=len(df))
        seen = np.flatnonzero(df)
        term = np.concatenate([[-2, -1], seen])  # documents, words, and each term's documents
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.concatenate([[n, length], df[seen]]), pa.int64())], ["term", "n"])

    counted = {r["term"]: r["n"] for r in rows.select("w").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, average = counted.get(-2, 0), counted.get(-1, 0) / max(1, counted.get(-2, 0))
    df = np.array([counted.get(i, 0) for i in range(len(vocabulary))], dtype=float)
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    pairs = sorted((number[t], q) for q, w in enumerate(terms) for t in w)
    asked_by = np.array([q for _, q in pairs], dtype=np.int64)
    begin = np.searchsorted(np.array([t for t, _ in pairs]), np.arange(len(vocabulary) + 1))
    arrow = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in ids]
        least = np.zeros(len(ids))  # of a query that has k already
        order = lambda x: (-x[0], x[1] is not None, x[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                row, term, tf = _occurrences(batch.column("w"), vocabulary)
                length = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False)
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / max(average, 1e-300)))
                times = begin[term + 1] - begin[term]
                places = np.repeat(begin[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                sums = np.bincount(asked_by[places] * batch.num_rows + np.repeat(row, times), weights=np.repeat(weight, times), minlength=len(ids) * batch.num_rows)
                sums = sums.round(6).reshape(len(ids), batch.num_rows)
                hit_q, hit_row = np.nonzero((sums > 0) & (sums >= least[:, None]))
                keys = batch.column("key").to_pylist()
                for q in np.unique(hit_q).tolist():
                    mine = hit_row[hit_q == q].tolist()
                    best[q] = heapq.nsmallest(k, best[q] + [(sums[q, i], keys[i]) for i in mine], key=order)
                    least[q] = best[q][-1][0] if len(best[q]) == k else 0
        flat = [(ids[q], x, float(s)) for q, found in enumerate(best) for s, x in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), arrow)], names=arrow.names)

    return ranked(rows.mapInArrow(score, out), "score", key, limit=k)


def rrf(lists: list[DataFrame], key: str = "chunk_id", k: int = RRF_K, weights: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """query_id, rank, key, score: reciprocal rank fusion; ties by where an item was seen first."""
    parts = [p.select("query_id", key, "rank", F.lit(i).alias("list"), F.lit((weights or [1] * len(lists))[i]).alias("w")) for i, p in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy("query_id", key).agg(F.round(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return ranked(fused, "score", "seen", key, limit=limit).drop("seen")


def rebuilt(fused: DataFrame, metadata: DataFrame, key: str, limit: int) -> DataFrame:
    """Fused items with their metadata; unknown ids go, ranks close up."""
    found = fused.join(metadata, key)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", again).where(F.col("rank") <= limit)


def union_pool(a: DataFrame, b: DataFrame, first: int, second: int) -> DataFrame:
    """The first list's best, then of the second list's best what is new; ``source`` 0 or 1."""
    both = a.where(F.col("rank") <= first).withColumn("source", F.lit(0)).unionByName(b.where(F.col("rank") <= second).withColumn("source", F.lit(1)))
    own = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("source"))
    kept = both.withColumn("_k", own).where("_k = 1").drop("_k")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "rank")))


def rescue(dense: DataFrame, lexical: DataFrame, n: int) -> DataFrame:
    """Up to n documents of the lexical list that the dense list lacks, by query."""
    new = lexical.join(dense.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return new.withColumn("rank", again).where(F.col("rank") <= n)


def pairs_reranked(pool: DataFrame, how: str = "replace", weight: float = 1.0) -> DataFrame:
    """Order by a cross score: alone, added, or added after min-max (a flat range counts 0.5)."""
    w = Window.partitionBy("query_id")
    low, high = F.min("cross").over(w), F.max("cross").over(w)
    scaled = F.when(high - low <= 1e-12, F.lit(0.5)).otherwise((F.col("cross") - low) / (high - low))
    total = {"replace": F.col("cross"), "add": F.col("score") + weight * F.col("cross"), "minmax": F.col("score") + weight * scaled}[how]
    return ranked(pool.withColumn("total", F.round(total, 9)), "total", "chunk_id")


def glossary_audit(docs: DataFrame, glossary: tuple[tuple[str, str], ...], group: str) -> DataFrame:
    """term, group, n_term, n_form: documents that have the term, and its form."""
    t, low = T.unaccent(F.col("text")), F.lower("text")
    marks = F.array(*(F.struct(F.lit(term).alias("term"), (F.instr(t, term) > 0).alias("a"), (F.instr(low, form) > 0).alias("b")) for term, form in glossary))
    rows = docs.select(group, F.inline(marks))
    return rows.groupBy("term", group).agg(F.count(F.when(F.col("a"), 1)).alias("n_term"), F.count(F.when(F.col("b"), 1)).alias("n_form"))


def topic_terms(docs: DataFrame) -> DataFrame:
    """topic, term, p: how much of a term's use is in a topic; languages weigh alike."""
    d = docs.select("topic", "lang", F.array_distinct(T.search_terms(F.col("text"))).alias("w"))
    n = d.groupBy("topic", "lang").agg(F.count(F.lit(1)).alias("n"))
    df = d.select("topic", "lang", F.explode("w").alias("term")).groupBy("topic", "lang", "term").agg(F.count(F.lit(1)).alias("df"))
    share = df.join(n, ["topic", "lang"]).groupBy("topic", "term").agg(F.sum(F.col("df") / F.col("n")).alias("share"))
    return share.withColumn("p", F.col("share") / F.sum("share").over(Window.partitionBy("term"))).select("topic", "term", "p")


def classify_topics(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, topic: the topic with most of the text's terms; null if none is known."""
    w = texts.select(key, F.explode(F.array_distinct(T.search_terms(F.col("text")))).alias("term"))
    s = w.join(terms, "term").groupBy(key, "topic").agg(F.round(F.sum("p"), 6).alias("score"))
    best = s.groupBy(key).agg(F.max_by("topic", F.struct("score", F.negative("topic"))).alias("topic"))
    return texts.select(key).join(best, key, "left")


def scaled(c: Column, by: str = "query_id", how: str = "minmax") -> Column:
    """Scores comparable across encoders, within each query; flat ranges give 0."""
    w = Window.partitionBy(by)
    if how == "minmax":
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise((c - low) / (high - low))
    if how == "zscore":
        sd = F.stddev_pop(c).over(w)
        return F.when(sd <= 1e-12, F.lit(0.0)).otherwise((c - F.avg(c).over(w)) / sd)
    if how == "robust":
        low, high = F.percentile(c, 0.05).over(w), F.percentile(c, 0.95).over(w)
        return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low))))
    raise ValueError(f"unknown scaling: {how}")


def rank_scaled(pool: DataFrame, score: str, key: str = "chunk_id") -> DataFrame:
    """1 for the best, 0 for the last; ties in order of the key."""
    w = Window.partitionBy("query_id")
    r = F.row_number().over(w.orderBy(F.desc(score), key)) - 1
    return pool.withColumn("scaled", 1 - r / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1))


def cascade(pool: DataFrame, weights: dict[str, float], how: str | None = "minmax") -> DataFrame:
    """pool with ``total`` and its rank: the primary's score and weighted scores of others (null counts 0 before scaling)."""
    parts = [(scaled(F.coalesce(F.col(c), F.lit(0.0)), how=how) if how else F.coalesce(F.col(c), F.lit(0.0))) * w for c, w in weights.items()]
    first = scaled(F.col("score"), how=how) if how else F.col("score")
    return ranked(pool.withColumn("total", F.round(reduce(lambda a, b: a + b, parts, first), 9)), "total", "chunk_id")


def funnel(pool: DataFrame, steps: list[tuple[str, float, int]]) -> DataFrame:
    """Encoders one after another: add a weighted score, keep the n best, go on."""
    p = pool.withColumn("total", F.col("score"))
    for column, weight, n in steps:
        p = ranked(p.withColumn("total", F.round(F.col("total") + weight * F.coalesce(F.col(column), F.lit(0.0)), 9)), "total", "chunk_id", limit=n)
    return p
