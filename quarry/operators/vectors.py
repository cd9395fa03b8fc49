"""Vectors: encoders, exact search, checks of what belongs together.

Search runs in blocks: the queries are a bounded set and go to every task, each
task multiplies its rows with them, some rows at a time, and keeps its best for
each query, and the tasks' best meet in one ranking by query.  No other row
pairs leave a task or stay in its memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that search fetches for each one it returns, so that filters leave enough.
OVERFETCH = 4
#: Most queries of one search: with 1,000 dimensions 80 MB of float64.
MAX_QUERIES = 10_000
#: Scores that a task has at once; bytes of rows that it holds; tasks, if there aren't more cores.
TILE, HELD, TASKS = 1 << 18, 64 << 20, 16


class Encoder(Protocol):
    """Texts to unit vectors; passages and queries may differ."""

    name: str
    dim: int

    def encode_passages(self, texts: list[str]) -> np.ndarray: ...
    def encode_queries(self, texts: list[str]) -> np.ndarray: ...
    def count_tokens(self, text: str) -> int: ...


_TERM = re.compile(r"\w+")


class HashingEncoder:
    """Signed feature hashing: every term adds or takes one in a slot of its hash, and the sum is scaled to length 1.

    Texts that share terms are close; another name is another space.  A text
    without terms, or whose terms cancel out, is the zero vector.
    """

    def __init__(self, name: str = "hashing", dim: int = 64) -> None:
        self.name, self.dim = name, dim

    def _slot(self, term: str) -> tuple[int, int]:
        digest = hashlib.md5(f"{self.name} {term}".encode()).hexdigest()
        return int(digest[:8], 16) % self.dim, -1 if digest[8] >= "8" else 1

    def encode_passages(self, texts: list[str]) -> np.ndarray:
        out, seen = np.zeros((len(texts), self.dim)), {}
        for row, text in zip(out, texts):
            for term in _TERM.findall(text.lower()):
                slot, sign = seen.get(term) or seen.setdefault(term, self._slot(term))
                row[slot] += sign
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32)

    encode_queries = encode_passages

    def count_tokens(self, text: str) -> int:
        return len(_TERM.findall(text))


class PrefixedEncoder:
    """An encoder that was trained with different prefixes for passages and queries."""

    def __init__(self, inner: Encoder, passage: str = "passage: ", query: str = "query: ") -> None:
        self.inner, self.name, self.dim, self.passage, self.query = inner, inner.name, inner.dim, passage, query

    def encode_passages(self, texts: list[str]) -> np.ndarray:
        return self.inner.encode_passages([self.passage + t for t in texts])

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        return self.inner.encode_queries([self.query + t for t in texts])

    def count_tokens(self, text: str) -> int:
        return self.inner.count_tokens(self.passage + text)


ENCODERS: dict[str, Encoder] = {}


def get_encoder(name: str) -> Encoder:
    """Registered encoders by name; unknown names are hashing encoders of that name."""
    return ENCODERS.setdefault(name, HashingEncoder(name))


def encode(rows: DataFrame, text: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    """rows with a vector column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            v = encoder.encode_passages([t or "" for t in b.column(text).to_pylist()])
            flat = pa.array(v.reshape(-1), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * encoder.dim), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


class _Best:
    """The k best rows of each query among those added, with what is needed of them; ties by key.

    ``least`` is a score that a query's k best reach in any case, so that lesser
    ones needn't be added.  It stays when rows are handed on.
    """

    def __init__(self, n_queries: int, k: int, key: str) -> None:
        self.k, self.key, self.limit = k, key, max(2 * n_queries * k, TILE)
        self.least = np.full(n_queries, -np.inf)
        self.clear()

    def clear(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_rows = self.n_found = self.bytes = 0

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, batch: pa.RecordBatch) -> None:
        used, place = np.unique(row, return_inverse=True)
        self.rows.append(batch.take(pa.array(used)))
        self.found.append((query.astype(np.int16), score, place + self.n_rows))  # MAX_QUERIES is below 2^15
        self.n_rows, self.n_found, self.bytes = self.n_rows + len(used), self.n_found + len(query), self.bytes + self.rows[-1].nbytes

    def full(self) -> bool:
        return self.n_found > self.limit or self.bytes > HELD

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table] | None:
        """Query, score and row of the k best, and the rows; nothing else is kept."""
        if not self.n_found:
            return None
        table = pa.Table.from_batches(self.rows).combine_chunks()
        query, score, row = (np.concatenate(x) for x in zip(*self.found))
        turn = np.empty(len(table), dtype=np.int64)
        turn[pc.sort_indices(table.column(self.key), null_placement="at_start").to_numpy()] = np.arange(len(table))
        value = np.where(np.isnan(score), np.inf, score)  # Spark and SQL have what isn't a number first
        order = np.lexsort((turn[row], -value, query))
        own = query[order]
        place = np.arange(len(own)) - np.searchsorted(own, np.arange(len(self.least)))[own]
        last = order[place == self.k - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], value[last])
        kept = order[place < self.k]
        used, row = np.unique(row[kept], return_inverse=True)
        query, score, table = query[kept], score[kept], table.take(pa.array(used)).combine_chunks()
        self.rows, self.found = table.to_batches(), [(query, score, row)]
        self.n_rows, self.n_found, self.bytes = len(table), len(query), table.nbytes
        return query, score, row, table


def search(rows: DataFrame, queries: list[tuple[object, np.ndarray]], k: int, key: str = "chunk_id", vector: str = "embedding", digits: int = 6, near: tuple[str, ...] = (), how: str = "mean", parts: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """query_id, rank, score and the other columns of ``rows`` for the k best of each query; ties by key, rows without a vector last.

    ``near`` names columns of further vectors, null where there is none: the score is then the mean or the maximum (``how``) of all.
    ``parts`` names columns for the products of a part (from, to) of the vectors, not rounded.

    A task scores a few rows at a time against all queries and drops what can't
    be among the k best, so its memory depends on the queries and k alone.  Few
    tasks, as each gives k rows a query to the shuffle.
    """
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries at once")
    ids, parts = [q for q, _ in queries], parts or {}
    matrix = np.array([v for _, v in queries], dtype=np.float64).reshape(len(queries), -1) if queries else np.zeros((0, 1))
    others = [c for c in rows.columns if c != vector and c not in near]
    held = [*others, vector] if parts else others
    rounding = 0.5001 * 10.0**-digits + 1e-8

    def dense(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row for each vector, zeros where there is none, and where there is one."""
        valid = v.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(v), matrix.shape[1]))
        if valid.any():
            out[valid] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
        return out, valid

    def scored(vectors: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and row of all that reach ``least``: only what may do so after rounding is rounded."""
        tiles = [matrix @ v.T for v, _ in vectors]
        mean = near and how != "max"
        if mean:
            count = np.sum([ok for _, ok in vectors], axis=0)
            rough = sum(tiles) / np.maximum(count, 1)
            rough[:, count == 0] = -np.inf
        else:
            for tile, (_, ok) in zip(tiles, vectors):
                tile[:, ~ok] = -np.inf
            rough = np.maximum.reduce(tiles) if near else tiles[0]
        floor = least.copy()
        floor[np.isfinite(least)] -= rounding + 1e-12 * np.abs(least[np.isfinite(least)])
        at = np.flatnonzero(~(rough < floor[:, None]))
        query, row = np.divmod(at, rough.shape[1])
        if mean:
            some = np.maximum(count, 1)[row]
            score = np.where(count[row] > 0, np.round(sum(np.round(t.reshape(-1)[at], digits) for t in tiles) / some, 9), -np.inf)
        else:
            score = np.round(rough.reshape(-1)[at], digits)
        good = ~(score < least[query])
        return query[good], score[good], row[good]

    def given(best: _Best) -> Iterator[pa.RecordBatch]:
        if (pruned := best.prune()) is None:
            return
        query, score, row, table = pruned
        for at in range(0, len(query), 8192):
            q, s, taken = query[at : at + 8192], score[at : at + 8192], table.take(pa.array(row[at : at + 8192])).combine_chunks()
            extra = []
            if parts:
                x, (v, ok) = matrix[q], dense(taken.column(vector).combine_chunks())
                for a, z in parts.values():
                    total = np.zeros(len(q))
                    for i in range(a, z):  # one after another, as ``dot`` does
                        total += v[:, i] * x[:, i]
                    extra.append(pa.array(total, mask=~ok))
            columns = [taken.column(c).combine_chunks() for c in others]
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(s, mask=np.isneginf(s)), *columns, *extra], ["query_id", "score", *others, *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = _Best(len(ids), k, key), max(1, TILE // max(1, len(ids)))
        for b in batches if ids else ():
            vectors = [dense(b.column(c)) for c in (*near[:1], vector, *near[1:])]
            own = pa.RecordBatch.from_arrays([b.column(c) for c in held], held)
            for at in range(0, b.num_rows, step):
                query, score, row = scored([(v[at : at + step], ok[at : at + step]) for v, ok in vectors], best.least)
                if len(query):
                    best.add(query, score, row, own.slice(at, step))
                if best.full():
                    best.prune()
                    if best.bytes > HELD // 2:
                        yield from given(best)
                        best.clear()
        yield from given(best)

    from pyspark.sql import types as T

    id_type = T.LongType() if all(isinstance(i, (int, np.integer)) for i in ids) else T.StringType()
    fields = [f for f in rows.schema.fields if f.name in others]
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("score", T.DoubleType()), *fields, *(T.StructField(p, T.DoubleType()) for p in parts)])
    local = rows.coalesce(max(TASKS, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def filtered_search(rows: DataFrame, queries: list[tuple[object, np.ndarray]], k: int, where: Column, key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """The k best after filters: fetches ``OVERFETCH`` times as many first, so that fewer than k may be left."""
    pool = search(rows, queries, OVERFETCH * k, key, digits=digits).where(where)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return pool.withColumn("rank", rank).where(F.col("rank") <= k)


def alignment(vectors: DataFrame, metadata: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """One row of counts: keys on both sides, on one only, vectors off unit length or not finite."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    v = vectors.select(key, norm.alias("norm")).withColumn("has_v", F.lit(True))
    m = metadata.select(key).withColumn("has_m", F.lit(True))
    count = lambda c: F.count(F.when(c, 1))
    return v.join(m, key, "full_outer").agg(
        count(F.col("has_v") & F.col("has_m")).alias("both"), count(F.col("has_v").isNull()).alias("without_vector"), count(F.col("has_m").isNull()).alias("without_metadata"),
        count(F.abs(F.col("norm") - 1) > 1e-3).alias("not_unit"), count(F.isnan("norm")).alias("not_finite"),
    )


def to_encode(chunks: DataFrame, encoded: DataFrame) -> DataFrame:
    """Chunks that are new or whose text has changed since they were encoded (chunk_id, text_hash)."""
    return chunks.withColumn("text_hash", F.xxhash64("text")).join(encoded.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")


def with_neighbours(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with the vectors of the chunks before and after in the document, as ``before`` and ``after``: for a search with ``near``."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    return rows.withColumns({"before": F.lag(vector).over(w), "after": F.lead(vector).over(w)})
