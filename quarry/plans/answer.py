"""Questions to answers, and files to an index, as single plans.

``answer`` runs all queries together: one search, then everything is windows
over the query's pool.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import results as A
from ..operators import retrieve as R
from ..operators import vectors as V


@dataclass
class Settings:
    """The delivered configuration."""

    pool: int = 200
    weights: dict[str, float] = field(default_factory=lambda: {"second": 0.5, "third": 1.0})
    strategy: str = "top6"
    topic_share: float = A.TOPIC_SHARE
    recency_weight: float = 0.0
    documents: int = A.TOP_DOCS
    fragments: int = A.FRAGMENTS
    glossary: tuple[tuple[str, str], ...] = T.GLOSSARY


def offline(files: DataFrame, manifest: DataFrame, encoders: dict[str, V.Encoder], done: DataFrame | None = None) -> DataFrame:
    """Files (path, text) to chunks with a vector column for each encoder.

    Text is repaired and cleaned; ids come from the manifest, and files that it
    doesn't list, unsupported ones and those done before are left out.
    """
    rows = files.where(T.format_of(F.col("path")).isNotNull())
    rows = I.assign_ids(rows, manifest).join(manifest.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "doc_id")
    if done is not None:
        rows = I.not_done(rows, done, "doc_id")
    rows = rows.withColumn("text", T.clean_text(T.repair_breaks(F.col("text")))).where("text <> ''")
    about = rows.select("doc_id", T.detect_language(F.col("text")).alias("lang"), T.topic_of(F.col("path")).alias("topic"), T.file_name(F.col("path")).alias("source"), T.format_of(F.col("path")).alias("format"))
    tabular = rows.where(T.format_of(F.col("path")).isin("csv", "xlsx", "pbf"))
    prose = rows.join(tabular.select("doc_id"), "doc_id", "left_anti")
    blocks = C.blocks(tabular).select("doc_id", "pos", C.chunk_id(F.col("doc_id"), F.col("pos")).alias("chunk_id"), F.lit(None).cast("string").alias("section"), "text", T.word_count(F.col("text")).alias("num_tokens"))
    chunks = C.chunks(prose).unionByName(blocks).join(about, "doc_id")
    for name, encoder in encoders.items():
        chunks = V.encode(chunks, "text", encoder, name)
    return chunks


def answer(queries: DataFrame, chunks: DataFrame, primary: V.Encoder, others: dict[str, V.Encoder], edges: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """query_id, documents, fragments, incomplete for queries (ord, query_id, text).

    chunks has chunk_id, doc_id, text, lang, topic, source, ``embedding`` and a
    column of vectors for each of ``others``.  The queries are a bounded set.
    """
    s = settings or Settings()
    expanded = queries.withColumn("text", T.expand_query(F.col("text"), s.glossary))
    asked = expanded.select("query_id", "text", "ord").orderBy("ord").limit(V.MAX_QUERIES + 1).collect()
    texts = [r["text"] for r in asked]
    vectors = [(r["query_id"], v) for r, v in zip(asked, primary.encode_queries(texts))]
    keep = chunks.select("chunk_id", "doc_id", "text", "lang", "topic", "source", "embedding", *others)
    pool = V.search(keep, vectors, s.pool)
    for name, encoder in others.items():
        own = [(r["query_id"], [float(x) for x in v]) for r, v in zip(asked, np.asarray(encoder.encode_queries(texts)))]
        small = chunks.sparkSession.createDataFrame(own, "query_id string, _q array<double>")
        pool = pool.join(F.broadcast(small), "query_id").withColumn(name, V.dot(F.col(name), F.col("_q"))).drop("_q")
    pool = R.cascade(pool, {n: s.weights.get(n, 0.0) for n in others}) if others else pool.withColumn("total", F.col("score"))
    pool = pool.withColumn("score", F.col("total")).drop("total", *others)
    if edges is not None:
        entities = queries.select("query_id", F.explode(G.entities(F.col("text"))).alias("entity"))
        pool = G.break_ties(pool, G.evidence(edges, entities, s.pool)).withColumn("rank", F.col("new_rank")).drop("new_rank", "evidence")
    pool = pool.withColumn("reference_share", T.reference_share(F.col("text")))
    docs = A.documents(A.dominant_topic(pool, s.topic_share), s.strategy, s.documents)
    if s.recency_weight:
        dated = pool.groupBy("query_id", "doc_id").agg(F.max(T.year_of(F.col("source"))).alias("year"))
        recent = expanded.where(T.asks_for_recent(F.col("text"))).select("query_id").withColumn("_r", F.lit(True))
        docs = docs.join(dated, ["query_id", "doc_id"], "left").join(recent, "query_id", "left").withColumn("year", F.when(F.col("_r"), F.col("year"))).drop("_r")
        docs = A.recency(docs, s.recency_weight).drop("year")
    tokens = expanded.select("query_id", T.content_tokens(F.col("text")).alias("tokens"))
    ordered = A.ordered_fragments(pool, docs, tokens)
    pieces = ordered.select(*(c for c in ordered.columns if c != "text"), F.posexplode(C.split_long(F.col("text"))).alias("piece", "text"))
    fragments = A.take_fragments(pieces.withColumn("position", F.struct("position", "piece")), s.fragments)
    return A.result_objects(queries, docs, fragments)
