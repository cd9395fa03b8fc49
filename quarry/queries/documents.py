"""Topic filters and the way from chunks to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import results as A
from ..operators import retrieve as R
from ..registry import query
from .retrieval import POOL, pool

_VOTES = "v AS (SELECT query_id, topic, sum(greatest(score, 0)) AS s FROM pool WHERE topic IS NOT NULL GROUP BY ALL), g AS (SELECT query_id, arg_max(topic, struct_pack(s := s, t := -topic)) AS winner, max(s) / sum(s) AS share FROM v GROUP BY query_id)"


@query("agg18_pool_vote", f"WITH {POOL}, {_VOTES} SELECT query_id, winner AS topic, round(share, 5) AS share FROM g")
def agg18(spark, d):
    return A.topic_votes(pool(spark, d)).select("query_id", "topic", F.round("share", 5).alias("share"))


@query("agg01_dominant_topic", f"WITH {POOL}, {_VOTES} SELECT query_id, chunk_id FROM pool JOIN g USING (query_id) WHERE share < 3e-1 OR topic = winner")
def agg01(spark, d):
    return A.dominant_topic(pool(spark, d), 0.3).select("query_id", "chunk_id")


def _docs_sql(score: str, n: int = 3, source: str = "pool") -> str:
    return f"a AS (SELECT query_id, doc_id, round({score}, 9) AS score FROM {source} GROUP BY query_id, doc_id), docs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= {n})"


_TOPM = "m AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS r, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM pool)"
_PICK = "SELECT query_id, rank, doc_id, score FROM docs"

for _id, _name, _sql in (
    ("agg02_max", "max", _docs_sql("max(score)")), ("agg03_sum", "sum", _docs_sql("sum(score)")), ("agg04_mean", "mean", _docs_sql("avg(score)")),
    ("agg05_top2", "top2", f"{_TOPM}, {_docs_sql('sum(score) FILTER (WHERE r <= 2)', source='m')}"), ("agg05_top6", "top6", f"{_TOPM}, {_docs_sql('sum(score) FILTER (WHERE r <= 6)', source='m')}"),
):
    query(_id, f"WITH {POOL}, {_sql} {_PICK}")(lambda spark, d, s=_name: A.documents(pool(spark, d), s).select("query_id", "rank", "doc_id", "score"))


@query("agg07_top_documents", f"WITH {POOL}, {_docs_sql('max(score)', 10)} SELECT query_id, rank, doc_id FROM docs")
def agg07(spark, d):
    return A.documents(pool(spark, d), "max", 10).select("query_id", "rank", "doc_id")


@query("agg08_size_normalised", f"WITH {POOL}, {_TOPM}, {_docs_sql('sum(score) FILTER (WHERE r <= 6) / pow(max(n), 5e-1)', source='m')} {_PICK}")
def agg08(spark, d):
    return A.documents(pool(spark, d), "top6", alpha=0.5).select("query_id", "rank", "doc_id", "score")


@query("agg09_mean_of_top5", f"WITH {POOL}, {_TOPM}, {_docs_sql('avg(score) FILTER (WHERE r <= 5)', source='m')} {_PICK}")
def agg09(spark, d):
    p = R.ranked(pool(spark, d), "score", "chunk_id", by=("query_id", "doc_id"), limit=5)
    return A.documents(p, "mean").select("query_id", "rank", "doc_id", "score")


@query("agg10_document_quota", f"WITH {POOL}, {_TOPM}, {_docs_sql('sum(score) FILTER (WHERE r <= 6)', 2, 'm')}, b AS (SELECT query_id, doc_id, round(max(score), 9) AS score FROM pool GROUP BY ALL), c AS (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.doc_id) AS rank FROM b LEFT JOIN docs ON docs.query_id = b.query_id AND docs.doc_id = b.doc_id WHERE docs.doc_id IS NULL), u AS (SELECT query_id, doc_id, 0 AS part, rank FROM docs UNION ALL SELECT query_id, doc_id, 1, rank FROM c) SELECT query_id, doc_id, part, row_number() OVER (PARTITION BY query_id ORDER BY part, u.rank) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, u.rank) <= 3")
def agg10(spark, d):
    return A.quota_documents(pool(spark, d), 2).select("query_id", "doc_id", "part", "rank")


#: A share of bibliography for each chunk.
SHARE = "(chunk_id % 11) / 1e1"


def with_share(p):
    return p.withColumn("reference_share", (F.col("chunk_id") % 11) / 10.0)


@query("agg11_discounted", f"WITH {POOL}, p2 AS (SELECT query_id, doc_id, chunk_id, score * (1 - {SHARE}) AS score FROM pool), {_docs_sql('sum(score)', source='p2')} {_PICK}")
def agg11(spark, d):
    return A.documents(A.discounted(with_share(pool(spark, d))), "sum").select("query_id", "rank", "doc_id", "score")


@query("agg11_excluded", f"WITH {POOL}, p2 AS (SELECT * FROM pool WHERE NOT {SHARE} >= 6e-1), {_docs_sql('sum(score)', source='p2')} {_PICK}")
def agg11b(spark, d):
    return A.documents(A.discounted(with_share(pool(spark, d)), how="exclude"), "sum").select("query_id", "rank", "doc_id", "score")


_SAT = f"""{_docs_sql('sum(score)', 20)}, c AS (SELECT query_id, doc_id, count(*) AS chunks, max(score) AS best, CAST(max(CAST(topic = query_id % 10 AS INTEGER)) AS INTEGER) AS agrees FROM pool GROUP BY ALL),
  k AS (SELECT query_id, doc_id, rank, @KEY@ AS key, chunks >= 3 AS sat FROM docs JOIN c USING (query_id, doc_id)), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, rank) AS turn FROM k WHERE sat)"""
_MOVED = "SELECT a.query_id, a.doc_id, b.rank FROM s a JOIN s b ON a.query_id = b.query_id AND a.turn = b.place UNION ALL SELECT query_id, doc_id, rank FROM k WHERE NOT sat"


def saturation(p):
    """The twenty best documents with what the pool has of each: chunks, best score, and whether any has the query's topic."""
    own = p.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("best"), F.max((F.col("topic") == F.col("query_id") % 10).cast("int")).alias("agrees"))
    return A.documents(p, "sum", 20).join(own, ["query_id", "doc_id"])


@query("agg12_permute_saturated", f"WITH {POOL}, {_SAT.replace('@KEY@', 'best')} {_MOVED}")
def agg12(spark, d):
    return A.permute_saturated(saturation(pool(spark, d)), F.col("best"), 3).select("query_id", "doc_id", "rank")


@query("agg13_permute_by_overlap", f"WITH {POOL}, {_SAT.replace('@KEY@', 'agrees')} {_MOVED}")
def agg13(spark, d):
    return A.permute_saturated(saturation(pool(spark, d)), F.col("agrees"), 3).select("query_id", "doc_id", "rank")


@query("agg14_name_weight", f"WITH {POOL}, {_docs_sql('sum(score)', 20)}, t AS (SELECT query_id, doc_id, round(score + 3e-1 * (doc_id % 10) / 1e1, 9) AS score FROM docs) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM t")
def agg14(spark, d):
    docs = A.documents(pool(spark, d), "sum", 20).withColumn("score", F.round(F.col("score") + 0.3 * (F.col("doc_id") % 10) / 10.0, 9))
    return R.ranked(docs, "score", "doc_id").select("query_id", "doc_id", "score", "rank")


@query("agg15_ties_by_id", f"WITH {POOL}, t AS (SELECT query_id, chunk_id, round(score, 1) AS score FROM pool) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM t")
def agg15(spark, d):
    return R.ranked(pool(spark, d).withColumn("score", F.round("score", 1)), "score", "chunk_id").select("query_id", "chunk_id", "rank")


_YEAR = "CASE WHEN 1960 + doc_id % 90 BETWEEN 1990 AND 2026 THEN 1960 + doc_id % 90 END"


def report_year(key: str):
    """The year in the name of a file, some of them implausible."""
    return T.year_of(F.concat(F.lit("report-"), (1960 + F.col(key) % 90).cast("string"), F.lit("-final.pdf")))



@query("agg16_recency", f"WITH {POOL}, {_docs_sql('sum(score)')} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 2e-1 * CASE WHEN {_YEAR} IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, 1 - (2026 - {_YEAR}) / 36e0)) END, 9) DESC, docs.rank) AS rank FROM docs")
def agg16(spark, d):
    docs = A.documents(pool(spark, d), "sum").withColumn("year", report_year("doc_id"))
    return A.recency(docs, 0.2).select("query_id", "doc_id", "score", "rank")


@query("agg17_document_year", f"WITH {POOL} SELECT query_id, doc_id, max({_YEAR.replace('doc_id', 'chunk_id')}) AS year FROM pool GROUP BY ALL")
def agg17(spark, d):
    return pool(spark, d).groupBy("query_id", "doc_id").agg(F.max(report_year("chunk_id")).alias("year"))


@query("agg19_topic_veto", f"WITH {POOL}, {_VOTES} SELECT p.query_id, p.chunk_id FROM pool p JOIN g USING (query_id) WHERE share < 2e-1 OR winner <> p.query_id % 10 OR topic = winner")
def agg19(spark, d):
    """The filter only where another judge of the topic agrees."""
    p = pool(spark, d)
    v = A.topic_votes(p).select("query_id", F.col("topic").alias("winner"), "share")
    agreed = (F.col("share") >= 0.2) & (F.col("winner") == F.col("query_id") % 10)
    return p.join(v, "query_id").where(~agreed | (F.col("topic") == F.col("winner"))).select("query_id", "chunk_id")
