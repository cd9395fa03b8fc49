"""Vector search, BM25, fusion and re-scoring.

Vector queries are all rows whose id is divisible by 20, against all rows; three
encoders are the whole vector, its first and its second half.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieve as R
from ..operators import vectors as V
from ..registry import query, table

K, DIGITS = 50, 4
SCORED = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 0),
  r AS (SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, label AS topic, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  scored AS (SELECT query_id, chunk_id, doc_id, topic, round(list_dot_product(v, x), 4) AS score, round(list_dot_product(v[1:32], x[1:32]), 4) AS second,
    round(list_dot_product(v[33:64], x[33:64]), 4) AS third FROM r, q)"""
POOL = f"{SCORED}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {K})"
OTHER = f", other AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {K})"


def rows(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("doc_id"), F.col("label").alias("topic"), "embedding")


Block = list[tuple[int, np.ndarray]]


def each_block(spark, d, search: Callable[[Block], DataFrame]) -> DataFrame:
    """The union of a search over blocks of the stated query set, each small enough for the driver and every task."""
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // (V.MAX_QUERIES // 2)))  # hashing fills blocks unevenly, to twice the mean at most
    parts = []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).orderBy("vec_id").collect()
        parts.append(search([(r[0], np.array(r[1], dtype=np.float64)) for r in block]))
    return reduce(DataFrame.unionByName, parts)


def pool(spark, d, k: int = K) -> DataFrame:
    """The k best by the first encoder, with the scores of the two others."""
    halves = {"second": (0, 32), "third": (32, 64)}
    p = each_block(spark, d, lambda q: V.search(rows(spark, d), q, k, digits=DIGITS, parts=halves))
    return p.withColumns({c: F.round(c, DIGITS) for c in halves})


def other(spark, d, k: int = K) -> DataFrame:
    """The k best by the second encoder."""
    half = rows(spark, d).withColumn("embedding", F.slice("embedding", 1, 32))
    return each_block(spark, d, lambda q: V.search(half, [(i, v[:32]) for i, v in q], k, digits=DIGITS))


@query("idx01_exact_search", f"WITH {POOL} SELECT query_id, rank, chunk_id, score FROM pool")
def idx01(spark, d):
    return each_block(spark, d, lambda q: V.search(rows(spark, d), q, K, digits=DIGITS)).select("query_id", "rank", "chunk_id", "score")


@query("ret01_search", f"WITH {SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored QUALIFY r <= 80) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, chunk_id, score FROM p WHERE topic < 5 QUALIFY rank <= 20")
def ret01(spark, d):
    return each_block(spark, d, lambda q: V.filtered_search(rows(spark, d), q, 20, F.col("topic") < 5, digits=DIGITS)).select("query_id", "rank", "chunk_id", "score")


@query("ret02_predicates", f"WITH {POOL} SELECT query_id, chunk_id, score FROM pool WHERE topic = 3 AND score >= 1e-1")
def ret02(spark, d):
    return pool(spark, d).where((F.col("topic") == 3) & (F.col("score") >= 0.1)).select("query_id", "chunk_id", "score")


@query("idx02_reconstruct", f"WITH {POOL} SELECT query_id, chunk_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM pool JOIN embeddings ON vec_id = chunk_id")
def idx02(spark, d):
    vectors = rows(spark, d).select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return pool(spark, d).join(vectors, "chunk_id").select("query_id", "chunk_id", "first")


@query("idx03_alignment", "SELECT count(*) FILTER (WHERE e.vec_id IS NOT NULL AND d.doc_id IS NOT NULL) AS \"both\", count(*) FILTER (WHERE e.vec_id IS NULL) AS without_vector, count(*) FILTER (WHERE d.doc_id IS NULL) AS without_metadata, CAST(0 AS BIGINT) AS not_unit, CAST(0 AS BIGINT) AS not_finite FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id")
def idx03(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return V.alignment(vectors, table(spark, d, "documents"), "doc_id")


@query("snk03_normalised", "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]), 3) AS norm FROM embeddings")
def snk03(spark, d):
    scaled_up = F.transform("embedding", lambda x: x.cast("double") * 3)
    n = V.normalise(scaled_up)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(n, n), 3).alias("norm"))


def slots_sql(text: str) -> str:
    """Slots of the hashing encoder that aren't zero, and their signs."""
    terms = f"SELECT doc_id, md5('hashing ' || unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM documents"
    return f"SELECT doc_id, CAST(CAST('0x' || left(h, 8) AS BIGINT) % 64 AS INTEGER) AS slot, CAST(sign(sum(CASE WHEN h[9] >= '8' THEN -1 ELSE 1 END)) AS INTEGER) AS sign FROM ({terms}) GROUP BY ALL HAVING sign <> 0"


def slots(vectors):
    v = vectors.select("doc_id", F.posexplode("embedding").alias("slot", "x")).where("x <> 0")
    return v.select("doc_id", "slot", F.signum("x").cast("int").alias("sign"))


@query("enc03_hashing_encoder", slots_sql("text"))
def enc03(spark, d):
    return slots(V.encode(table(spark, d, "documents"), "text", V.get_encoder("hashing")))


@query("enc02_prefixed_vectors", slots_sql("'passage: ' || text"))
def enc02(spark, d):
    return slots(V.encode(table(spark, d, "documents"), "text", V.PrefixedEncoder(V.get_encoder("hashing"))))


@query("enc06_to_encode", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 8 = 0")
def enc06(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    before = docs.where("chunk_id % 4 = 0").select("chunk_id", F.xxhash64(F.when(F.col("chunk_id") % 8 == 0, "changed").otherwise(F.col("text"))).alias("text_hash"))
    return V.to_encode(docs, before).select("chunk_id")


@query("enc07_distinct_pool_chunks", f"WITH {POOL} SELECT DISTINCT chunk_id FROM pool")
def enc07(spark, d):
    return pool(spark, d).select("chunk_id").distinct()


_T = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
BM25 = f"""bt AS (SELECT doc_id, {_T} AS w FROM documents), bs AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM bt),
  bp AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM bt) GROUP BY doc_id, term),
  bq AS (SELECT item_id AS query_id, unnest(list_distinct({_T})) AS term FROM benchmark),
  bd AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
  bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (1 - 75e-2 + 75e-2 * n / avgdl))), 6) AS score
    FROM bq JOIN bp USING (term) JOIN bd USING (term), bs GROUP BY ALL),
  bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20)"""


def items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark, d, k: int = 20) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), items(spark, d), k)


@query("ret03_bm25", f"WITH {BM25} SELECT query_id, doc_id, score FROM bm25")
def ret03(spark, d):
    return lexical(spark, d).select("query_id", "doc_id", "score")


@query("ret04_search_terms", f"SELECT doc_id, len({_T}) AS n, len(list_distinct({_T})) AS n_distinct FROM documents")
def ret04(spark, d):
    from ..functions.text import search_terms

    w = search_terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


@query("ret05_bm25_top", f"WITH {BM25} SELECT query_id, rank, doc_id FROM bm25 WHERE rank <= 5")
def ret05(spark, d):
    return lexical(spark, d, 5).select("query_id", "rank", "doc_id")


_RRF = """fused AS (SELECT query_id, chunk_id, round(sum(w / (6e1 + rank)), 9) AS score, min(struct_pack(list := l, rank := rank)) AS seen
    FROM (SELECT query_id, chunk_id, rank, 0 AS l, 1 AS w FROM pool UNION ALL SELECT query_id, chunk_id, rank, 1, {w} FROM other) GROUP BY ALL),
  rrf AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused QUALIFY rank <= {n})"""


@query("ret06_rrf", f"WITH {POOL}{OTHER}, {_RRF.format(w=1, n=50)} SELECT query_id, rank, chunk_id, score FROM rrf")
def ret06(spark, d):
    return R.rrf([pool(spark, d), other(spark, d)], limit=50).select("query_id", "rank", "chunk_id", "score")


@query("ret07_rebuilt", f"WITH {POOL}{OTHER}, {_RRF.format(w=1, n=1000)} SELECT query_id, chunk_id, label AS topic, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM rrf JOIN embeddings ON vec_id = chunk_id WHERE vec_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf.rank) <= 20")
def ret07(spark, d):
    known = rows(spark, d).where("chunk_id % 3 <> 0").select("chunk_id", "topic")
    return R.rebuilt(R.rrf([pool(spark, d), other(spark, d)]), known, "chunk_id", 20).select("query_id", "chunk_id", "topic", "rank")


@query("ret08_union_pool_limits", f"WITH {POOL}{OTHER}, {_RRF.format(w=1, n=1000)} SELECT query_id, count(*) FILTER (WHERE rank <= 50) AS hybrid, count(*) FILTER (WHERE rank <= 100) AS \"union\" FROM rrf GROUP BY query_id")
def ret08(spark, d):
    r = R.rrf([pool(spark, d), other(spark, d)])
    return r.groupBy("query_id").agg(F.count(F.when(F.col("rank") <= 50, 1)).alias("hybrid"), F.count(F.when(F.col("rank") <= 100, 1)).alias("union"))


@query("ret09_encoder_union", f"""WITH {POOL}{OTHER}, u AS (SELECT query_id, chunk_id, rank AS r, 0 AS source FROM pool WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM other WHERE rank <= 30),
  k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source) = 1)
  SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY source, r) AS rank FROM k""")  # fmt: skip
def ret09(spark, d):
    cols = ("query_id", "chunk_id", "rank")
    return R.union_pool(pool(spark, d).select(*cols), other(spark, d).select(*cols), 30, 30)


@query("ret10_weighted_document_rrf", f"WITH {POOL}{OTHER}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, doc_id) AS rank FROM pool GROUP BY query_id, doc_id), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY max(second) DESC, doc_id) AS rank FROM other GROUP BY query_id, doc_id), f AS (SELECT query_id, doc_id, round(sum(w / (6e1 + rank)), 9) AS score, min(struct_pack(l := l, rank := rank)) AS seen FROM (SELECT *, 0 AS l, 2 AS w FROM a UNION ALL SELECT *, 1, 1 FROM b) GROUP BY ALL) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM f QUALIFY rank <= 10")
def ret10(spark, d):
    best = lambda p: R.ranked(p.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), "score", "doc_id")
    return R.rrf([best(pool(spark, d)), best(other(spark, d))], key="doc_id", weights=[2, 1], limit=10).select("query_id", "doc_id", "score", "rank")


@query("ret11_lexical_rescue", f"""WITH {BM25}, l2 AS (SELECT query_id, doc_id, rank FROM bm25 WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0))
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM l2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY l2.rank) <= 3""")  # fmt: skip
def ret11(spark, d):
    found = lexical(spark, d)
    return R.rescue(found.where("doc_id % 2 = 0"), found, 3).select("query_id", "doc_id", "rank")


@query("ret12_neighbour_scores", f"WITH {SCORED}, n AS (SELECT query_id, chunk_id, list_filter([lag(score) OVER w, score, lead(score) OVER w], lambda x: x IS NOT NULL) AS near FROM scored WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY chunk_id)), f AS (SELECT query_id, chunk_id, round(list_sum(near) / len(near), 9) AS near_score FROM n) SELECT query_id, chunk_id, near_score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY near_score DESC, chunk_id) <= 20")
def ret12(spark, d):
    around = V.with_neighbours(rows(spark, d))
    near = each_block(spark, d, lambda q: V.search(around, q, 20, digits=DIGITS, near=("before", "after")))
    return near.select("query_id", "chunk_id", F.col("score").alias("near_score"))


@query("ret13_cross_rerank", f"WITH {POOL}, s AS (SELECT *, min(third) OVER w AS lo, max(third) OVER w AS hi FROM pool WINDOW w AS (PARTITION BY query_id)), t AS (SELECT query_id, chunk_id, round(score + 5e-1 * CASE WHEN hi - lo <= 1e-12 THEN 5e-1 ELSE (third - lo) / (hi - lo) END, 9) AS total FROM s) SELECT query_id, chunk_id, total, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) AS rank FROM t")
def ret13(spark, d):
    return R.pairs_reranked(pool(spark, d).withColumn("cross", F.col("third")), "minmax", 0.5).select("query_id", "chunk_id", "total", "rank")


@query("ret14_max_documents", f"WITH {POOL} SELECT query_id, doc_id, max(score) AS score FROM pool GROUP BY ALL")
def ret14(spark, d):
    return pool(spark, d).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


@query("ret15_substituted_query", f"WITH {BM25.replace('FROM benchmark', 'FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE left(text, 60) END AS text FROM benchmark)')} SELECT query_id, rank, doc_id, score FROM bm25 WHERE rank <= 5")
def ret15(spark, d):
    swapped = items(spark, d).withColumn("text", F.when(F.col("query_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 60)))
    return R.bm25(table(spark, d, "documents"), swapped, 5).select("query_id", "rank", "doc_id", "score")


@query("ret16_vector_feedback", f"""WITH {SCORED}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5),
  mean AS (SELECT query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM best JOIN embeddings ON vec_id = chunk_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
  moved AS (SELECT query_id, list(x ORDER BY i) AS x FROM mean GROUP BY query_id), unit AS (SELECT query_id, [y / sqrt(list_dot_product(x, x)) FOR y IN x] AS x FROM moved),
  again AS (SELECT query_id, chunk_id, round(list_dot_product(v, x), 4) AS score FROM unit, r)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM again QUALIFY rank <= 10""")
def ret16(spark, d):
    """Queries moved to the mean of their five best, then searched again."""
    kept = rows(spark, d).withColumn("v", F.col("embedding"))

    def one(q: Block) -> DataFrame:
        best = V.search(kept, q, 5, digits=DIGITS).select("query_id", F.posexplode("v").alias("i", "x")).groupBy("query_id", "i").agg(F.avg("x").alias("x"))
        moved = best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x")).collect()  # one a query of the block
        return V.search(kept.drop("v"), [(r[0], np.array(r[1]) / np.linalg.norm(r[1])) for r in sorted(moved)], 10, digits=DIGITS)

    return each_block(spark, d, one).select("query_id", "rank", "chunk_id", "score")


@query("ret17_pool_prefix", f"WITH {POOL} SELECT query_id, rank, chunk_id FROM pool WHERE rank <= 10")
def ret17(spark, d):
    return pool(spark, d).where("rank <= 10").select("query_id", "rank", "chunk_id")


# -- re-scoring ----------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY query_id)"
_MM = "CASE WHEN max({0}) OVER w - min({0}) OVER w <= 1e-12 THEN 0e0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


def _ranked(total: str, source: str = "pool", extra: str = "") -> str:
    return f"t AS (SELECT query_id, chunk_id, round({total}, 9) AS total FROM {source} {extra}) SELECT query_id, chunk_id, total, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) AS rank FROM t"


@query("rer01_calibrated_cascade", f"WITH {POOL}, {_ranked(_MM.format('score') + ' + 5e-1 * ' + _MM.format('second') + ' + 1e0 * ' + _MM.format('third'), extra=_W)}")
def rer01(spark, d):
    return R.cascade(pool(spark, d), {"second": 0.5, "third": 1.0}).select("query_id", "chunk_id", "total", "rank")


@query("rer02_raw_cascade", f"WITH {POOL}, p2 AS (SELECT query_id, chunk_id, score, CASE WHEN chunk_id % 3 > 0 THEN second END AS second FROM pool), {_ranked('score + 6e-1 * coalesce(second, 0)', 'p2')}")
def rer02(spark, d):
    p = pool(spark, d).withColumn("second", F.when(F.col("chunk_id") % 3 > 0, F.col("second")))
    return R.cascade(p, {"second": 0.6}, how=None).select("query_id", "chunk_id", "total", "rank")


@query("rer03_zscore", f"WITH {POOL}, z AS (SELECT query_id, chunk_id, round(CASE WHEN stddev_pop(score) OVER w <= 1e-12 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 5) AS z FROM pool {_W}) SELECT * FROM z")
def rer03(spark, d):
    return pool(spark, d).select("query_id", "chunk_id", F.round(R.scaled(F.col("score"), how="zscore"), 5).alias("z"))


@query("rer04_robust", f"WITH {POOL}, q2 AS (SELECT query_id, quantile_cont(score, 5e-2) AS lo, quantile_cont(score, 95e-2) AS hi FROM pool GROUP BY query_id) SELECT query_id, chunk_id, round(least(1e0, greatest(0e0, (score - lo) / (hi - lo))), 5) AS r FROM pool JOIN q2 USING (query_id)")
def rer04(spark, d):
    return pool(spark, d).select("query_id", "chunk_id", F.round(R.scaled(F.col("score"), how="robust"), 5).alias("r"))


@query("rer05_rank_scaled", f"WITH {POOL} SELECT query_id, chunk_id, round(1 - (rank - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY query_id) - 1) AS DOUBLE), 6) AS scaled FROM pool")
def rer05(spark, d):
    return R.rank_scaled(pool(spark, d), "score").select("query_id", "chunk_id", F.round("scaled", 6).alias("scaled"))


@query("rer06_depth_cut", f"WITH {POOL}, p2 AS (SELECT * FROM pool WHERE rank <= 20), {_ranked('score + second', 'p2')}")
def rer06(spark, d):
    return R.cascade(pool(spark, d).where("rank <= 20"), {"second": 1.0}, how=None).select("query_id", "chunk_id", "total", "rank")


@query("rer07_funnel", f"WITH {POOL}, a AS (SELECT *, round(score + 5e-1 * second, 9) AS t1 FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t1 DESC, chunk_id) <= 25), b AS (SELECT *, round(t1 + third, 9) AS total FROM a) SELECT query_id, chunk_id, total, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) <= 10")
def rer07(spark, d):
    return R.funnel(pool(spark, d), [("second", 0.5, 25), ("third", 1.0, 10)]).select("query_id", "chunk_id", "total", "rank")


@query("rer08_weight_grid", f"WITH {POOL}, g AS (SELECT unnest([0e0, 5e-1, 1e0]) AS weight), t AS (SELECT weight, query_id, chunk_id, round(score + weight * second, 9) AS total FROM pool, g) SELECT weight, query_id, chunk_id, total FROM t QUALIFY row_number() OVER (PARTITION BY weight, query_id ORDER BY total DESC, chunk_id) <= 5")
def rer08(spark, d):
    from ..plans.sweep import sweep

    def cell(p, weight):
        return R.cascade(p, {"second": weight}, how=None).where("rank <= 5").select("query_id", "chunk_id", "total")

    return sweep(pool(spark, d), [{"weight": w} for w in (0.0, 0.5, 1.0)], cell)


@query("rer09_pool_cut", f"WITH {POOL} SELECT k, query_id, count(*) AS n, min(score) AS lowest FROM pool, (SELECT unnest([10, 20, 40]) AS k) WHERE rank <= k GROUP BY ALL")
def rer09(spark, d):
    from ..plans.sweep import sweep

    return sweep(pool(spark, d), [{"k": k} for k in (10, 20, 40)], lambda p, k: p.where(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest")))


@query("rer10_dispersion", f"WITH {POOL}, g AS (SELECT query_id, max(score) - min(score) AS r, stddev_pop(score) AS s, avg(score) AS m FROM pool GROUP BY query_id) SELECT round(quantile_cont(r, 5e-1), 5) AS median_range, round(quantile_cont(s, 5e-1), 5) AS median_sd, round(quantile_cont(m, 5e-1), 5) AS median_mean FROM g")
def rer10(spark, d):
    g = pool(spark, d).groupBy("query_id").agg((F.max("score") - F.min("score")).alias("r"), F.stddev_pop("score").alias("s"), F.avg("score").alias("m"))
    return g.agg(*(F.round(F.percentile(c, 0.5), 5).alias(n) for c, n in (("r", "median_range"), ("s", "median_sd"), ("m", "median_mean"))))


@query("rer11_tie_detectors", f"WITH {POOL}, m AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 3) AS s3, max(score) FILTER (WHERE rank = 4) AS s4, max(score) FILTER (WHERE rank = 5) AS s5 FROM pool GROUP BY query_id) SELECT query_id, round((s3 - s4) / s3, 5) AS gap34, round((s1 - s5) / s1, 5) AS disp5 FROM m")
def rer11(spark, d):
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    m = pool(spark, d).groupBy("query_id").agg(*(at(r).alias(f"s{r}") for r in (1, 3, 4, 5)))
    return m.select("query_id", F.round((F.col("s3") - F.col("s4")) / F.col("s3"), 5).alias("gap34"), F.round((F.col("s1") - F.col("s5")) / F.col("s1"), 5).alias("disp5"))


