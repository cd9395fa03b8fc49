"""Fragments of BM25 results: chunks are the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import results as A
from ..operators import retrieve as R
from ..registry import query, table
from .chunk_sql import SPLIT, sentences_sql
from .retrieval import items
from .text import content_sql, words_sql

#: Lines as chunks, with a share of bibliography by position.
LINES = """ch AS (SELECT doc_id, lang, i - 1 AS pos, doc_id * 4294967296 + i - 1 AS chunk_id, string_split(text, chr(10))[i] AS text, (i % 7) / 7e0 AS reference_share
  FROM (SELECT doc_id, lang, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""
_T = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
POOL = f"""{LINES}, bt AS (SELECT chunk_id, {_T} AS w FROM ch), bs AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM bt),
  bp AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM bt) GROUP BY chunk_id, term),
  bq AS (SELECT item_id AS query_id, unnest(list_distinct({_T})) AS term FROM benchmark), bd AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
  bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (1 - 75e-2 + 75e-2 * n / avgdl))), 6) AS score
    FROM bq JOIN bp USING (term) JOIN bd USING (term), bs GROUP BY ALL),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 40) JOIN ch USING (chunk_id)),
  da AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM pool GROUP BY ALL), docs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM da QUALIFY rank <= 3)"""
ORDERED = f"""{POOL}, tk AS (SELECT item_id AS query_id, {content_sql('text')} AS tokens FROM benchmark),
  ok AS (SELECT p.*, CAST(NOT coalesce(lang IN ('es', 'en', 'pt'), false) AS INTEGER) AS unreadable, CAST(d.doc_id IS NULL AS INTEGER) AS outside, CAST(reference_share >= 6e-1 AS INTEGER) AS boilerplate,
    CASE WHEN len(tokens) > 0 THEN CAST(NOT list_has_any({content_sql('p.text')}, tokens) AS INTEGER) ELSE 1 END AS uncovered
    FROM pool p LEFT JOIN docs d ON d.query_id = p.query_id AND d.doc_id = p.doc_id LEFT JOIN tk ON tk.query_id = p.query_id),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY unreadable, outside, boilerplate, uncovered, rank) AS position FROM ok)"""
_KEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
TAKEN = f"{ORDERED}, u AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY position) = 1), taken AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS fragment FROM u QUALIFY fragment <= 10)"


def lines(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return x.select("doc_id", "lang", "pos", (F.col("doc_id") * 4294967296 + F.col("pos")).alias("chunk_id"), "text", (((F.col("pos") + 1) % 7) / 7.0).alias("reference_share"))


def pool(spark, d):
    """Forty lines a query; kept, because documents, order and checks all start from them."""
    ch = lines(spark, d)
    return R.bm25(ch, items(spark, d), 40, "chunk_id").join(ch, "chunk_id")


def top(p):
    return A.documents(p, "sum")


def tokens(spark, d):
    return items(spark, d).select("query_id", T.content_tokens(F.col("text")).alias("tokens"))


def ordered(spark, d):
    p = pool(spark, d)
    return A.ordered_fragments(p, top(p), tokens(spark, d))


@query("frg01_fragment_order", f"WITH {ORDERED} SELECT query_id, chunk_id, position, unreadable, outside, boilerplate, uncovered FROM ordered")
def frg01(spark, d):
    return ordered(spark, d).select("query_id", "chunk_id", "position", "unreadable", "outside", "boilerplate", "uncovered")


@query("frg02_readable_languages", "SELECT lang, coalesce(lang IN ('es', 'en', 'pt'), false) AS readable, count(*) AS n FROM documents GROUP BY ALL")
def frg02(spark, d):
    r = F.coalesce(F.col("lang").isin(*T.READABLE), F.lit(False)).alias("readable")
    return table(spark, d, "documents").groupBy("lang", r).agg(F.count(F.lit(1)).alias("n"))


@query("frg03_split_long", SPLIT)
def frg03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.split_long(F.col("text"))).alias("part", "text")).withColumn("n", T.word_count(F.col("text")))


@query("frg04_distinct_fragments", f"WITH {TAKEN} SELECT query_id, fragment, chunk_id FROM taken")
def frg04(spark, d):
    return A.take_fragments(ordered(spark, d)).select("query_id", "fragment", "chunk_id")


@query("frg05_aligned_quota", f"""WITH {ORDERED}, ua AS (SELECT o.* FROM ordered o SEMI JOIN docs USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY position) = 1),
  a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS f FROM ua QUALIFY f <= 6),
  ub AS (SELECT o.* FROM ordered o ANTI JOIN a USING (query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY position) = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS f FROM ub QUALIFY f <= 10),
  x AS (SELECT query_id, chunk_id, 0 AS part, f FROM a UNION ALL SELECT query_id, chunk_id, 1, f FROM b)
  SELECT query_id, chunk_id, part, row_number() OVER (PARTITION BY query_id ORDER BY part, f) AS fragment FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, f) <= 10""")  # fmt: skip
def frg05(spark, d):
    p = pool(spark, d)
    docs = top(p)
    return A.aligned_fragments(A.ordered_fragments(p, docs, tokens(spark, d)), docs, 6).select("query_id", "chunk_id", "part", "fragment")


@query("frg06_round_robin", f"WITH {ORDERED}, r AS (SELECT o.query_id, o.chunk_id, o.position, CAST(d.doc_id IS NULL AS INTEGER) AS out, (row_number() OVER (PARTITION BY o.query_id, o.doc_id ORDER BY o.position) - 1) // 2 AS rd FROM ordered o LEFT JOIN docs d ON d.query_id = o.query_id AND d.doc_id = o.doc_id) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY out, rd, position) AS turn FROM r")
def frg06(spark, d):
    p = pool(spark, d)
    docs = top(p)
    return A.round_robin(A.ordered_fragments(p, docs, tokens(spark, d)), docs, 2).select("query_id", "chunk_id", "turn")


@query("frg07_other_criteria", f"WITH {ORDERED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY uncovered, outside, pos, rank) AS position FROM ordered")
def frg07(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("query_id").orderBy("uncovered", "outside", "pos", "rank")
    return ordered(spark, d).select("query_id", "chunk_id", F.row_number().over(w).alias("position"))


@query("frg08_near_duplicate_replacement")
def frg08(spark, d):
    return A.without_near_duplicates(ordered(spark, d))


@query("frg09_extended_fragments", f"""WITH RECURSIVE {TAKEN}, nx AS (SELECT t.query_id, t.fragment, t.chunk_id, t.text, coalesce({sentences_sql('n.text')}, []) AS more, 0 AS i FROM taken t LEFT JOIN ch n ON n.doc_id = t.doc_id AND n.pos = t.pos + 1),
  ex AS (SELECT * FROM nx UNION ALL SELECT query_id, fragment, chunk_id, CASE WHEN NOT contains(text, more[i + 1]) AND len(regexp_split_to_array(text, '\\s+')) + len(regexp_split_to_array(more[i + 1], '\\s+')) <= 250 THEN text || ' ' || more[i + 1] ELSE text END, more, i + 1 FROM ex WHERE i < len(more))
  SELECT query_id, fragment, chunk_id, {words_sql('text')} AS n FROM ex WHERE i = len(more)""")
def frg09(spark, d):
    f = A.take_fragments(ordered(spark, d))
    return A.extended(f, lines(spark, d)).select("query_id", "fragment", "chunk_id", T.word_count(F.col("text")).alias("n"))


@query("frg10_answers", f"WITH {TAKEN} SELECT item_id AS query_id, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FROM docs WHERE docs.query_id = item_id) AS documents, (SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY fragment) FROM taken WHERE taken.query_id = item_id) AS fragments, coalesce((SELECT count(*) FROM docs WHERE docs.query_id = item_id), 0) < 3 AS incomplete FROM benchmark")
def frg10(spark, d):
    p = pool(spark, d)
    docs = top(p)
    out = A.result_objects(items(spark, d), docs, A.take_fragments(A.ordered_fragments(p, docs, tokens(spark, d))))
    ids = lambda c, k: F.array_join(F.transform(c, lambda x: x[k].cast("string")), ",")
    return out.select("query_id", ids("documents", "doc_id").alias("documents"), ids("fragments", "chunk_id").alias("fragments"), "incomplete")


@query("dgn11_fragment_audit", f"WITH {TAKEN}, w AS (SELECT {words_sql('text')} AS n, uncovered, unreadable FROM taken), o AS (SELECT *, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS k FROM w) SELECT max(n) FILTER (WHERE r <= greatest(1, CAST(ceil(k * 5e-1) AS BIGINT))) AS p50, max(n) FILTER (WHERE r <= greatest(1, CAST(ceil(k * 9e-1) AS BIGINT))) AS p90, max(n) AS most, count(*) FILTER (WHERE uncovered = 1) AS uncovered, count(*) FILTER (WHERE unreadable = 1) AS unreadable, count(*) FILTER (WHERE n > 250) AS too_long FROM o")
def dgn11(spark, d):
    from ..operators.evaluate import fragment_audit

    return fragment_audit(A.take_fragments(ordered(spark, d)))


@query("dgn13_document_spread", f"WITH {TAKEN}, g AS (SELECT query_id, doc_id, count(*) AS n FROM taken GROUP BY ALL), h AS (SELECT query_id, count(*) AS k, max(n) AS m FROM g GROUP BY query_id) SELECT round(avg(k), 6) AS mean_documents, max(m) AS most, quantile_cont(m, 5e-1) AS median_most FROM h")
def dgn13(spark, d):
    from ..operators.evaluate import spread

    return spread(A.take_fragments(ordered(spark, d)))


@query("dgn14_unreadable_fragments", f"WITH {TAKEN} SELECT query_id, count(*) FILTER (WHERE unreadable = 1) AS n FROM taken GROUP BY query_id")
def dgn14(spark, d):
    return A.take_fragments(ordered(spark, d)).groupBy("query_id").agg(F.count(F.when(F.col("unreadable") == 1, 1)).alias("n"))


@query("dgn09_order_inversions", f"WITH {TAKEN} SELECT a.query_id, count(*) AS inversions FROM taken a JOIN taken b ON a.query_id = b.query_id AND a.fragment < b.fragment AND a.rank > b.rank GROUP BY a.query_id")
def dgn09(spark, d):
    from ..operators.evaluate import inversions

    return inversions(A.take_fragments(ordered(spark, d)))


@query("dgn17_order_counters", f"WITH {TAKEN} SELECT sum(outside) AS outside, sum(boilerplate) AS boilerplate, sum(uncovered) AS uncovered, sum(unreadable) AS unreadable FROM taken")
def dgn17(spark, d):
    t = A.take_fragments(ordered(spark, d))
    return t.agg(*(F.sum(c).alias(c) for c in ("outside", "boilerplate", "uncovered", "unreadable")))


@query("qry16_neighbour_ids", f"WITH {LINES} SELECT a.chunk_id, n.chunk_id AS next_id, p.chunk_id AS previous_id FROM ch a LEFT JOIN ch n ON n.doc_id = a.doc_id AND n.pos = a.pos + 1 LEFT JOIN ch p ON p.doc_id = a.doc_id AND p.pos = a.pos - 1")
def qry16(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines(spark, d).select("chunk_id", F.lead("chunk_id").over(w).alias("next_id"), F.lag("chunk_id").over(w).alias("previous_id"))


@query("ann06_window_around_best", f"WITH {POOL}, b AS (SELECT query_id, doc_id, arg_min(pos, rank) AS best FROM pool GROUP BY ALL) SELECT query_id, doc_id, ch.pos FROM b JOIN ch USING (doc_id) WHERE ch.pos BETWEEN best - 1 AND best + 1")
def ann06(spark, d):
    best = pool(spark, d).groupBy("query_id", "doc_id").agg(F.min_by("pos", "rank").alias("best"))
    return best.join(lines(spark, d).select("doc_id", "pos"), "doc_id").where(F.col("pos").between(F.col("best") - 1, F.col("best") + 1)).select("query_id", "doc_id", "pos")


@query("snk04_result_lines", f"""WITH {TAKEN}, dd AS (SELECT query_id, string_agg('{{"rank":' || CAST(rank AS VARCHAR) || ',"doc_id":' || CAST(doc_id AS VARCHAR) || '}}', ',' ORDER BY rank) AS x FROM docs GROUP BY 1)
  SELECT item_id AS query_id, '{{"query_id":' || CAST(item_id AS VARCHAR) || ',"documents":[' || x || ']}}' AS line FROM benchmark JOIN dd ON dd.query_id = item_id""")  # fmt: skip
def snk04(spark, d):
    p = pool(spark, d)
    out = A.result_objects(items(spark, d), top(p), A.take_fragments(ordered(spark, d)))
    return out.where(F.col("documents").isNotNull()).select("query_id", F.to_json(F.struct("query_id", "documents")).alias("line"))
