"""Metrics, diagnoses and validation.

Relevance: a document is relevant to a benchmark item if it holds the item's
whole text.  Results are BM25's.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..registry import query, table
from .fragments import TAKEN, ordered, pool, top
from .retrieval import BM25, items, lexical
from .text import signs_sql, words_sql

QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_F1 = """rel AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY 1),
  top AS (SELECT DISTINCT query_id, doc_id FROM res WHERE rank <= 3), got AS (SELECT query_id, count(*) AS returned FROM top GROUP BY 1),
  hit AS (SELECT query_id, count(*) AS hits FROM top JOIN qrels USING (query_id, doc_id) GROUP BY 1),
  s AS (SELECT query_id, relevant, coalesce(returned, 0) AS returned, coalesce(hits, 0) AS hits FROM rel LEFT JOIN got USING (query_id) LEFT JOIN hit USING (query_id)),
  pr AS (SELECT query_id, CASE WHEN returned > 0 THEN hits / CAST(returned AS DOUBLE) ELSE 0e0 END AS p, CASE WHEN returned > 0 THEN hits / CAST(least(relevant, returned) AS DOUBLE) ELSE 0e0 END AS r FROM s),
  f1 AS (SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 6) AS f1 FROM pr)"""
RES = f"{BM25}, {QRELS}, res AS (SELECT query_id, doc_id, rank FROM bm25)"
#: A second system: the first one's ranks three to eight.
ALT = "SELECT query_id, doc_id, rank - 2 AS rank FROM bm25 WHERE rank BETWEEN 3 AND 8"


def qrels(spark, d):
    """Documents that hold an item's text.

    Candidates for items of four words or more share their second and third word, which are whole in any document; all
    shorter items, as one row, are looked for in each document.
    """
    item = items(spark, d).select("query_id", F.col("text").alias("item"), F.split("text", " ").alias("w"))
    long = item.where(F.size("w") > 3).withColumn("pair", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2))))
    docs = table(spark, d, "documents").select("doc_id", "text")
    shared = docs.select("doc_id", F.explode(T.word_pairs(F.col("text"))).alias("pair")).join(long.select("query_id", "pair"), "pair").select("doc_id", "query_id")
    found = shared.distinct().join(long, "query_id").join(docs, "doc_id").where(F.contains("text", F.col("item"))).select("query_id", "doc_id")
    short = item.where(F.size("w") <= 3).agg(F.collect_list(F.struct("query_id", "item")).alias("short"))
    held = F.filter("short", lambda x: F.contains("text", x["item"]))
    return found.unionByName(docs.crossJoin(F.broadcast(short)).select(F.explode(held).alias("x"), "doc_id").select("x.query_id", "doc_id"))


def results(spark, d):
    return lexical(spark, d).select("query_id", "doc_id", "rank")


def alternative(r):
    return r.where("rank BETWEEN 3 AND 8").withColumn("rank", F.col("rank") - 2)


@query("evl01_f1", f"WITH {RES}, {_F1} SELECT * FROM f1")
def evl01(spark, d):
    return E.scores(results(spark, d), qrels(spark, d))


_IDEAL = repr(E.IDEAL)
_DCG = f"n AS (SELECT r.query_id, sum((@G@) / log2(r.rank + 1)) AS dcg FROM res r JOIN qrels USING (query_id, doc_id) WHERE r.rank <= 10 GROUP BY 1), nd AS (SELECT query_id, round(coalesce(dcg, 0) / {_IDEAL}, 6) AS ndcg FROM (SELECT DISTINCT query_id FROM qrels) LEFT JOIN n USING (query_id))"


@query("evl02_ndcg", f"WITH {RES}, {_DCG.replace("@G@", "1e0")} SELECT * FROM nd")
def evl02(spark, d):
    return E.ndcg(results(spark, d), qrels(spark, d))


@query("evl03_penalised_ndcg", f"WITH {RES}, {_DCG.replace("@G@", "1 - (doc_id % 5) / 1e1")} SELECT * FROM nd")
def evl03(spark, d):
    return E.ndcg(results(spark, d), qrels(spark, d), 1 - (F.col("doc_id") % 5) / 10.0)


@query("evl04_graded_ndcg", f"WITH {RES}, g AS (SELECT query_id, rank, CASE WHEN doc_id % 4 < 3 THEN doc_id % 3 ELSE 0 END AS grade FROM res WHERE rank <= 10) SELECT query_id, round(sum(grade / 2e0 / log2(rank + 1)) / {_IDEAL}, 6) AS ndcg FROM g GROUP BY query_id")
def evl04(spark, d):
    r = results(spark, d).withColumn("chunk_id", F.col("doc_id"))
    grades = r.where("doc_id % 4 < 3").select("query_id", "chunk_id", (F.col("doc_id") % 3).alias("grade"))
    return E.graded_ndcg(r, grades)


@query("evl05_f1_ceiling", "SELECT l_linenumber AS n, round(2 * (least(l_linenumber, 3) / 3e0) / (least(l_linenumber, 3) / 3e0 + 1), 6) AS ceiling FROM lineitem GROUP BY 1")
def evl05(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return n.select("n", F.round(E.f1_ceiling(F.col("n")), 6).alias("ceiling"))


@query("evl07_verdict", "SELECT event_id, CASE WHEN value - 30 > -2e-2 THEN 'adopt' WHEN value - 20 < 0 THEN 'discard' ELSE 'undecided' END AS verdict FROM events")
def evl07(spark, d):
    return table(spark, d, "events").select("event_id", E.verdict(F.col("value") - 30, F.col("value") - 20).alias("verdict"))


_PAIR = f"WITH {RES}, {_F1}, f1a AS (SELECT * FROM f1), @B@ w AS (SELECT query_id, f1a.f1 - f1b.f1 AS delta FROM f1a JOIN f1b USING (query_id))"
_ALTF1 = _F1.replace("res WHERE", f"({ALT}) WHERE").replace("rel AS", "rel2 AS").replace("top AS", "top2 AS").replace("got AS", "got2 AS").replace("hit AS", "hit2 AS").replace("  s AS", "  s2 AS").replace("pr AS", "pr2 AS").replace("f1 AS (SELECT query_id, round", "f1b AS (SELECT query_id, round")
_ALTF1 = _ALTF1.replace("FROM top GROUP", "FROM top2 GROUP").replace("FROM top JOIN", "FROM top2 JOIN").replace("FROM rel LEFT JOIN got USING (query_id) LEFT JOIN hit ", "FROM rel2 LEFT JOIN got2 USING (query_id) LEFT JOIN hit2 ").replace("AS r FROM s)", "AS r FROM s2)").replace("AS f1 FROM pr)", "AS f1 FROM pr2)")


@query("evl08_sign_test", _PAIR.replace("@B@", _ALTF1 + ",") + ", k AS (SELECT count(*) FILTER (WHERE delta > 1e-9) AS w, count(*) FILTER (WHERE delta < -1e-9) AS l FROM w) SELECT w AS wins, l AS losses, CASE WHEN w + l = 0 THEN 1e0 ELSE round(least(1e0, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2e0))) FROM (SELECT unnest(generate_series(0, least(w, l))) AS i))), 6) END AS p FROM k")
def evl08(spark, d):
    r, q = results(spark, d), qrels(spark, d)
    k = E.wins(E.paired(E.scores(alternative(r), q), E.scores(r, q), "f1"))
    return k.select("wins", "losses", F.round(E.sign_test_column(F.col("wins"), F.col("losses")), 6).alias("p"))


#: A query's weight in a round is Poisson's: how many of these sums its hash is above.
_CUTS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]
_WEIGHT = " + ".join(f"CAST(u > {c:.17e} AS INTEGER)" for c in _CUTS)
_ROUNDS = f"""h AS (SELECT delta, round, (CAST('0x' || left(md5(query_id || ' ' || round), 5) AS BIGINT) + 5e-1) / 1048576 AS u FROM w, (SELECT unnest(range(1, 10001)) AS round)),
  m AS (SELECT round, sum(delta * ({_WEIGHT})) / greatest(sum({_WEIGHT}), 1) AS m FROM h GROUP BY round)"""


@query("evl06_bootstrap", _PAIR.replace("@B@", _ALTF1 + ",") + f", {_ROUNDS} SELECT round(quantile_cont(m, 5e-2), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 95e-2), 6) AS high FROM m")
def evl06(spark, d):
    r, q = results(spark, d), qrels(spark, d)
    return E.bootstrap_frame(E.paired(E.scores(alternative(r), q), E.scores(r, q), "f1"))


@query("evl09_wins", _PAIR.replace("@B@", _ALTF1 + ",") + " SELECT count(*) FILTER (WHERE delta > 1e-9) AS wins, count(*) FILTER (WHERE delta < -1e-9) AS losses, count(*) FILTER (WHERE abs(delta) <= 1e-9) AS ties FROM w")
def evl09(spark, d):
    r, q = results(spark, d), qrels(spark, d)
    return E.wins(E.paired(E.scores(alternative(r), q), E.scores(r, q), "f1"))


@query("evl10_samples", f"WITH {QRELS} SELECT query_id, doc_id FROM qrels WHERE query_id % 3 > 0")
def evl10(spark, d):
    return qrels(spark, d).where("query_id % 3 > 0")


@query("evl11_by_origin", f"WITH {RES}, {_F1} SELECT CASE WHEN grouping(o) = 1 THEN 'all' ELSE o END AS origin, count(*) AS n, round(avg(f1), 5) AS f1 FROM (SELECT CASE WHEN query_id % 2 = 0 THEN 'human' ELSE 'assisted' END AS o, f1 FROM f1) GROUP BY ROLLUP (o)")
def evl11(spark, d):
    o = F.when(F.col("query_id") % 2 == 0, "human").otherwise("assisted")
    s = E.scores(results(spark, d), qrels(spark, d)).withColumn("o", o)
    g = s.rollup("o").agg(F.grouping("o").alias("all"), F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 5).alias("f1"))
    return g.select(F.when(F.col("all") == 1, "all").otherwise(F.col("o")).alias("origin"), "n", "f1")


@query("evl12_zero_queries", f"WITH {RES}, {_F1} SELECT query_id FROM f1 WHERE f1 < 1")
def evl12(spark, d):
    return E.scores(results(spark, d), qrels(spark, d)).where("f1 < 1").select("query_id")


@query("evl13_objective", f"WITH {RES}, {_F1}, {_DCG.replace("@G@", "1e0")} SELECT round(5e-1 * avg(f1) + 3e-1 * avg(ndcg) + 2e-1 * avg(ndcg), 5) AS objective FROM f1 JOIN nd USING (query_id)")
def evl13(spark, d):
    r, q = results(spark, d), qrels(spark, d)
    j = E.scores(r, q).join(E.ndcg(r, q), "query_id")
    return j.agg(F.round(0.5 * F.avg("f1") + 0.3 * F.avg("ndcg") + 0.2 * F.avg("ndcg"), 5).alias("objective"))


@query("dgn01_pool_recall", f"WITH {RES}, f AS (SELECT query_id, doc_id, min(rank) AS first FROM res GROUP BY ALL), r AS (SELECT first, unnest([1, 3, 10, 20]) AS depth FROM qrels LEFT JOIN f USING (query_id, doc_id)) SELECT depth, round(avg(CAST(coalesce(first <= depth, false) AS INTEGER)), 6) AS recall, count(*) FILTER (WHERE first IS NULL) AS never FROM r GROUP BY depth")
def dgn01(spark, d):
    return E.pool_recall(results(spark, d), qrels(spark, d), (1, 3, 10, 20))


@query("dgn02_found_by", f"WITH {RES}, a AS (SELECT DISTINCT query_id, doc_id FROM res WHERE rank <= 3), b AS (SELECT DISTINCT query_id, doc_id FROM ({ALT})) SELECT a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b, count(*) AS n FROM qrels q LEFT JOIN a ON a.query_id = q.query_id AND a.doc_id = q.doc_id LEFT JOIN b ON b.query_id = q.query_id AND b.doc_id = q.doc_id GROUP BY ALL")
def dgn02(spark, d):
    r = results(spark, d)
    return E.found_by(r.where("rank <= 3"), alternative(r), qrels(spark, d))


@query("dgn03_rank_histogram", f"WITH {RES} SELECT CASE WHEN rank = 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 10 THEN '4-10' WHEN rank IS NULL THEN 'none' ELSE '11+' END AS bin, count(*) AS n FROM qrels LEFT JOIN res USING (query_id, doc_id) GROUP BY 1")
def dgn03(spark, d):
    j = qrels(spark, d).join(results(spark, d), ["query_id", "doc_id"], "left")
    r = F.col("rank")
    b = F.when(r == 1, "1").when(r <= 3, "2-3").when(r <= 10, "4-10").when(r.isNull(), "none").otherwise("11+")
    return j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("dgn04_failure_class", f"WITH {RES} SELECT q.query_id, q.doc_id, CASE WHEN q.doc_id % 3 = 0 THEN 'absent' WHEN rank IS NULL THEN 'outside' WHEN rank > 3 THEN 'in_pool' ELSE 'delivered' END AS class FROM qrels q LEFT JOIN res r ON r.query_id = q.query_id AND r.doc_id = q.doc_id")
def dgn04(spark, d):
    known = table(spark, d, "documents").where("doc_id % 3 <> 0")
    return E.failure_class(results(spark, d), qrels(spark, d), known, 3)


@query("dgn05_sibling_collections", f"WITH {RES}, c AS (SELECT DISTINCT query_id, source FROM qrels JOIN documents USING (doc_id)) SELECT r.query_id, r.doc_id, CASE WHEN q.doc_id IS NOT NULL THEN 'hit' WHEN c.source IS NOT NULL THEN 'sibling' ELSE 'other' END AS kind FROM res r JOIN documents d USING (doc_id) LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id LEFT JOIN c ON c.query_id = r.query_id AND c.source = d.source WHERE r.rank <= 3")
def dgn05(spark, d):
    q, docs = qrels(spark, d), table(spark, d, "documents").select("doc_id", "source")
    c = q.join(docs, "doc_id").select("query_id", "source").distinct().withColumn("c", F.lit(1))
    r = results(spark, d).where("rank <= 3").join(docs, "doc_id").join(q.withColumn("q", F.lit(1)), ["query_id", "doc_id"], "left").join(c, ["query_id", "source"], "left")
    return r.select("query_id", "doc_id", F.when(F.col("q").isNotNull(), "hit").when(F.col("c").isNotNull(), "sibling").otherwise("other").alias("kind"))


#: Share of a document's lines that are references; every third line is made one.
_SHARE = f"""rl AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS l FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
  rs AS (SELECT doc_id, avg(CAST({signs_sql('t')} AS INTEGER)) AS share FROM (SELECT doc_id, CASE WHEN (i + doc_id) % 3 = 0 THEN '[3] ' || l || ', accessed May 4, 2011.' ELSE l END AS t FROM rl) GROUP BY doc_id)"""


def reference_lines(spark, d):
    line = lambda l, i: F.when((i + 1 + F.col("doc_id")) % 3 == 0, F.concat(F.lit("[3] "), l, F.lit(", accessed May 4, 2011."))).otherwise(l)
    signs = F.transform(F.transform(F.split("text", "\n"), line), lambda l: T.is_reference(l))
    share = F.size(F.filter(signs, lambda x: x)) / F.size(signs)
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.when(F.col("text").isNotNull(), share).alias("share"))


@query("dgn06_reference_density", f"WITH {_SHARE} SELECT source, count(*) AS n, round(avg(share), 6) AS density FROM documents LEFT JOIN rs USING (doc_id) GROUP BY source HAVING count(*) >= 5")
def dgn06(spark, d):
    g = reference_lines(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("density"))
    return g.where("n >= 5")


@query("dgn07_encoder_overlap", f"WITH {RES}, a AS (SELECT query_id, list(DISTINCT doc_id) AS x, arg_min(doc_id, rank) AS x1 FROM res WHERE rank <= 5 GROUP BY 1), b AS (SELECT query_id, list(DISTINCT doc_id) AS y, arg_min(doc_id, rank) AS y1 FROM ({ALT}) WHERE rank <= 5 GROUP BY 1) SELECT query_id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard, x1 = y1 AS same_first FROM a JOIN b USING (query_id)")
def dgn07(spark, d):
    r = results(spark, d)
    return E.overlap(r, alternative(r), "doc_id", 5)


@query("dgn08_coverage", "SELECT doc_id, 'missing' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def dgn08(spark, d):
    return E.coverage(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("dgn10_changed_results", f"WITH {RES}, a AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS x FROM res WHERE rank <= 3 GROUP BY 1), b AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS y FROM (SELECT query_id, doc_id, rank FROM res WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 3 ELSE 2 END) GROUP BY 1) SELECT coalesce(a.query_id, b.query_id) AS query_id FROM a FULL JOIN b USING (query_id) WHERE x IS DISTINCT FROM y")
def dgn10(spark, d):
    r = results(spark, d)
    return E.changed(r.where("rank <= 3"), r.where(F.col("rank") <= F.when(F.col("query_id") % 2 == 0, 3).otherwise(2)))


@query("dgn12_flagged_by_format", f"WITH {_SHARE} SELECT lang AS format, round(avg(CAST(share >= 6e-1 AS INTEGER)), 6) AS flagged FROM documents LEFT JOIN rs USING (doc_id) GROUP BY lang")
def dgn12(spark, d):
    return reference_lines(spark, d).groupBy(F.col("lang").alias("format")).agg(F.round(F.avg((F.col("share") >= 0.6).cast("int")), 6).alias("flagged"))


_PHRASE_WORDS = "len(string_split(source || ' ' || lang, ' '))"


@query("dgn15_informative_names", f"SELECT lang AS collection, count(*) AS n, count(*) FILTER (WHERE {_PHRASE_WORDS} >= 2) AS informative, arg_min(source, doc_id) AS first_source FROM documents GROUP BY lang")
def dgn15(spark, d):
    w = F.size(F.split(F.concat_ws(" ", "source", "lang"), " "))
    return table(spark, d, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(w >= 2, 1)).alias("informative"), F.min_by("source", "doc_id").alias("first_source"))


@query("dgn16_saturation", f"WITH {TAKEN}, c AS (SELECT query_id, doc_id, count(*) AS n FROM pool GROUP BY ALL) SELECT query_id, count(*) FILTER (WHERE n >= 5) AS saturated, count(*) FILTER (WHERE n >= 5) * (count(*) FILTER (WHERE n >= 5) - 1) // 2 AS pairs FROM c GROUP BY query_id")
def dgn16(spark, d):
    c = pool(spark, d).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    s = F.count(F.when(F.col("n") >= 5, 1))
    return c.groupBy("query_id").agg(s.alias("saturated"), F.floor(s * (s - 1) / 2).alias("pairs"))


@query("ann01_candidate_sheet", f"WITH {RES} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id FROM res WHERE rank <= 5 AND doc_id % 2 = 0")
def ann01(spark, d):
    """Results written as a sheet of boxes, every even document ticked, and read again."""
    r = results(spark, d).where("rank <= 5").select(F.col("query_id").cast("string").alias("sheet"), "rank", "doc_id")
    head = r.select("sheet", F.lit(0).alias("ord"), F.concat(F.lit("## "), "sheet").alias("line")).distinct()
    box = F.when(F.col("doc_id") % 2 == 0, "- [x] ").otherwise("- [ ] ")
    return E.parse_sheet(head.unionByName(r.select("sheet", F.col("rank").alias("ord"), F.concat(box, F.col("doc_id").cast("string")).alias("line"))))


@query("ann02_grades", f"WITH {RES} SELECT query_id, doc_id, CAST(doc_id % 3 AS INTEGER) AS grade FROM res WHERE rank <= 10")
def ann02(spark, d):
    line = F.concat(F.col("doc_id").cast("string"), F.lit(": "), (F.col("doc_id") % 3).cast("string"))
    sheet = results(spark, d).where("rank <= 10").select("query_id", line.alias("line"))
    return sheet.select("query_id", F.regexp_extract("line", "^(\\d+)", 1).cast("bigint").alias("doc_id"), F.regexp_extract("line", ": (\\d)$", 1).cast("int").alias("grade"))


_VOTES = f"{RES}, votes AS (SELECT query_id, doc_id, unnest([1, 2, 3]) AS annotator FROM res WHERE rank <= 5), v AS (SELECT * FROM votes WHERE (doc_id + annotator) % 3 > 0)"


def votes(spark, d):
    v = results(spark, d).where("rank <= 5").select("query_id", "doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("annotator"))
    return v.where((F.col("doc_id") + F.col("annotator")) % 3 > 0)


@query("ann03_consensus", f"WITH {_VOTES} SELECT query_id, doc_id, count(DISTINCT annotator) AS votes FROM v WHERE query_id % 4 > 0 GROUP BY ALL HAVING count(DISTINCT annotator) >= 2")
def ann03(spark, d):
    return E.consensus(votes(spark, d), items(spark, d).where("query_id % 4 = 0"), 2)


@query("ann04_agreement", f"WITH {_VOTES}, a AS (SELECT DISTINCT query_id, doc_id FROM v WHERE annotator = 1), na AS (SELECT query_id, count(*) AS a FROM a GROUP BY 1), nt AS (SELECT query_id, count(*) AS t FROM qrels GROUP BY 1), nh AS (SELECT query_id, count(*) AS h FROM a JOIN qrels USING (query_id, doc_id) GROUP BY 1) SELECT item_id AS query_id, round(CASE WHEN coalesce(a, 0) + coalesce(t, 0) = 0 THEN 1e0 ELSE 2e0 * coalesce(h, 0) / (coalesce(a, 0) + coalesce(t, 0)) END, 6) AS f1 FROM benchmark LEFT JOIN na ON na.query_id = item_id LEFT JOIN nt ON nt.query_id = item_id LEFT JOIN nh ON nh.query_id = item_id")
def ann04(spark, d):
    return E.agreement(votes(spark, d).where("annotator = 1"), qrels(spark, d), items(spark, d))


@query("ann05_precision_by_votes", f"WITH {_VOTES}, n AS (SELECT query_id, doc_id, count(*) AS votes FROM v GROUP BY ALL) SELECT votes, count(*) AS n, round(avg(CAST(q.doc_id IS NOT NULL AS INTEGER)), 6) AS precision FROM n LEFT JOIN qrels q ON q.query_id = n.query_id AND q.doc_id = n.doc_id GROUP BY votes")
def ann05(spark, d):
    n = votes(spark, d).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("votes"))
    j = n.join(qrels(spark, d).withColumn("q", F.lit(1)), ["query_id", "doc_id"], "left")
    return j.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("q").isNotNull().cast("int")), 6).alias("precision"))


@query("val01_metadata", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong_length, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (WHERE lang NOT IN ('es', 'en', 'pt')) AS unreadable FROM documents")
def val01(spark, d):
    count = lambda c: F.count(F.when(c, 1))
    return table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), count(F.col("n_chars") != F.char_length("text")).alias("wrong_length"),
        (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated"), count(~F.col("lang").isin(*T.READABLE)).alias("unreadable"),
    )


@query("val02_result_schema", f"""WITH {TAKEN}, f AS (SELECT query_id, count(*) AS n FROM taken GROUP BY 1), dd AS (SELECT query_id, count(*) AS n FROM docs GROUP BY 1)
  SELECT query_id, 'ten fragments ranked 1 to 10' AS rule FROM f WHERE n <> 10 UNION SELECT query_id, 'three documents ranked 1 to 3' FROM dd WHERE n <> 3
  UNION SELECT query_id, 'at most 250 words' FROM taken WHERE {words_sql('text')} > 250 UNION SELECT query_id, 'no empty text' FROM taken WHERE trim(text) = ''
  UNION SELECT query_id, 'fragments are indexed' FROM taken WHERE doc_id % 50 = 0 UNION SELECT query_id, 'documents are indexed' FROM docs WHERE doc_id % 50 = 0""")  # fmt: skip
def val02(spark, d):
    from ..operators import results as A

    p = pool(spark, d)
    docs = top(p)
    meta = p.where("doc_id % 50 <> 0").select("chunk_id", "doc_id").distinct()
    return E.violations(A.take_fragments(ordered(spark, d)), docs, meta)


@query("val03_complete_sentences", "SELECT doc_id, regexp_matches(text, '[.!?…:;][\"”»)\\]]*[0-9]{0,3}\\s*$') AS complete FROM documents")
def val03(spark, d):
    return table(spark, d, "documents").select("doc_id", E.complete(F.col("text")).alias("complete"))


@query("val06_manifest_coverage", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def val06(spark, d):
    """Ids that are listed but never used."""
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@query("val07_ranks", f"WITH {RES} SELECT query_id, max(rank) = count(*) AND min(rank) = 1 AS consecutive FROM res GROUP BY query_id")
def val07(spark, d):
    r = results(spark, d).groupBy("query_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("k"))
    return r.select("query_id", ((F.col("m") == F.col("n")) & (F.col("k") == 1)).alias("consecutive"))


@query("ui01_running_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS average, value < 10 AS low FROM events")
def ui01(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 5).alias("average"), (F.col("value") < 10).alias("low"))
