"""The entity graph of the documents' sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import retrieve as R
from ..sources import sinks as K
from ..sources import structured as S
from ..registry import query, table
from .chunk_sql import sentences_sql
from .text import unaccent_sql

_RUN = "\\p{Lu}[\\p{L}\\p{N}]+(?: \\p{Lu}[\\p{L}\\p{N}]+)*"
_LABEL = "CASE WHEN contains({0}, ' ') THEN 'ORG' WHEN upper({0}) = {0} THEN 'MISC' ELSE 'PER' END"
EDGES = f"""sn AS (SELECT doc_id, doc_id * 7 AS chunk_id, unnest({sentences_sql('text')}) AS sentence FROM documents),
  en AS (SELECT doc_id, chunk_id, sentence, n, unnest(e) AS src, generate_subscripts(e, 1) AS i FROM (SELECT *, row_number() OVER () AS n, regexp_extract_all(sentence, '{_RUN}') AS e FROM sn)),
  ld AS (SELECT doc_id, chunk_id, src, lead(src) OVER (PARTITION BY n ORDER BY i) AS dst FROM en),
  ed AS (SELECT DISTINCT src, dst, {_LABEL.format('src')} AS src_type, {_LABEL.format('dst')} AS dst_type, doc_id, chunk_id FROM ld WHERE dst IS NOT NULL AND src <> dst),
  ends AS (SELECT src AS node, src_type AS type, doc_id, chunk_id FROM ed UNION ALL SELECT dst, dst_type, doc_id, chunk_id FROM ed),
  qe AS (SELECT DISTINCT item_id AS query_id, {unaccent_sql('e')} AS name FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_RUN}')) AS e FROM benchmark))"""


def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7).alias("chunk_id"), F.explode(T.sentences(F.col("text"))).alias("sentence"))


def edges(spark, d):
    """Distinct, so that repeated sentences of a document count once here."""
    return G.triples(sentences(spark, d)).distinct()


def query_entities(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(G.entities(F.col("text"))).alias("entity"))


@query("grf01_entities", f"WITH {EDGES} SELECT doc_id, src AS entity, {_LABEL.format('src')} AS label, count(*) AS n FROM en GROUP BY ALL")
def grf01(spark, d):
    e = sentences(spark, d).select("doc_id", F.explode(G.entities(F.col("sentence"))).alias("entity"))
    return e.groupBy("doc_id", "entity", G.label_of(F.col("entity")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("grf02_triples", f"WITH {EDGES} SELECT src, 'related_to' AS relation, dst, src_type, dst_type, doc_id, chunk_id FROM ed")
def grf02(spark, d):
    return edges(spark, d)


def relations(spark, d):
    """Edges with the first listed verb between their ends; ``edges`` has none, as the SQL of its queries says."""
    return G.triples(sentences(spark, d), G.VERBS).distinct()


_FORMS = "[" + ", ".join(f"'{v}'" for v in G.VERBS) + "]"
_LEMMAS = "[" + ", ".join(f"'{v}'" for v in G.VERBS.values()) + "]"
RELATIONS = f"""{EDGES}, bw AS (SELECT doc_id, chunk_id, src, lead(src) OVER (PARTITION BY n ORDER BY i) AS dst, sentence FROM en),
  vb AS (SELECT *, list_filter(regexp_extract_all(lower(string_split(list_last(string_split(sentence, src)), dst)[1]), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({_FORMS}, w))[1] AS verb FROM bw WHERE dst IS NOT NULL AND src <> dst),
  rel AS (SELECT DISTINCT src, CASE WHEN verb IS NULL THEN '{G.RELATED}' ELSE {_LEMMAS}[list_position({_FORMS}, verb)] END AS relation, dst, {_LABEL.format('src')} AS src_type, {_LABEL.format('dst')} AS dst_type, doc_id, chunk_id FROM vb)"""


@query("grf02_relations", f"WITH {RELATIONS} SELECT * FROM rel")
def grf02b(spark, d):
    return relations(spark, d)


@query("grf10_relations", f"WITH {RELATIONS} SELECT relation, count(*) AS n FROM rel GROUP BY relation")
def grf10f(spark, d):
    return relations(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("grf03_skipped_formats", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('csv', 'xlsx', 'pbf')")
def grf03(spark, d):
    return table(spark, d, "documents").where(~F.col("lang").isin(*G.SKIPPED_FORMATS)).select("doc_id", "lang")


@query("grf04_node_types", f"WITH {EDGES}, c AS (SELECT node, type, count(*) AS n FROM ends GROUP BY ALL) SELECT node, type FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, type) = 1")
def grf04(spark, d):
    return G.nodes(edges(spark, d))


@query("grf05_categories", f"WITH {EDGES} SELECT type, CASE type WHEN 'PER' THEN 'person' WHEN 'ORG' THEN 'organisation' ELSE 'misc' END AS category, count(*) AS n FROM ends GROUP BY ALL")
def grf05(spark, d):
    e = G.ends(edges(spark, d))
    return e.groupBy("type", G.category(F.col("type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_EV = f"{EDGES}, ev AS (SELECT query_id, doc_id, chunk_id, count(*) AS evidence FROM (SELECT {unaccent_sql('node')} AS name, doc_id, chunk_id FROM ends) JOIN qe USING (name) GROUP BY ALL), evidence AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, doc_id, chunk_id) AS rank FROM ev QUALIFY rank <= 20)"


@query("grf06_graph_search", f"WITH {_EV} SELECT query_id, rank, doc_id, chunk_id, evidence FROM evidence")
def grf06(spark, d):
    return G.evidence(edges(spark, d), query_entities(spark, d), 20).select("query_id", "rank", "doc_id", "chunk_id", "evidence")


#: A pool with many ties: the 200 best documents of each query, scored by remainders.
_FLAT = "pool AS (SELECT query_id, chunk_id, doc_id, (doc_id * 13 + query_id) % 5 AS score, row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 13 + query_id) % 5 DESC, doc_id) AS rank FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, doc_id, chunk_id) <= 200))"


@query("grf07_tie_break", f"WITH {_EV}, {_FLAT} SELECT p.query_id, p.chunk_id, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, coalesce(evidence, 0) DESC, p.rank) AS new_rank FROM pool p LEFT JOIN evidence e ON e.query_id = p.query_id AND e.chunk_id = p.chunk_id")
def grf07(spark, d):
    q = query_entities(spark, d)
    e = edges(spark, d)
    every = G.evidence(e, q, 200).withColumn("score", (F.col("doc_id") * 13 + F.col("query_id")) % 5)
    pool = R.ranked(every.drop("rank"), "score", "doc_id").drop("evidence")
    return G.break_ties(pool, G.evidence(e, q, 20)).select("query_id", "chunk_id", "new_rank")


@query("grf08_entity_documents", f"WITH {EDGES} SELECT name, count(DISTINCT doc_id) AS docs FROM (SELECT {unaccent_sql('node')} AS name, doc_id FROM ends) WHERE length(name) >= 3 GROUP BY name")
def grf08(spark, d):
    return G.entity_documents(edges(spark, d))


@query("grf09_entity_overlap", f"WITH {EDGES} SELECT query_id, doc_id, count(*) AS shared FROM (SELECT DISTINCT {unaccent_sql('node')} AS name, doc_id FROM ends) JOIN qe USING (name) GROUP BY ALL")
def grf09(spark, d):
    return G.overlap(edges(spark, d), query_entities(spark, d))


@query("grf10_summary", f"WITH {EDGES} SELECT (SELECT count(DISTINCT node) FROM ends) AS nodes, count(*) AS edges, count(DISTINCT doc_id) AS documents FROM ed")
def grf10(spark, d):
    e = edges(spark, d)
    n = G.ends(e).agg(F.countDistinct("node").alias("nodes"))
    return n.crossJoin(e.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("doc_id").alias("documents")))  # one row each


@query("grf10_top_degree", f"WITH {EDGES} SELECT node, count(*) AS degree FROM ends GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def grf10b(spark, d):
    return G.degrees(edges(spark, d), 20)


@query("grf10_components", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 11 AS b FROM nation), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node) SELECT CAST(node AS VARCHAR) AS node, CAST(min(CAST(root AS VARCHAR)) AS VARCHAR) AS root FROM r GROUP BY node")
def grf10c(spark, d):
    n = table(spark, d, "nation")
    e = n.select(F.col("n_nationkey").cast("string").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 11).cast("string").alias("dst"))
    return G.components(e)


@query("grf10_entity_components", f"WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), r AS (SELECT a AS node, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node")
def grf10d(spark, d):
    return G.components(edges(spark, d))


@query("grf10_subgraph", f"WITH {EDGES}, top AS (SELECT node FROM ends GROUP BY node ORDER BY count(*) DESC, node LIMIT 20) SELECT src, dst, doc_id, chunk_id FROM ed WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def grf10e(spark, d):
    e = edges(spark, d)
    top = G.degrees(e, 20).select("node")
    return e.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "doc_id", "chunk_id")


@query("grf11_graph_rrf", f"WITH {_EV}, {_FLAT}, f AS (SELECT query_id, chunk_id, round(sum(1 / (6e1 + rank)), 9) AS score, min(struct_pack(l := l, rank := rank)) AS seen FROM (SELECT query_id, chunk_id, rank, 0 AS l FROM pool WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM evidence) GROUP BY ALL) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) <= 10")
def grf11(spark, d):
    q = query_entities(spark, d)
    e = edges(spark, d)
    every = G.evidence(e, q, 200).withColumn("score", (F.col("doc_id") * 13 + F.col("query_id")) % 5)
    pool = R.ranked(every.drop("rank"), "score", "doc_id", limit=20)
    return R.rrf([pool, G.evidence(e, q, 20)], limit=10).select("query_id", "chunk_id", "score", "rank")


@query("snk05_graphml_lines", f"""WITH {RELATIONS}, re AS (SELECT src AS node, src_type AS type FROM rel UNION ALL SELECT dst, dst_type FROM rel), rc AS (SELECT node, type, count(*) AS n FROM re GROUP BY ALL)
  SELECT 0 AS part, '<node id="' || node || '"><data key="type">' || type || '</data></node>' AS line FROM rc QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, type) = 1
  UNION ALL SELECT 1, '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation || '</data><data key="doc_id">' || doc_id || '</data></edge>' FROM rel""")
def snk05(spark, d):
    e = relations(spark, d)
    return G.graphml(G.nodes(e), e)


@query("qry17_entity_names", f"WITH {EDGES} SELECT DISTINCT src AS entity, {unaccent_sql('src')} AS name FROM en")
def qry17(spark, d):
    e = sentences(spark, d).select(F.explode(G.entities(F.col("sentence"))).alias("entity")).distinct()
    return e.select("entity", T.unaccent(F.col("entity")).alias("name"))


@query("val04_cited_documents", f"WITH {EDGES} SELECT DISTINCT doc_id FROM ed WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def val04(spark, d):
    return edges(spark, d).select("doc_id").distinct().join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("src18_graph_file", f"WITH {EDGES} SELECT DISTINCT src, dst FROM ed")
def src18(spark, d):
    """The graph written as GraphML and read again."""
    path = K.work_folder(spark, "graph")
    found = edges(spark, d)
    K.write_graphml(G.nodes(found), found, path)
    return S.read_graphml(spark, path).select("src", "dst").distinct()
