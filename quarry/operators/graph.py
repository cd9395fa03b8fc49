"""An entity graph as two tables, nodes and edges; a multigraph, so edges repeat.

Entities are runs of capitalised words (no model is used); a triple joins
consecutive entities of a sentence, and its relation is the first listed verb
between them.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

RELATED = "related_to"
SKIPPED_FORMATS = ("csv", "xlsx", "pbf")
#: Labels to categories and colours.
CATEGORIES = {"PER": "person", "PERSON": "person", "ORG": "organisation", "ORGANIZATION": "organisation", "LOC": "place", "LOCATION": "place", "GPE": "place", "FAC": "place"}
#: Verb forms of the corpus' languages (en, fr, de, es) by lemma; a form of two languages has the first one's lemma.
_FORMS = {
    "meet": "meet meets met", "find": "find finds found", "make": "make makes made", "lead": "lead leads led", "own": "owns owned", "visit": "visit visits visited",
    "support": "supports supported", "join": "join joins joined", "buy": "buy buys bought", "sign": "signs signed", "attack": "attacks attacked", "write": "write writes wrote",
    "rencontrer": "rencontre rencontra rencontrent", "trouver": "trouve trouva trouvent", "diriger": "dirige dirigea dirigent", "acheter": "achète acheta achètent", "visiter": "visite visita visitent", "rejoindre": "rejoint rejoignit",
    "treffen": "trifft traf treffen trafen", "finden": "findet fand finden fanden", "leiten": "leitet leitete leiten", "kaufen": "kauft kaufte kaufen", "besuchen": "besucht besuchte besuchen", "unterstützen": "unterstützt unterstützte",
    "encontrar": "encuentra encontró encuentran", "hacer": "hace hizo hacen", "comprar": "compra compró compran", "visitar": "visitó visitan", "firmar": "firma firmó firman", "apoyar": "apoya apoyó apoyan",
}
VERBS: dict[str, str] = {}
for _lemma, _forms in _FORMS.items():
    for _form in _forms.split():
        VERBS.setdefault(_form, _lemma)
_RUN = "\\p{Lu}[\\p{L}\\p{N}]+(?: \\p{Lu}[\\p{L}\\p{N}]+)*"


def category(label: Column) -> Column:
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit("misc"))


def entities(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(_RUN), F.lit(0))


def label_of(entity: Column) -> Column:
    """Several words are an organisation, one in capitals an acronym, others persons."""
    return F.when(F.instr(entity, " ") > 0, "ORG").when(F.upper(entity) == entity, "MISC").otherwise("PER")


def triples(sentences: DataFrame, verbs: dict[str, str] | None = None) -> DataFrame:
    """src, relation, dst, types, doc_id, chunk_id from (doc_id, chunk_id, sentence); names are cleaned, self-loops go."""
    s = sentences.select("doc_id", "chunk_id", "sentence", F.posexplode(entities(F.col("sentence"))).alias("i", "src"))
    w = Window.partitionBy("doc_id", "chunk_id", "sentence").orderBy("i")
    t = s.withColumn("dst", F.lead("src").over(w)).where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    relation: Column = F.lit(RELATED)
    if verbs:
        cut = lambda c, at, n: F.call_function("substring_index", c, F.col(at), F.lit(n))
        between = cut(cut(F.col("sentence"), "src", -1), "dst", 1)
        pairs = F.create_map(*(F.lit(x) for kv in verbs.items() for x in kv))
        known = F.filter(T.search_terms(between), lambda x: x.isin(*verbs))
        relation = F.coalesce(F.try_element_at(pairs, F.try_element_at(known, F.lit(1))), F.lit(RELATED))
    return t.select("src", relation.alias("relation"), "dst", label_of(F.col("src")).alias("src_type"), label_of(F.col("dst")).alias("dst_type"), "doc_id", "chunk_id")


def ends(edges: DataFrame) -> DataFrame:
    """node, type, doc_id, chunk_id: both ends of every edge."""
    return edges.select("doc_id", "chunk_id", F.expr("stack(2, src, src_type, dst, dst_type) AS (node, type)"))


def nodes(edges: DataFrame) -> DataFrame:
    """node, type: the most frequent label, ties by name, MISC without any."""
    n = ends(edges).groupBy("node", "type").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "type"))
    return n.withColumn("k", best).where("k = 1").select("node", F.coalesce("type", F.lit("MISC")).alias("type"))


def evidence(edges: DataFrame, query_entities: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, chunk_id, evidence: edges at the query's entities, counted by chunk."""
    e = ends(edges).select(T.unaccent(F.col("node")).alias("name"), "doc_id", "chunk_id")
    q = query_entities.select("query_id", T.unaccent(F.col("entity")).alias("name")).distinct()
    g = e.join(q, "name").groupBy("query_id", "doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("evidence"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("evidence"), "doc_id", "chunk_id"))).where(F.col("rank") <= k)


def break_ties(pool: DataFrame, found: DataFrame) -> DataFrame:
    """The same pool; equal scores are ordered by evidence, then as before."""
    p = pool.join(found.select("query_id", "chunk_id", "evidence"), ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("evidence", F.lit(0))), "rank")
    return p.withColumn("new_rank", F.row_number().over(order))


def entity_documents(edges: DataFrame, least: int = 3) -> DataFrame:
    """name, docs: an inverted map of normalised entity names."""
    e = ends(edges).select(T.unaccent(F.col("node")).alias("name"), "doc_id").where(F.char_length("name") >= least)
    return e.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("docs"))


def overlap(edges: DataFrame, query_entities: DataFrame) -> DataFrame:
    """query_id, doc_id, shared: how many of the query's entities a document has."""
    e = ends(edges).select(T.unaccent(F.col("node")).alias("name"), "doc_id").distinct()
    q = query_entities.select("query_id", T.unaccent(F.col("entity")).alias("name")).distinct()
    return e.join(q, "name").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))


def degrees(edges: DataFrame, n: int) -> DataFrame:
    g = ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return g.orderBy(F.desc("degree"), "node").limit(n)


def _checkpoint_folder(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a temporary folder only on a local master without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="quarry-"))


def components(edges: DataFrame) -> DataFrame:
    """node, root by spreading the smallest name until no label changes; each round is written to the checkpoint folder."""
    _checkpoint_folder(edges.sparkSession)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "other").distinct().checkpoint()
    label = both.select("node", F.col("node").alias("root")).distinct()
    before = None
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), "other").select("node", "root")
        label = label.unionByName(near).groupBy("node").agg(F.min("root").alias("root")).checkpoint()
        above = label.select(F.col("node").alias("root"), F.col("root").alias("least"))  # the root's root, so that long chains take few rounds
        label = label.join(above, "root").select("node", F.col("least").alias("root")).checkpoint()
        sign = label.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
        if sign == before:
            break
        before = sign
    return label


def graphml(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """One XML line a node or edge, in order; a writer puts the frame around them."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes_.select(F.lit(0).alias("part"), F.format_string('<node id="%s"><data key="type">%s</data></node>', esc(F.col("node")), F.col("type")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data><data key="doc_id">%s</data></edge>', esc(F.col("src")), esc(F.col("dst")), F.col("relation"), F.col("doc_id").cast("string")).alias("line"))
    return n.unionByName(e)
