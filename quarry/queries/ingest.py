"""Sources, sinks and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import ingest as I
from ..registry import query, table
from ..sources import formats as D
from ..sources import pages as P
from ..sources import sinks as K
from ..sources import structured as S
from . import chunk_sql as Q
from .chunk_sql import sentences_sql
from .text import words_sql

_HTML = "regexp_replace(html, '(?s)<!--.*?-->|<(?:script|style|nav|footer|aside|head|form)[ >].*?</(?:script|style|nav|footer|aside|head|form)>|<div class=\"ad\">.*?</div>', ' ', 'g')"
_HEADED = f"regexp_replace({_HTML}, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', chr(10) || chr(10) || '# \\2' || chr(10) || chr(10), 'g')"
_BLOCKS = f"regexp_replace({_HEADED}, '</?(?:p|li|div|ul|ol|tr|table|article|section|body|html)[^>]*>', chr(10) || chr(10), 'g')"
_BARE = f"regexp_replace(regexp_replace({_BLOCKS}, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
_ENT = f"replace(replace(replace(replace(replace(replace({_BARE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_PAGE = f"trim(regexp_replace(regexp_replace({_ENT}, '[ \\t\\r]+', ' ', 'g'), '\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("src05_html_text", f"SELECT page_id, {_PAGE} AS text, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS site FROM pages")
def src05(spark, d):
    return P.page_text(table(spark, d, "pages"))


_JSON = "SELECT event_id, json_object('title', event_type, 'body_paragraphs', CASE WHEN event_id % 3 = 0 THEN ['one', 'two'] END, 'body', CASE WHEN event_id % 3 = 1 THEN 'some body' END, 'abstract', 'short', 'value', CAST(user_id AS VARCHAR)) AS j FROM events"


@query("src06_json_text", """SELECT event_id, '# ' || event_type || chr(10) || chr(10) || CASE event_id % 3 WHEN 0 THEN 'one' || chr(10) || chr(10) || 'two' WHEN 1 THEN 'some body' ELSE 'short' END
  || chr(10) || chr(10) || 'value: ' || CAST(user_id AS VARCHAR) AS text FROM events""")  # fmt: skip
def src06(spark, d):
    k = F.col("event_id") % 3
    doc = F.struct(
        F.col("event_type").alias("title"), F.when(k == 0, F.array(F.lit("one"), F.lit("two"))).alias("body_paragraphs"), F.when(k == 1, "some body").alias("body"),
        F.lit("short").alias("abstract"), F.col("user_id").cast("string").alias("value"), F.lit("http://x").alias("url"),
    )
    return S.json_text(table(spark, d, "events").select("event_id", F.to_json(doc).alias("json")), "json").select("event_id", "text")


@query("src06a_first_text", "SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN '  ' ELSE event_type END), ''), nullif(trim(props), '')) AS text FROM events")
def src06a(spark, d):
    blank = F.when(F.col("event_id") % 2 == 0, "  ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.first_text(blank, F.col("props")).alias("text"))


@query("src06b_flat_fields", "SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def src06b(spark, d):
    return S.flat_fields(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


@query("src06c_string_leaves", "SELECT event_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS leaf FROM (SELECT doc_id AS event_id, list_filter([lang, source, text], lambda v: v IS NOT NULL) AS x FROM documents)")
def src06c(spark, d):
    return S.string_leaves(table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.to_json(F.struct("lang", F.array("source", "text").alias("x"))).alias("props")), "props").select("event_id", "pos", "leaf")


@query("src06d_first_metadata", "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY user_id")
def src06d(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("event_type"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("event_id"))).alias("value"))


@query("src07_row_cap", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def src07(spark, d):
    return S.first_rows(table(spark, d, "events"), "user_id", "event_id", 5).select("user_id", "event_id")


@query("src07a_row_text", "SELECT c_custkey, concat_ws(' | ', 'name: ' || c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment: ' || c_mktsegment END, 'nation: ' || CAST(c_nationkey AS VARCHAR)) AS text FROM customer")
def src07a(spark, d):
    c = table(spark, d, "customer")
    shown = c.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    return shown.select("c_custkey", S.row_text(shown, ["name", "segment", "nation"]).alias("text"))


_LINES = """l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
  t AS (SELECT doc_id, i, trim(line) AS line FROM l)"""


@query("src09a_repeated_lines", f"""WITH {_LINES}, n AS (SELECT doc_id, max(i) // 3 + 1 AS pages FROM t GROUP BY doc_id),
  c AS (SELECT doc_id, line, count(*) AS k FROM t WHERE line <> '' GROUP BY ALL)
  SELECT doc_id, line, k FROM c JOIN n USING (doc_id) WHERE pages >= 3 AND k >= greatest(2, CAST(floor(3e-1 * pages) AS BIGINT))""")  # fmt: skip
def src09a(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return P.repeated_lines(lines.withColumn("page", F.floor((F.col("i") + 1) / 3)))


@query("src09b_paragraphs", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\n[ \\t]*\\n\\s*', chr(1), 'g'), '\\s*\\n\\s*', ' ', 'g'), chr(1), chr(10) || chr(10), 'g') AS text FROM documents")
def src09b(spark, d):
    return table(spark, d, "documents").select("doc_id", P.paragraphs(F.col("text")).alias("text"))


@query("src09c_scan_detector", "SELECT source, sum(length(text)) AS n_chars, count(*) AS pages, sum(length(text)) < 200 * count(*) AS scanned FROM documents GROUP BY source")
def src09c(spark, d):
    return P.scanned(table(spark, d, "documents"), "source")


@query("src11_tile_features", "SELECT event_type, props, min(event_id) AS first_event, event_type || ': ' || props AS text FROM events GROUP BY event_type, props")
def src11(spark, d):
    e = table(spark, d, "events")
    return S.distinct_features(e, "event_type", "props", "event_id").withColumn("text", F.concat_ws(": ", "event_type", "props"))


@query("src14_query_aliases", "SELECT conv_id AS ord, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'q' || CAST(conv_id AS VARCHAR) END, CAST(turn AS VARCHAR)) AS query_id, text FROM conversations WHERE trim(text) <> ''")
def src14(spark, d):
    c = table(spark, d, "conversations")
    raw = c.select(F.col("conv_id").alias("ord"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("q"), F.col("conv_id").cast("string"))).alias("query_id"), F.col("turn").cast("string").alias("id"), F.col("text").alias("consulta"))
    return S.canonical_queries(raw)


@query("src15_manifest_columns", "SELECT p_partkey AS ord, p_name AS name, p_type AS path, coalesce(p_brand, CAST(p_size AS VARCHAR)) AS id FROM part")
def src15(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("nombre"), F.col("p_type").alias("ruta"), F.col("p_brand").alias("doc_id"), F.col("p_size").cast("string").alias("id"))
    return S.canonical_manifest(p)


@query("src16_inventory_key", "SELECT p_partkey, trim(p_brand) || '/' || trim(p_name) AS path FROM part")
def src16(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.trim("p_brand"), F.trim("p_name")).alias("path"))


@query("snk06_run_history", "SELECT event_id, user_id, CAST(ts AS VARCHAR) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1")
def snk06(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("k", newest).where("k = 1").select("event_id", "user_id", F.regexp_replace(F.col("ts").cast("string"), "\\.0+$", "").alias("ts"))


@query("snk07_metadata_patch", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'jpg' ELSE lang END AS format, text, CAST(NULL AS BOOLEAN) AS indexed FROM documents
  UNION ALL SELECT 'B' || CAST(item_id AS VARCHAR), 'jpg', '', false FROM benchmark""")  # fmt: skip
def snk07(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "img").otherwise(F.col("lang")).alias("format"), "text")
    extra = table(spark, d, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("id"))
    return S.patch_metadata(rows, extra)


# -- chunking ------------------------------------------------------------------

#: Markdown made of documents: a heading before every fourth line.
MARKED = """m AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


def marked(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 2, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("chk02_sections", f"""WITH {MARKED}, n AS (SELECT doc_id, i, line, (i + 1) // 4 AS sec FROM m)
  SELECT doc_id, CASE WHEN sec > 0 THEN 'Part ' || CAST(sec * 4 - 2 AS VARCHAR) END AS title, trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g')) AS body
  FROM n GROUP BY doc_id, sec HAVING trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g')) <> ''""")  # fmt: skip
def chk02(spark, d):
    return marked(spark, d).select("doc_id", F.inline(C.sections(F.col("text"))).alias("title", "body")).withColumn("body", F.trim("body"))


@query("chk01_sentences", f"SELECT doc_id, len({sentences_sql('text')}) AS n, array_to_string({sentences_sql('text')}, ' / ') AS sentences FROM documents")
def chk01(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.array_join(s, " / ").alias("sentences"))


@query("chk03_section_sentences", f"SELECT doc_id, s AS sentence, count(*) AS n FROM (SELECT doc_id, unnest({sentences_sql('p')}) AS s FROM (SELECT doc_id, unnest(list_filter([trim(x) FOR x IN regexp_split_to_array(text, '\\n\\n+')], lambda x: x <> '')) AS p FROM documents)) GROUP BY ALL")
def chk03(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(C.section_sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query("chk04_packed_chunks", Q.CHUNK_ROWS)
def chk04(spark, d):
    return C.chunks(table(spark, d, "documents"))


@query("chk05_tabular_blocks", "SELECT doc_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS text FROM (SELECT doc_id, list_filter([trim(x) FOR x IN regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+')], lambda x: x <> '') AS b FROM documents)")
def chk05(spark, d):
    return C.blocks(table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("chk07_overlap_removed", Q.OVERLAP_ROWS)
def chk07(spark, d):
    return C.without_overlap(C.chunks(table(spark, d, "documents"), 60, 1)).select("doc_id", "pos", "k", F.size("sentences").alias("n"))


@query("chk09_repacked", Q.REPACKED)
def chk09(spark, d):
    return C.repack(C.chunks(table(spark, d, "documents"), 60, 1), 120, 0)


@query("chk11_conservation", f"SELECT doc_id, {words_sql('text')} AS words, true AS whole FROM documents")
def chk11(spark, d):
    """Chunks without overlap and headings have the words that the document had; row by row, so that documents without chunks stay."""
    text = F.coalesce("text", F.lit(""))
    n = F.aggregate(C.pieces(text, 60, 0), F.lit(0), lambda n, c: n + c["num_tokens"]) + C.heading_words(text)
    return table(spark, d, "documents").select("doc_id", T.word_count(text).alias("words"), n.alias("n")).select("doc_id", "words", (F.col("n") == F.col("words")).alias("whole"))


@query("chk12_grouped_chunks", "SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def chk12(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.select("source", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("chk14_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def chk14(spark, d):
    return I.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("str01_activity_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def str01(spark, d):
    from ..streaming.ingest import activity

    return activity(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("chk08_character_overlap", Q.SHARED)
def chk08(spark, d):
    c = C.chunks(table(spark, d, "documents"), 60, 1)
    return C.character_overlap(c).select("doc_id", "pos", "shared")


@query("chk10_loose_repack", Q.LOOSE)
def chk10(spark, d):
    return C.repack_loosely(C.chunks(table(spark, d, "documents"), 60, 1), 120, 0)


@query("chk13_budget_grid", Q.GRID)
def chk13(spark, d):
    from ..plans.sweep import sweep

    c = C.chunks(table(spark, d, "documents"), 60, 1)
    grid = [{"budget": b, "overlap": o} for b in (40, 120) for o in (0, 1)]
    return sweep(c, grid, lambda x, budget, overlap: C.repack(x, budget, overlap).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("num_tokens"), 4).alias("mean_tokens")))


@query("src01_corpus_files")
def src01(spark, d):
    """Files below a folder, here the tables themselves, in order of path."""
    found = S.read_files(spark, d, ("parquet",))
    return found.select(T.file_name(F.col("path")).alias("name"), F.length("content").alias("n_bytes")).orderBy("name")


@query("src04_dispatch", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'md' WHEN 4 THEN 'csv' ELSE 'none' END AS reader FROM documents")
def src04(spark, d):
    from .text import paths

    return paths(spark, d).select("doc_id", F.coalesce(T.format_of(F.col("path")), F.lit("none")).alias("reader"))


@query("src04_documents", f"SELECT 'p/' || page_id || '.html' AS path, 'html' AS format, {_PAGE} AS text, false AS truncated FROM pages UNION ALL SELECT 'd/' || doc_id || '.md', 'md', text, false FROM documents UNION ALL SELECT 'e/' || event_id || '.json', 'json', event_type, false FROM events UNION ALL SELECT 'i/' || item_id || '.png', 'img', NULL, false FROM benchmark")
def src04b(spark, d):
    """Files of four formats, each to its reader; for images there is none."""
    as_file = lambda t, folder, key, suffix, content: table(spark, d, t).select(F.concat(F.lit(folder + "/"), key, F.lit(suffix)).alias("path"), content.cast("binary").alias("content"))
    files = as_file("pages", "p", "page_id", ".html", F.col("html")).unionByName(as_file("documents", "d", "doc_id", ".md", F.col("text")))
    files = files.unionByName(as_file("events", "e", "event_id", ".json", F.to_json(F.struct(F.struct(F.array("event_type").alias("unknown")).alias("deep")))))
    files = files.unionByName(as_file("benchmark", "i", "item_id", ".png", F.col("text"))).unionByName(as_file("region", "r", "r_regionkey", ".exe", F.col("r_name")))
    return D.documents(files)


_CSV = "SELECT c_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer"


@query("src07_delimited_files", f"SELECT n || '.csv' AS path, string_agg('key: ' || k || CASE WHEN k % 2 = 0 THEN ' | what: a;b' ELSE '' END, chr(10) ORDER BY i) AS text, any_value(m) > 500 AS truncated FROM ({_CSV}) WHERE i <= 500 GROUP BY n")
def src07b(spark, d):
    """Files with another delimiter than the comma, quoted cells and empty ones."""
    line = F.concat("c_custkey", F.lit(";"), F.when(F.col("c_custkey") % 2 == 0, '"a;b"').otherwise(""))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("r"))
    content = F.concat(F.lit("key;what\n"), F.array_join("r.line", "\n")).cast("binary")
    return D.documents(rows.select(F.concat("c_nationkey", F.lit(".csv")).alias("path"), content.alias("content"))).select("path", "text", "truncated")


@query("snk08_pool_by_encoder", "SELECT vec_id AS query_id, vec_id AS chunk_id, encoder, cosine FROM (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b FROM embeddings) UNPIVOT (cosine FOR encoder IN (a, b))")
def snk08(spark, d):
    """Written by encoder and read again."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("chunk_id"), *(F.round(F.col("embedding")[i].cast("double"), 6).alias(n) for i, n in ((0, "a"), (1, "b"))))
    path = K.work_folder(spark, "pool")
    K.write_pool(e, ["a", "b"], path)
    return spark.read.parquet(path)


@query("src13_json_lines", "SELECT doc_id, quality, toxic FROM labels")
def src13(spark, d):
    """A JSON Lines file, written and read under a fixed schema."""
    path = K.work_folder(spark, "labels")
    table(spark, d, "labels").write.json(path)
    return spark.read.schema("doc_id bigint, quality int, toxic int").json(path)


@query("src12_text_passthrough", "SELECT doc_id, text FROM documents")
def src12(spark, d):
    """Bytes with a broken character at the end, read as text."""
    broken = F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xc3")))
    return table(spark, d, "documents").select("doc_id", S.decoded(broken).alias("text"))


@query("src17_index_guard", "SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong FROM embeddings")
def src17(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("embedding") != 64, 1)).alias("wrong"))


@query("snk01_chunk_lines", Q.CHUNK_ROWS)
def snk01(spark, d):
    """Chunks written as JSON Lines and read again."""
    path = K.work_folder(spark, "chunks")
    K.write_chunks(C.chunks(table(spark, d, "documents")), path)
    return spark.read.schema("doc_id bigint, pos int, chunk_id string, section string, text string, num_tokens int").json(path)


@query("snk02_index_rows", "SELECT vec_id AS chunk_id, text, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings JOIN documents ON vec_id = doc_id")
def snk02(spark, d):
    """Vectors on the row of their chunk, written and loaded with its checks: nothing to align later."""
    path = K.work_folder(spark, "index")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    K.write_index(e.join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id"), path)
    return S.load_index(spark, path, 64).select("chunk_id", "text", F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))
