"""Cleaning, language, identity and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table

_UNACCENT = f"translate(lower(coalesce({{0}}, '')), '{T.ACCENTED}', '{T.PLAIN}')"
_SQUEEZE = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def unaccent_sql(c: str) -> str:
    return _UNACCENT.format(c)


def squeeze_sql(c: str) -> str:
    return _SQUEEZE.format(c)


def words_sql(c: str) -> str:
    s = squeeze_sql(c)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END"


def content_sql(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({unaccent_sql(c)}, '[a-z0-9]{{4,}}')), lambda w: NOT list_contains({_STOP}, w))"


#: Paths as a crawl would leave them, from documents.
PATHS = """
p AS (SELECT doc_id, text, lang, source,
  'F' || CAST(doc_id % 4 AS VARCHAR) || '_Topic' || chr(92) || source || '/F' || CAST(doc_id % 4 AS VARCHAR) || '-AB-Annual' || 'Review-' || CAST(doc_id % 50 AS VARCHAR)
  || '_' || CAST(1980 + doc_id % 60 AS VARCHAR) || '.' || CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'html' WHEN 2 THEN 'txt' WHEN 3 THEN 'avif' ELSE 'csv' END AS path
  FROM documents)"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    ext = F.when(n % 5 == 0, "PDF").when(n % 5 == 1, "html").when(n % 5 == 2, "txt").when(n % 5 == 3, "avif").otherwise("csv")
    path = F.concat(F.lit("F"), (n % 4).cast("string"), F.lit("_Topic\\"), F.col("source"), F.lit("/F"), (n % 4).cast("string"), F.lit("-AB-AnnualReview-"), (n % 50).cast("string"), F.lit("_"), (1980 + n % 60).cast("string"), F.lit("."), ext)
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", path.alias("path"))


_SLASH = "replace(path, chr(92), '/')"
_SUFFIX = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_NAME = f"list_last(string_split({_SLASH}, '/'))"
_FORMAT = "CASE " + " ".join(f"WHEN {_SUFFIX} = '{k}' THEN '{v}'" for k, v in T.FORMATS.items()) + " END"


@query("src02_supported_files", f"WITH {PATHS} SELECT doc_id, path FROM p WHERE {_SUFFIX} IN ({', '.join(repr(k) for k in T.FORMATS)})")
def src02(spark, d):
    return paths(spark, d).where(T.suffix(F.col("path")).isin(*T.FORMATS)).select("doc_id", "path")


@query("src03_format_of_suffix", f"WITH {PATHS} SELECT doc_id, {_SUFFIX} AS suffix, {_FORMAT} AS format FROM p")
def src03(spark, d):
    return paths(spark, d).select("doc_id", T.suffix(F.col("path")).alias("suffix"), T.format_of(F.col("path")).alias("format"))


@query("cln01_clean_text", """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  nfc_normalize(replace(replace(replace(text, ' ', ' ' || chr(9) || chr(7)), 'é', 'e' || chr(769)), 'an', 'a' || chr(776) || chr(772) || 'n')), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), ' \\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text
  FROM documents""")  # fmt: skip
def cln01(spark, d):
    dirty = F.col("text")  # letters taken apart, with one and two marks
    for a, b in ((" ", " \t\x07"), ("é", "e\u0301"), ("an", "a\u0308\u0304n")):
        dirty = F.replace(dirty, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", T.clean_text(dirty).alias("text"))


@query("cln02_repair_breaks", """WITH b AS (SELECT doc_id, regexp_replace(text, '([a-z])([a-z]{2}[ ,.])', '\\1' || chr(173) || '\\2', 'g') AS t FROM documents)
  SELECT doc_id, replace(t, chr(173), '') AS text FROM b""")  # fmt: skip
def cln02(spark, d):
    broken = F.regexp_replace("text", "([a-z])([a-z]{2}[ ,.])", "$1\u00ad$2")
    return table(spark, d, "documents").select("doc_id", T.repair_breaks(broken).alias("text"))


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query("cln03_break_evidence", f"""WITH w AS (SELECT unnest({_TOKENS}) AS t FROM documents), v AS (SELECT t, count(*) AS n FROM w GROUP BY t),
  s AS (SELECT DISTINCT t[1:length(t) // 2] AS l, t[length(t) // 2 + 1:] AS r FROM v WHERE length(t) >= 6),
  j AS (SELECT l, r, coalesce(a.n, 0) AS joined, coalesce(b.n, 0) AS apart FROM s LEFT JOIN v a ON a.t = l || r LEFT JOIN v b ON b.t = r || l)
  SELECT l AS left_half, r AS right_half, joined, apart, CASE WHEN joined >= apart THEN '' ELSE '-' END AS sign FROM j WHERE joined + apart > 0""")  # fmt: skip
def cln03(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.search_terms(F.col("text"))).alias("t"))
    vocabulary = words.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    half = F.floor(F.char_length("t") / 2).cast("int")
    pairs = vocabulary.where(F.char_length("t") >= 6).select(F.substr("t", F.lit(1), half).alias("l"), F.substr("t", half + 1).alias("r")).distinct()
    from ..operators.ingest import break_evidence

    return break_evidence(pairs, vocabulary, F.concat("l", "r"), F.concat("r", "l"))


@query("cln04_apply_break_map", f"""WITH b AS (SELECT doc_id, text, replace(text, 'tion ', 'ti' || chr(173) || 'on ') AS broken FROM documents),
  c AS (SELECT doc_id, broken, replace(broken, chr(173), '') AS cleaned FROM b)
  SELECT doc_id, cleaned <> broken AS changed, CASE WHEN cleaned <> broken THEN {words_sql('cleaned')} END AS num_tokens FROM c""")  # fmt: skip
def cln04(spark, d):
    broken = F.replace("text", F.lit("tion "), F.lit("ti\u00adon "))
    x = table(spark, d, "documents").select("doc_id", broken.alias("broken"), T.repair_breaks(broken).alias("cleaned"))
    changed = F.col("cleaned") != F.col("broken")
    return x.select("doc_id", changed.alias("changed"), F.when(changed, T.word_count(F.col("cleaned"))).alias("num_tokens"))


def _language_sql() -> str:
    w = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
    counts = ", ".join(f"len(list_filter({w}, lambda x: list_contains({[*ws.split()]}, x))) AS {k}" for k, ws in T.LANGUAGE_WORDS.items())
    top = f"greatest({', '.join(T.LANGUAGE_WORDS)})"
    case = " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in T.LANGUAGE_WORDS)
    return f"WITH c AS (SELECT doc_id, text, {counts} FROM documents) SELECT doc_id, CASE WHEN length(trim(text)) >= 20 AND {top} > 0 THEN CASE {case} END END AS lang FROM c"


@query("lng01_detect_language", _language_sql())
def lng01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("lang"))


@query("id01_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS id FROM documents")
def id01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_id(F.col("text")).alias("id"))


@query("id02_normal_path", f"WITH {PATHS} SELECT doc_id, lower(trim({_SLASH}, '/')) AS path FROM p")
def id02(spark, d):
    return paths(spark, d).select("doc_id", T.normal_path(F.col("path")).alias("path"))


_MANIFEST = f"m AS (SELECT lower({_SLASH}) AS path_norm, lower({_NAME}) AS name_norm, 'D' || CAST(doc_id // 3 AS VARCHAR) AS id FROM p WHERE doc_id % 2 = 0)"


def manifest(spark, d):
    p = paths(spark, d).where("doc_id % 2 = 0")
    return p.select(T.normal_path(F.col("path")).alias("path_norm"), F.lower(T.file_name(F.col("path"))).alias("name_norm"), F.concat(F.lit("D"), F.floor(F.col("doc_id") / 3).cast("string")).alias("id"))


@query("id03_ambiguous_names", f"WITH {PATHS}, {_MANIFEST} SELECT name_norm, count(DISTINCT id) AS n FROM m GROUP BY name_norm HAVING count(DISTINCT id) > 1")
def id03(spark, d):
    from ..operators.ingest import ambiguous_names

    return ambiguous_names(manifest(spark, d))


@query("id04_lookup_chain", f"""WITH {PATHS}, {_MANIFEST},
  bp AS (SELECT path_norm, min(id) AS path_id FROM m GROUP BY path_norm),
  bn AS (SELECT name_norm, min(id) AS name_id FROM m GROUP BY name_norm HAVING count(DISTINCT id) = 1)
  SELECT doc_id, coalesce(path_id, name_id, substr(sha256(text), 1, 16)) AS id FROM p
  LEFT JOIN bp ON bp.path_norm = lower({_SLASH}) LEFT JOIN bn ON bn.name_norm = lower({_NAME})""")  # fmt: skip
def id04(spark, d):
    from ..operators.ingest import assign_ids

    return assign_ids(paths(spark, d), manifest(spark, d)).select("doc_id", "id")


@query("id05_topic_of_folder", f"WITH {PATHS} SELECT doc_id, CAST(nullif(regexp_extract({_SLASH}, '^F([0-9])_[^/]*/', 1), '') AS INTEGER) AS topic FROM p")
def id05(spark, d):
    return paths(spark, d).select("doc_id", T.topic_of(F.col("path")).alias("topic"))


@query("id06_source_name", f"WITH {PATHS} SELECT doc_id, {_NAME} AS source FROM p")
def id06(spark, d):
    return paths(spark, d).select("doc_id", T.file_name(F.col("path")).alias("source"))


@query("id07_manifest_documents_only", f"WITH {PATHS}, {_MANIFEST} SELECT doc_id FROM p WHERE lower({_SLASH}) IN (SELECT path_norm FROM m)")
def id07(spark, d):
    p = paths(spark, d).withColumn("path_norm", T.normal_path(F.col("path")))
    return p.join(manifest(spark, d), "path_norm", "left_semi").select("doc_id")


_STEM = f"regexp_replace({_NAME}, '\\.[A-Za-z]+$', '')"


@query("id08_collection", f"WITH {PATHS} SELECT doc_id, coalesce(nullif(regexp_extract({_STEM}, '^(F[0-9]-[A-Z]+)-', 1), ''), {_STEM}) AS collection FROM p")
def id08(spark, d):
    stem = F.regexp_replace(T.file_name(F.col("path")), "\\.[A-Za-z]+$", "")
    return paths(spark, d).select("doc_id", T.collection_of(stem).alias("collection"))


@query("id09_observatory", f"WITH {PATHS} SELECT doc_id, regexp_replace({_STEM}, '-[^-]*$', '') AS observatory FROM p")
def id09(spark, d):
    stem = F.regexp_replace(T.file_name(F.col("path")), "\\.[A-Za-z]+$", "")
    return paths(spark, d).select("doc_id", T.observatory_of(stem).alias("observatory"))


_PHRASE = f"regexp_replace(regexp_replace(regexp_replace({_STEM}, '^[A-Z0-9]+-', ''), '[-_.]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"


@query("id10_name_phrase", f"""WITH {PATHS} SELECT doc_id, array_to_string(list_filter(string_split(lower({squeeze_sql(_PHRASE)}), ' '),
  lambda x: NOT regexp_matches(x, '^[0-9]+$|^[a-z]{{1,3}}[0-9]+$') AND x NOT IN ('final', 'report', 'pdf', '')), ' ') AS phrase FROM p""")  # fmt: skip
def id10(spark, d):
    return paths(spark, d).select("doc_id", T.name_phrase(T.file_name(F.col("path"))).alias("phrase"))


@query("qry01_unaccent", f"SELECT doc_id, {unaccent_sql('text')} AS text FROM documents")
def qry01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unaccent(F.col("text")).alias("text"))


#: A glossary over the tables' invented words.
WORDS = (("thin", "thin slender"), ("tion", "nation state"), ("que", "what"), ("ung", "ing form"), ("ación", "action"), ("nation", "nation state"))
_EXPAND = "list_distinct(list_filter([{}], lambda x: x IS NOT NULL))".format(", ".join(f"CASE WHEN contains({unaccent_sql('text')}, '{t}') THEN '{f}' END" for t, f in WORDS))
_HITS = """g AS (SELECT item_id, text, unnest([{}]) AS f, generate_subscripts([{}], 1) AS i FROM benchmark)""".format(*[", ".join(f"CASE WHEN contains({unaccent_sql('text')}, '{t}') THEN '{f}' END" for t, f in WORDS)] * 2)
_ORDERED = f"{_HITS}, h AS (SELECT item_id, f, min(i) AS o FROM g WHERE f IS NOT NULL GROUP BY item_id, f), e AS (SELECT item_id, string_agg(f, ' ' ORDER BY o) AS extra, count(*) AS n FROM h GROUP BY item_id)"


@query("qry02_glossary_hits", f"WITH {_ORDERED} SELECT item_id, extra, n FROM e")
def qry02(spark, d):
    hits = table(spark, d, "benchmark").select("item_id", T.glossary_hits(F.col("text"), WORDS).alias("h"))
    return hits.where(F.size("h") > 0).select("item_id", F.array_join("h", " ").alias("extra"), F.size("h").cast("bigint").alias("n"))


@query("qry03_expand_query", f"WITH {_ORDERED} SELECT b.item_id, CASE WHEN extra IS NULL THEN text ELSE text || ' ' || extra END AS text FROM benchmark b LEFT JOIN e USING (item_id)")
def qry03(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.expand_query(F.col("text"), WORDS).alias("text"))


_AUDIT = " UNION ALL ".join(
    f"SELECT '{t}' AS term, lang, count(*) FILTER (WHERE contains({unaccent_sql('text')}, '{t}')) AS n_term, count(*) FILTER (WHERE contains(lower(text), '{f}')) AS n_form FROM documents GROUP BY lang" for t, f in WORDS
)


@query("qry04_glossary_audit", _AUDIT)
def qry04(spark, d):
    from ..operators.retrieve import glossary_audit

    return glossary_audit(table(spark, d, "documents"), WORDS, "lang")


_RECENT = "(?i)(^|[^\\p{L}\\p{N}_])(recient|actual|últim|ultim|hoy([^\\p{L}\\p{N}_]|$)|nuevo|emergent|coyuntur|vigente|ahora([^\\p{L}\\p{N}_]|$)|moderno|(recent|current|latest)([^\\p{L}\\p{N}_]|$)|20[12][0-9]([^\\p{L}\\p{N}_]|$))"


@query("qry05_asks_for_recent", f"WITH t AS (SELECT doc_id, text || ' ' || CAST(1990 + doc_id % 60 AS VARCHAR) || ' ' AS t FROM documents) SELECT doc_id, regexp_matches(t, '{_RECENT}') AS recent FROM t")
def qry05(spark, d):
    t = F.concat("text", F.lit(" "), (1990 + F.col("doc_id") % 60).cast("string"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", T.asks_for_recent(t).alias("recent"))


@query("qry06_year_of_source", f"""WITH {PATHS} SELECT doc_id, list_max(list_filter([CAST(y AS INTEGER) FOR y IN regexp_extract_all({_NAME} || '-2031-1995', '(?:19|20)[0-9]{{2}}')],
  lambda y: y BETWEEN 1990 AND 2026)) AS year FROM p""")  # fmt: skip
def qry06(spark, d):
    return paths(spark, d).select("doc_id", T.year_of(F.concat(T.file_name(F.col("path")), F.lit("-2031-1995"))).alias("year"))


@query("qry07_content_tokens", f"SELECT doc_id, list_sort({content_sql('text')}) AS tokens FROM documents")
def qry07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sort_array(T.content_tokens(F.col("text"))).alias("tokens"))


#: Bibliography appended to texts that have none.
CITED = ' [12] "The invented title of a source," accessed March 3, 2019, https://example.org/a. 7 Authors, et al., vol. 3.'


def signs_sql(c: str) -> str:
    one = lambda p: f"CAST(regexp_matches({c}, '{p}') AS INTEGER)"
    return f"regexp_matches({c}, '{T.LINK}') OR {one(T.QUOTED)} + {one(T.DATED)} + {one(T.REFERENCE)} + {one(T.NOTE)} >= 2"


@query("qry09_is_reference", f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[3] ' || text || ', accessed May 4, 2011.' WHEN doc_id % 3 = 1 THEN text || ' www.example.org' ELSE text END AS t FROM documents) SELECT doc_id, {signs_sql('t')} AS reference FROM t")
def qry09(spark, d):
    n, t = F.col("doc_id") % 3, F.col("text")
    mixed = F.when(n == 0, F.concat(F.lit("[3] "), t, F.lit(", accessed May 4, 2011."))).when(n == 1, F.concat(t, F.lit(" www.example.org"))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", T.is_reference(mixed).alias("reference"))


@query("qry08_reference_segments")
def qry08(spark, d):
    t = F.concat("text", F.lit(CITED))
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.segments(t)).alias("pos", "segment"))


@query("qry10_reference_share")
def qry10(spark, d):
    shares = F.transform(F.array(T.reference_share(F.concat("text", F.lit(CITED)))), lambda x: F.struct(F.round(x, 6).alias("share"), F.round(1 - x, 6).alias("quality")))
    return table(spark, d, "documents").select("doc_id", F.inline(shares))


def _shingles_sql(c: str) -> str:
    w = f"string_split({squeeze_sql(unaccent_sql(c))}, ' ')"
    return f"list_distinct([array_to_string({w}[i:i + 4], ' ') FOR i IN generate_series(1, greatest(len({w}) - 4, 1))])"


@query("qry11_shingle_jaccard", f"""WITH s AS (SELECT turn, conv_id, {_shingles_sql('text')} AS s FROM conversations WHERE role = 'user')
  SELECT a.conv_id, a.turn, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS similarity
  FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2""")  # fmt: skip
def qry11(spark, d):
    s = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.shingles(F.col("text")).alias("s"))
    b = s.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("s").alias("t"))
    return s.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("t")), 6).alias("similarity"))


@query("qry13_dedup_key", f"SELECT lower({squeeze_sql('text')}) AS key, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def qry13(spark, d):
    g = table(spark, d, "documents").groupBy(T.dedup_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1")


@query("qry14_long_field", "SELECT event_id, coalesce(CASE WHEN length(event_type) > 25 THEN event_type END, CASE WHEN length(props) > 25 THEN props END) AS field FROM events")
def qry14(spark, d):
    long = lambda c: F.when(F.char_length(c) > 25, F.col(c))
    return table(spark, d, "events").select("event_id", F.coalesce(long("event_type"), long("props")).alias("field"))


@query("qry15_shuffled_words", f"WITH w AS (SELECT item_id, string_split({squeeze_sql('text')}, ' ') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w) SELECT item_id, string_agg(x, ' ' ORDER BY md5(x || ' ' || i || ' 11'), x) AS text FROM u GROUP BY item_id")
def qry15(spark, d):
    w = F.split(T.squeeze(F.col("text")), " ")
    keyed = F.array_sort(F.transform(w, lambda x, i: F.struct(F.md5(F.concat_ws(" ", x, i.cast("string"), F.lit("11"))).alias("k"), x.alias("w"))))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(keyed, lambda x: x["w"]), " ").alias("text"))


@query("chk06_word_count", f"SELECT doc_id, {words_sql('text')} AS n FROM documents")
def chk06(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("qry12_topic_classifier", f"""WITH d AS (SELECT doc_id, doc_id % 3 + 1 AS topic, lang, list_distinct({_TOKENS}) AS w FROM documents),
  n AS (SELECT topic, lang, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT doc_id, topic, lang, unnest(w) AS term FROM d),
  s AS (SELECT topic, term, sum(df / CAST(n AS DOUBLE)) AS share FROM (SELECT topic, lang, term, count(*) AS df FROM e GROUP BY ALL) JOIN n USING (topic, lang) GROUP BY topic, term),
  p AS (SELECT topic, term, share / sum(share) OVER (PARTITION BY term) AS p FROM s),
  b AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
  a AS (SELECT item_id, topic, round(sum(p), 6) AS score FROM b JOIN p USING (term) GROUP BY ALL)
  SELECT i.item_id, r.topic FROM benchmark i LEFT JOIN (SELECT item_id, topic FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, topic) = 1) r USING (item_id)""")  # fmt: skip
def qry12(spark, d):
    from ..operators.retrieve import classify_topics, topic_terms

    docs = table(spark, d, "documents").withColumn("topic", F.col("doc_id") % 3 + 1)
    return classify_topics(table(spark, d, "benchmark"), topic_terms(docs), "item_id")
