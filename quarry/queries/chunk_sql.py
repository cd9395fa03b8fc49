"""SQL for packing: sentences one by one in a recursive table, as rows (document, section, sentence)."""

from __future__ import annotations

from .text import words_sql

_SENT = "regexp_replace(regexp_replace({0}, '([.!?…][\"”»)]*)\\s+([\"“«(¿¡\\p{{Lu}}0-9])', '\\1' || chr(1) || '\\2', 'g'), '((^|[^\\p{{L}}])(Dr|Sr|Sra|Mr|Mrs|Ms|St|No|vs|etc|Inc|Jr|U\\.S|e\\.g|i\\.e)\\.)' || chr(1), '\\1 ', 'g')"


def sentences_sql(c: str) -> str:
    return f"list_filter([trim(x) FOR x IN string_split({_SENT.format(c)}, chr(1))], lambda x: x <> '')"


_WORDS = "regexp_split_to_array({0}, '\\s+')"

#: Sentences (s) of each section (j) of the documents.
SECTIONS = f"""hd AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{{1,6}})[ \\t]+([^\\n]*)$', chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS parts FROM documents),
  pt AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS j FROM hd),
  sc AS (SELECT doc_id, j, CASE WHEN contains(p, chr(2)) THEN trim(string_split(p, chr(2))[1]) END AS section, regexp_replace(CASE WHEN contains(p, chr(2)) THEN string_split(p, chr(2))[-1] ELSE p END, '^\\s+|\\s+$', '', 'g') AS body FROM pt),
  pl AS (SELECT doc_id, j, section, list_filter([trim(x) FOR x IN regexp_split_to_array(body, '\\n\\n+')], lambda x: x <> '') AS q FROM sc WHERE body <> ''),
  pg AS (SELECT doc_id, j, section, unnest(q) AS para, generate_subscripts(q, 1) AS k FROM pl),
  ss AS (SELECT doc_id, j, any_value(section) AS section, flatten(list({sentences_sql('para')} ORDER BY k)) AS s FROM pg GROUP BY doc_id, j)"""


def packed(name: str, source: str, budget: int, overlap: int) -> str:
    """Table ``name`` (doc_id, pos, section, text, num_tokens) from ``source`` (doc_id, j, section, s); an overlap of one sentence or none.

    A step adds a sentence: ``first`` is where the open chunk begins, ``n`` its words.
    """
    fits = f"n + z[i + 1] <= {budget}"
    keep = f"z[i] + z[i + 1] <= {budget}" if overlap else "false"
    return f"""{name}_z AS (SELECT doc_id, j, section, s, [len({_WORDS.format('x')}) FOR x IN s] AS z FROM {source} WHERE len(s) > 0),
  {name}_r AS (SELECT doc_id, j, z, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS first, z[1] AS n FROM {name}_z UNION ALL
    SELECT doc_id, j, z, i + 1, CASE WHEN {fits} THEN first WHEN {keep} THEN i ELSE i + 1 END, CASE WHEN {fits} THEN n + z[i + 1] WHEN {keep} THEN z[i] + z[i + 1] ELSE z[i + 1] END FROM {name}_r WHERE i < len(z)),
  {name}_g AS (SELECT doc_id, j, first, max(i) AS until FROM {name}_r GROUP BY ALL),
  {name}_t AS (SELECT doc_id, j, first, section, array_to_string(s[first:until], ' ') AS text FROM {name}_g JOIN {name}_z USING (doc_id, j)),
  {name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, first) - 1 AS pos, section, text, {words_sql('text')} AS num_tokens FROM {name}_t)"""


CHUNKS = f"{SECTIONS}, {packed('ck', 'ss', 280, 1)}"
CHUNK_ROWS = f"WITH RECURSIVE {CHUNKS} SELECT doc_id, pos, CAST(doc_id AS VARCHAR) || '-c' || lpad(CAST(pos AS VARCHAR), 4, '0') AS chunk_id, section, text, num_tokens FROM ck"
#: Chunks of 60 words with the sentences (s) of each and of the one before (b).
SMALL = f"{SECTIONS}, {packed('sm', 'ss', 60, 1)}, sl AS (SELECT doc_id, pos, section, text, {sentences_sql('text')} AS s FROM sm), sb AS (SELECT *, lag(s) OVER w AS b, lag(section) OVER w AS prior, lag(text) OVER w AS before FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
#: What each adds to the one before it in its section, and how many sentences (k) it repeats.
ADDED = f"{SMALL}, ad AS (SELECT *, CASE WHEN b IS NOT NULL AND section IS NOT DISTINCT FROM prior THEN list_max(list_filter(range(0, least(len(b), len(s)) + 1), lambda k: b[len(b) - k + 1:len(b)] = s[1:k])) ELSE 0 END AS k FROM sb)"
_PER = "ps AS (SELECT doc_id, section, min(pos) AS j, flatten(list(s[k + 1:len(s)] ORDER BY pos)) AS s FROM ad GROUP BY doc_id, section)"
OVERLAP_ROWS = f"WITH RECURSIVE {ADDED} SELECT doc_id, pos, k, len(s) - k AS n FROM ad"
REPACKED = f"WITH RECURSIVE {ADDED}, {_PER}, {packed('rp', 'ps', 120, 0)} SELECT doc_id, pos, section, text, num_tokens FROM rp"
_GRID = [(b, o) for b in (40, 120) for o in (0, 1)]
GRID = f"WITH RECURSIVE {ADDED}, {_PER}, {', '.join(packed(f'g{b}_{o}', 'ps', b, o) for b, o in _GRID)} " + " UNION ALL ".join(f"SELECT {b} AS budget, {o} AS overlap, count(*) AS chunks, round(avg(num_tokens), 4) AS mean_tokens FROM g{b}_{o}" for b, o in _GRID)
SHARED = f"WITH RECURSIVE {SMALL} SELECT doc_id, pos, CASE WHEN before IS NULL THEN 0 ELSE list_max(list_filter(range(0, least(length(before), length(text)) + 1), lambda k: right(before, k) = left(text, k))) END AS shared FROM sb"
#: Leading sentences go that the last two of the chunk before hold.
LOOSE = f"""WITH RECURSIVE {SMALL}, lo AS (SELECT doc_id, pos, s, coalesce(list_min(list_filter(range(1, len(s) + 1), lambda i: NOT list_contains(coalesce(b[greatest(len(b) - 1, 1):len(b)], []), s[i]))), len(s) + 1) AS a FROM sb),
  ls AS (SELECT doc_id, 1 AS j, NULL AS section, flatten(list(s[a:len(s)] ORDER BY pos)) AS s FROM lo GROUP BY doc_id), {packed('lp', 'ls', 120, 0)} SELECT doc_id, pos, text, num_tokens FROM lp"""
#: Sentences of more than 250 words are cut first.
_CUT = f"flatten([[array_to_string({_WORDS.format('x')}[i * 250 + 1:i * 250 + 250], ' ') FOR i IN range(0, CAST(ceil(len({_WORDS.format('x')}) / 25e1) AS BIGINT))] FOR x IN {sentences_sql('text')}])"
SPLIT = f"WITH RECURSIVE fs AS (SELECT doc_id, 1 AS j, NULL AS section, {_CUT} AS s FROM documents), {packed('fp', 'fs', 250, 0)} SELECT doc_id, pos AS part, text, num_tokens AS n FROM fp"
