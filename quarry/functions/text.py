"""Text features of documents, chunks and queries as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks, which follow the letter that they change.
MARKS = "".join(chr(k) for k in range(0x300, 0x370))


def _letters() -> tuple[str, str, list[tuple[str, str]]]:
    """From Unicode's tables: letters with marks, the letters without them, and (letter, mark) sequences with the letter they make."""
    marked, bare, made = [], [], []
    for k in range(0xA0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(k))
        rest = "".join(c for c in whole if not unicodedata.combining(c))
        if len(rest) == 1 and rest != chr(k) and chr(k).lower() == chr(k):
            marked.append(chr(k))
            bare.append(rest)
        pair = unicodedata.decomposition(chr(k)).split()
        if len(pair) == 2 and not pair[0].startswith("<") and unicodedata.normalize("NFC", chr(k)) == chr(k):
            made.append(("".join(chr(int(x, 16)) for x in pair), chr(k), len(whole)))
    return "".join(marked), "".join(bare), [(a, b) for a, b, _ in sorted(made, key=lambda x: x[2])]


ACCENTED, PLAIN, COMPOSED = _letters()

#: Function words that say nothing about what a passage covers.
STOP_WORDS = tuple(
    """
para como cual cuales cuanto cuantos donde desde entre sobre segun hacia hasta
ante bajo cabe contra durante mediante salvo tras esta este estos estas esos
esas aquel aquella ellos ellas nosotros vosotros pero sino aunque porque
cuando mientras siempre nunca tambien tanto tanta menos mismo misma otro otra
otros otras cada todo toda todos todas algun alguna algunos algunas ningun
ninguna mucho mucha muchos muchas poco poca pocos pocas
that this these those with from have been they their there where which what
when while about into over under between during through after before more
most such than then them your ours will would could should because being
""".split()
)

#: File suffix and format; other suffixes aren't read.
FORMATS = {
    "pdf": "pdf", "html": "html", "htm": "html", "md": "md", "txt": "md", "json": "json",
    "csv": "csv", "xlsx": "xlsx", "png": "img", "jpg": "img", "jpeg": "img", "pbf": "pbf",
}
READABLE = ("es", "en", "pt")
MIN_YEAR, MAX_YEAR = 1990, 2026
#: What a line break in a typeset word is extracted as.
BREAKS = "￾­"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often f uses it: a lambda's argument is a variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_pairs(c: Column) -> Column:
    """Distinct hashes of neighbouring words."""

    def pairs(v: Column) -> Column:
        n = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda a, b: F.xxhash64(a, b))

    return F.array_distinct(bind(F.split(c, " "), pairs))


def unaccent(c: Column) -> Column:
    """Lower case without accents, be they part of a letter or marks of their own."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED + MARKS, PLAIN)


def composed(c: Column) -> Column:
    """Letters and the marks behind them as one character where there is one (NFC of alphabets below U+2000)."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in COMPOSED))
    return F.when(c.rlike(f"[{MARKS[0]}-{MARKS[-1]}]"), F.aggregate(pairs, c, lambda s, p: F.replace(s, p["a"], p["b"]))).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))


def clean_text(c: Column) -> Column:
    """Letters composed, control characters out, spaces collapsed, at most one blank line, trimmed; in this order."""
    c = composed(c)
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", "")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, " \\n", "\n")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def repair_breaks(c: Column) -> Column:
    """Words cut at a line end.

    A break at a word's edge goes.  It stands for a hyphen before a capital or a
    digit, after a digit, and after a short acronym; else the halves are one word.
    """
    cut = f"[{BREAKS}]"
    c = F.regexp_replace(c, f"(?<![\\p{{L}}\\p{{N}}_]){cut}|{cut}(?![\\p{{L}}\\p{{N}}_])", "")
    c = F.regexp_replace(c, f"{cut}(?=[\\p{{Lu}}\\p{{Nd}}])|(?<=\\p{{Nd}}){cut}", "-")
    c = F.regexp_replace(c, f"(?<![\\p{{L}}\\p{{N}}_])(\\p{{Lu}}{{1,4}}){cut}", "$1-")
    return F.regexp_replace(c, cut, "")


def word_count(c: Column) -> Column:
    s = squeeze(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def search_terms(c: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Distinct unaccented words of four characters or more that aren't stop words."""
    found = F.regexp_extract_all(unaccent(c), F.lit("[a-z0-9]{4,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def dedup_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct n-word runs of the unaccented text; a shorter text is one run."""
    w = F.split(squeeze(unaccent(c)), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.array_distinct(runs)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Stems and words by which a query asks for recent material.
TEMPORAL = (
    "(?i)(^|[^\\p{L}\\p{N}_])(recient|actual|últim|ultim|hoy([^\\p{L}\\p{N}_]|$)|nuevo|emergent|coyuntur|vigente|ahora([^\\p{L}\\p{N}_]|$)|moderno"
    "|(recent|current|latest)([^\\p{L}\\p{N}_]|$)|20[12][0-9]([^\\p{L}\\p{N}_]|$))"
)


def asks_for_recent(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(TEMPORAL)


def year_of(source: Column) -> Column:
    """The latest plausible year in a file name."""
    years = F.transform(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit("(?:19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: (y >= MIN_YEAR) & (y <= MAX_YEAR)))


def content_id(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def normal_path(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+|/+$", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def format_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in FORMATS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def topic_of(path: Column) -> Column:
    """From a top folder ``F<n>_...``, else null."""
    return F.nullif(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "^F([0-9])_[^/]*/", 1), F.lit("")).cast("int")


def collection_of(doc_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(doc_id, "^(F[0-9]-[A-Z]+)-", 1), F.lit("")), doc_id)


def observatory_of(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, "-[^-]*$", "")


def name_phrase(name: Column, noise: tuple[str, ...] = ("final", "report", "pdf")) -> Column:
    """A file name as words: prefix, digits, codes and noise words out, camel case apart."""
    c = F.regexp_replace(F.regexp_replace(name, "\\.[A-Za-z0-9]+$", ""), "^[A-Z0-9]+-", "")
    c = F.regexp_replace(F.regexp_replace(c, "[-_.]+", " "), "([a-z])([A-Z])", "$1 $2")
    w = F.filter(F.split(F.lower(squeeze(c)), " "), lambda x: ~x.rlike("^[0-9]+$|^[a-z]{1,3}[0-9]+$") & ~x.isin(*noise) & (x != ""))
    return F.array_join(w, " ")


#: The patterns of bibliographic matter; a link is enough, of the others it takes two.
LINK = "(?i)https?://|www\\.[a-z0-9_]|doi\\.org/|(^|[^a-z0-9_])doi:"
NOTE = "^\\s*(\\[[0-9]{1,4}\\]|[0-9]{1,4})[.,]?\\s+[\"“«A-ZÀ-ÞА-Я]"
QUOTED = "[\"“«][^\"”»]{12,}[\"”»]\\s*[,.]"
#: Month names of three languages.
MONTHS = (
    "January February March April May June July August September October November December "
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre "
    "janeiro fevereiro março marco maio junho julho setembro outubro novembro dezembro"
).split()
DATED = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(MONTHS)})\\s+[0-9]{{1,2}},?\\s+[0-9]{{4}}([^0-9]|$)"
#: The vocabulary of references.
REFERENCE_WORDS = (
    "et al\\.", "accessed([^a-z]|$)", "consultado([^a-z]|$)", "acesso em([^a-z]|$)", "vol\\.", "no\\.\\s*[0-9]", "pp?\\.\\s*[0-9]",
    "ibid([^a-z]|$)", "op\\. cit\\.", "eds?\\.,", "retrieved([^a-z]|$)", "disponible en([^a-z]|$)", "available at([^a-z]|$)",
)
REFERENCE = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(REFERENCE_WORDS)})"


def is_reference(segment: Column) -> Column:
    signs = sum((segment.rlike(p).cast("int") for p in (QUOTED, DATED, REFERENCE)), segment.rlike(NOTE).cast("int"))
    return segment.rlike(LINK) | (signs >= 2)


#: Where prose or an entry ends, after a full stop (and up to three glued note digits), before a note's number.
CUT = (
    "(?<=[.!?;])\\s+(?=[\"“«A-ZÀ-ÞА-Я\\[0-9])|(?<=[.!?][0-9]{1,3})\\s+"
    "|\\s+(?=\\[[0-9]{1,4}\\]\\s*[\"“«A-ZÀ-Þ])|\\s+(?=[0-9]{1,4}\\s+[\"“«])|\\s+(?=[0-9]{1,4}\\s+[A-ZÀ-Þ][a-zà-þ]+[,\\s])"
)
MIN_SEGMENT_WORDS = 4


def segments(c: Column) -> Column:
    """Sentences or bibliography entries; what has fewer than four words belongs to the one before."""
    raw = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), CUT), squeeze), lambda s: s != "")

    def joined(r: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (F.size(F.split(F.get(r, i), " ")) >= MIN_SEGMENT_WORDS))
        piece = lambda b: F.transform(b, lambda s, j: F.array_join(F.slice(r, s + 1, F.coalesce(F.get(b, j + 1), F.size(r)) - s), " "))
        return F.when(F.size(r) > 0, bind(begins, piece)).otherwise(F.array().cast("array<string>"))

    return bind(raw, joined)


def reference_share(c: Column) -> Column:
    """Share of words in reference segments; an empty text is all reference."""
    count = lambda arr: F.aggregate(arr, F.lit(0), lambda n, x: n + F.size(F.split(x, " ")))
    return bind(segments(c), lambda s: F.when(F.size(s) == 0, F.lit(1.0)).otherwise(count(F.filter(s, is_reference)) / count(s)))


#: Query terms (unaccented) and the forms that the corpus uses, in table order.
GLOSSARY = (
    ("nbqr", "CBRN chemical biological radiological nuclear"),
    ("contraespacial", "counterspace"),
    ("contraespaciales", "counterspace"),
    ("guerra electronica", "electronic warfare jamming"),
    ("energia dirigida", "directed energy weapons"),
    ("antisatelite", "anti-satellite ASAT"),
    ("desechos orbitales", "orbital debris space debris"),
    ("reabastecimiento en orbita", "on-orbit servicing refueling"),
    ("servicio y reabastecimiento", "on-orbit servicing"),
    ("operaciones espaciales dinamicas", "dynamic space operations"),
    ("enjambres de drones", "drone swarms"),
    ("semiconductores", "semiconductors"),
    ("derecho internacional en el espacio", "international space law"),
    ("dominio espacial", "space domain"),
    ("sistemas no tripulados", "unmanned systems UAV"),
)


def glossary_hits(c: Column, table=GLOSSARY) -> Column:
    """Distinct expansions of the table's terms that occur in the text, in table order."""
    q = unaccent(c)
    hits = F.array(*(F.when(F.instr(q, term) > 0, F.lit(form)) for term, form in table))
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def expand_query(c: Column, table=GLOSSARY) -> Column:
    extra = glossary_hits(c, table)
    return F.when(F.size(extra) > 0, F.concat_ws(" ", c, F.array_join(extra, " "))).otherwise(c)


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! ? or … and white space before a capital, digit or opening sign, not after common abbreviations."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), "([.!?…][\"”»)]*)\\s+([\"“«(¿¡\\p{Lu}0-9])", "$1\u0001$2")
    marked = F.regexp_replace(marked, "((^|[^\\p{L}])(Dr|Sr|Sra|Mr|Mrs|Ms|St|No|vs|etc|Inc|Jr|U\\.S|e\\.g|i\\.e)\\.)\u0001", "$1 ")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


#: A few very frequent words a language; the most frequent language of a text wins.
LANGUAGE_WORDS = {
    "de": "der die das und ist ein eine den von zu mit auf für im dem nicht auch",
    "en": "the of and to is that for on with as was by this are at from or an",
    "es": "el los las y del se por con una para no lo como su más",
    "fr": "le les des et un une du est pour dans qui sur par pas au avec",
    "pt": "os as do da em um uma não com para dos das ao pelo mais",
}


def detect_language(c: Column) -> Column:
    """The language of which most frequent words occur; null below twenty characters or without any."""

    def best(w: Column) -> Column:
        scores = F.array(*(F.struct(_hits(w, ws).alias("n"), F.lit(-ord(lang[0]) * 256 - ord(lang[1])).alias("o"), F.lit(lang).alias("lang")) for lang, ws in LANGUAGE_WORDS.items()))
        return F.array_max(scores)

    b = bind(search_terms(c), best)
    return F.when((F.char_length(F.trim(c)) >= 20) & (b["n"] > 0), b["lang"])


def _hits(w: Column, ws: str) -> Column:
    listed = ws.split()
    return F.size(F.filter(w, lambda x: x.isin(listed)))
