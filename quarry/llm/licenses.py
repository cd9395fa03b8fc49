"""License scans by fuzzy short-notice search.

Texts are lower-cased and reduced to words joined by single spaces.  Each
notice may be misspelt by one edit, longer ones by more.  By the pigeonhole
principle, a notice with at most k edits holds one of its k + 1 pieces
unchanged; one Aho-Corasick pass finds all pieces of all notices, and around
each find the regex library's bounded-error matching verifies the whole notice,
counts the edits and gives the span, which begins and ends between words.

Of spans of one notice that overlap, the one with fewest edits stays (ties: the
first, then the shorter).  A span yields to a base place or a span of another
notice that has fewer edits and covers all but ``LEFT_OVER`` characters of it:
what reads ``cc by nd`` or ``cc by and`` isn't a misspelt ``cc by nc``.  The work is in proportion to the text and the pieces found.

Base phrases are matched exactly, word by word, and always reported.

The scan is one narrow pass over the texts, without a shuffle; every text is
read whole.

Nulls: a null text has no words, no places and no labels, and scores 0.  Null
doc_ids stay null; repeated rows are scanned one by one.  An empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_PHRASE = {label: phrase for phrase, label in BASE.items()}
#: Notices in normal form and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "reserved",
    "proprietary and confidential": "proprietary",
}
#: One edit for so many characters, and one at least.
CHARS_PER_EDIT = 10
LEFT_OVER = 4
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

SPAN = "struct<label:string,first_word:bigint,start:bigint,end:bigint,edits:int,found:string>"


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length."""
    k = edits_allowed(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def _machine():
    seeds: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for at, piece in pieces(notice):
            seeds.setdefault(piece, []).append((notice, at))
    machine = ahocorasick.Automaton()
    for piece, where in seeds.items():
        machine.add_word(piece, (len(piece), where))
    machine.make_automaton()
    bounded = {n: regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={edits_allowed(n)}}}(?![^ ])") for n in NOTICES}
    exact = {p: re.compile(f"(?<![^ ]){re.escape(p)}(?![^ ])") for p in BASE}
    return machine, bounded, exact


Span = tuple[int, int, int, str]  # edits, start, end, notice


def _best(spans: set[Span], base: list[Span]) -> list[Span]:
    """Of each notice the spans that no better one overlaps, without those that a base place or another notice explains better."""
    kept: list[Span] = []
    by_notice: dict[str, list[Span]] = {}
    for s in spans:
        by_notice.setdefault(s[3], []).append(s)
    for group in by_notice.values():
        starts: list[int] = []
        own: list[Span] = []  # disjoint, by start
        for s in sorted(group):
            i = bisect.bisect(starts, s[1])
            if (i == 0 or own[i - 1][2] <= s[1]) and (i == len(own) or s[2] <= own[i][1]):
                starts.insert(i, s[1])
                own.insert(i, s)
        kept += own
    better = sorted(kept + base, key=lambda s: s[1])
    longest = max((s[2] - s[1] for s in better), default=0)
    starts = [s[1] for s in better]
    out = []
    for s in kept:
        near = better[bisect.bisect_left(starts, s[1] - longest) : bisect.bisect_left(starts, s[2])]  # disjoint for each notice and phrase
        if not any(o[0] < s[0] and min(s[2], o[2]) - max(s[1], o[1]) >= s[2] - s[1] - LEFT_OVER for o in near):
            out.append(s)
    return out


def scan(text: str) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int, str]]]:
    """Of a text in normal form: base places (label, offset), and spans (label, start, end, edits, notice)."""
    machine, bounded, exact = _machine()
    base = [(label, m.start()) for phrase, label in BASE.items() if phrase in text for m in exact[phrase].finditer(text)]
    windows: set[tuple[str, int, int]] = set()
    for end, (size, where) in machine.iter(text):
        for notice, at in where:
            k = edits_allowed(notice)
            begin = end + 1 - size - at
            low, high = max(0, begin - k), min(len(text), begin + len(notice) + k)
            # a match begins and ends between words, so the window may shrink to where words do
            low = 0 if low == 0 else text.find(" ", low - 1) + 1
            high = len(text) if high == len(text) else text.rfind(" ", 0, high + 1)
            if 0 < high - low and (low or text[0] != " "):
                windows.add((notice, low, high))
    spans: set[Span] = set()
    for notice, low, high in windows:
        m = bounded[notice].search(text, low, high)
        if m:
            spans.add((sum(m.fuzzy_counts), m.start(), m.end(), notice))
    return base, sorted((NOTICES[n], a, z, e, n) for e, a, z, n in _best(spans, [(0, at, at + len(_PHRASE[label]), _PHRASE[label]) for label, at in base]))


def normal_form(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS, " "), " ")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label and word of each place), spans, score.

    Offsets of spans count code points of the normal form; ``score`` is the share
    of the best notice that is spelt right, 1 with a base place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            normal = normal_form(b.column("text"))
            counts = pc.if_else(pc.equal(normal, ""), 0, pc.add(pc.count_substring(normal, " "), 1)).cast(pa.int64())
            base, spans, scores = [], [], []
            for s in normal.to_pylist():
                exact, fuzzy = scan(s)
                spaces = [m.start() for m in re.finditer(" ", s)] if exact or fuzzy else []
                word = functools.partial(bisect.bisect_left, spaces)
                base.append([{"label": label, "word": word(at)} for label, at in exact])
                spans.append([{"label": label, "first_word": word(a), "start": a, "end": z, "edits": e, "found": s[a:z]} for label, a, z, e, _ in fuzzy])
                scores.append(1.0 if exact else max((1 - e / len(n) for _, _, _, e, n in fuzzy), default=0.0))
            place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
            span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("found", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), counts, pa.array(base, place), pa.array(spans, span), pa.array(scores, pa.float64())],
                ["doc_id", "n_words", "base", "spans", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words bigint, base array<struct<label:string,word:bigint>>, spans array<{SPAN}>, score double"
    return docs.select("doc_id", "text").mapInArrow(run, out)


def op5(docs: DataFrame) -> DataFrame:
    found = license_scan(docs)
    starts = F.col("base.word")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("spans.label"))).alias("labels"), "score", "spans",
    )
