"""Sections, sentences and chunks under a word budget.

Packing is sequential within a document, so it is a fold over the sizes of the
document's sentences that only notes where chunks begin and end: no shuffle, and
nothing grows beyond one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

BUDGET, OVERLAP = 280, 1
CHUNK = "array<struct<text:string,num_tokens:int>>"


#: A line that begins a section.
HEADING = "(?m)^(#{1,6})[ \\t]+([^\\n]*)$"


def heading_words(text: Column) -> Column:
    """Words of the heading lines, marks included: no chunk's text has them."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)), F.lit(0), lambda n, line: n + T.word_count(line))


def sections(text: Column) -> Column:
    """Array of (title, body): headings ``#`` to ``######`` begin a section; text before the first has no title; empty bodies go."""
    marked = F.regexp_replace(text, HEADING, "\u0001$2\u0002")
    parts = F.split(marked, "\u0001")

    def part(p: Column, i: Column) -> Column:
        titled = F.instr(p, "\u0002") > 0
        title = F.when(titled, F.trim(F.substring_index(p, "\u0002", 1)))
        body = F.when(titled, F.substring_index(p, "\u0002", -1)).otherwise(p)
        return F.struct(title.alias("title"), F.regexp_replace(body, "^\\s+|\\s+$", "").alias("body"))

    return F.filter(F.transform(parts, part), lambda s: s["body"] != "")


def section_sentences(body: Column) -> Column:
    """Paragraphs, then sentences."""
    paragraphs = F.filter(F.transform(F.split(body, "\\n\\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: T.sentences(p)))


def _size(s: Column) -> Column:
    return F.size(F.split(s, "\\s+"))


def pack(sentences: Column, budget: int = BUDGET, overlap: int = OVERLAP) -> Column:
    """Chunks of whole sentences of at most ``budget`` words.

    A chunk that is full is closed and its last ``overlap`` sentences begin the
    next, unless they leave no room for the sentence at hand.  A sentence above
    the budget is a chunk of its own.
    """
    none = F.array().cast("array<int>")
    state = F.struct(
        F.lit(0).alias("i"), F.lit(1).alias("first"), F.lit(0).alias("n"), none.alias("tail"), F.array().cast("array<struct<a:int,z:int>>").alias("done")
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    last = lambda a: F.slice(a, F.greatest(F.size(a) - overlap + 1, F.lit(1)), overlap) if overlap else none

    def step(a: Column, n: Column) -> Column:
        """``i`` sentences are through, the open chunk begins at ``first`` and has ``n`` words; ``tail`` has the sizes of its last sentences."""
        i = a["i"] + 1
        fits = (a["first"] > a["i"]) | (a["n"] + n <= budget)
        keep = total(a["tail"]) + n <= budget
        closed = F.concat(a["done"], F.array(F.struct(a["first"].alias("a"), a["i"].alias("z"))))
        add = lambda first, words, tail, done: F.struct(i.alias("i"), first.alias("first"), words.alias("n"), tail.alias("tail"), done.alias("done"))
        return (
            F.when(fits, add(a["first"], a["n"] + n, last(F.concat(a["tail"], F.array(n))), a["done"]))
            .when(keep, add(i - F.size(a["tail"]), total(a["tail"]) + n, last(F.concat(a["tail"], F.array(n))), closed))
            .otherwise(add(i, n, last(F.array(n)), closed))
        )

    end = lambda a: F.when(a["first"] <= a["i"], F.concat(a["done"], F.array(F.struct(a["first"].alias("a"), a["i"].alias("z"))))).otherwise(a["done"])

    def packed(s: Column) -> Column:
        groups = F.aggregate(F.transform(s, _size), state, step, end)
        texts = F.transform(groups, lambda g: F.array_join(F.slice(s, g["a"], g["z"] - g["a"] + 1), " "))
        return F.transform(texts, lambda t: F.struct(t.alias("text"), T.word_count(t).alias("num_tokens")))

    return T.bind(sentences, packed)


def pieces(text: Column, budget: int = BUDGET, overlap: int = OVERLAP) -> Column:
    """Array of (section, text, num_tokens): the chunks of a text, section by section."""
    parts = F.transform(sections(text), lambda s: F.transform(pack(section_sentences(s["body"]), budget, overlap), lambda c: F.struct(s["title"].alias("section"), c["text"].alias("text"), c["num_tokens"].alias("num_tokens"))))
    return F.flatten(parts)


def chunks(docs: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, pos, chunk_id, section, text, num_tokens; positions go on across sections."""
    out = docs.select("doc_id", F.posexplode(pieces(F.col("text"), budget, overlap)).alias("pos", "c"))
    return out.select("doc_id", "pos", chunk_id(F.col("doc_id"), F.col("pos")).alias("chunk_id"), "c.section", "c.text", "c.num_tokens")


def chunk_id(doc_id: Column, pos: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("-c"), F.lpad(pos.cast("string"), 4, "0"))


def blocks(docs: DataFrame) -> DataFrame:
    """Tabular documents: one chunk a block, whatever its size."""
    b = F.filter(F.transform(F.split("text", "\\n\\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(b).alias("pos", "text"))


def shared_edge(before: Column, now: Column) -> Column:
    """The longest suffix of one list of sentences that is a prefix of the next."""
    most = F.least(F.size(before), F.size(now))
    match = F.filter(F.sequence(F.lit(0), most), lambda k: F.slice(before, F.size(before) - k + 1, k) == F.slice(now, F.lit(1), k))
    return F.array_max(match)


def without_overlap(chunked: DataFrame) -> DataFrame:
    """doc_id, pos, section, sentences: what each chunk adds to the one before it in its section."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = chunked.withColumn("sentences", T.sentences(F.col("text")))
    s = s.withColumns({"before": F.lag("sentences").over(w), "prior": F.lag("section").over(w)})
    same = F.col("before").isNotNull() & F.col("section").eqNullSafe(F.col("prior"))
    k = F.when(same, shared_edge(F.col("before"), F.col("sentences"))).otherwise(0)
    added = s.withColumn("k", k).withColumn("added", F.slice("sentences", F.col("k") + 1, F.greatest(F.size("sentences") - F.col("k"), F.lit(0))))
    return added.select("doc_id", "pos", "section", "k", F.col("added").alias("sentences"))


def repack(chunked: DataFrame, budget: int, overlap: int) -> DataFrame:
    """The same text under another budget: overlaps out, sections packed anew."""
    rows = without_overlap(chunked)
    own = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentences"))), lambda x: x["sentences"])
    per = rows.groupBy("doc_id", "section").agg(F.min("pos").alias("first"), F.flatten(own).alias("s"))
    packed = per.select("doc_id", F.struct("first", F.col("section"), pack(F.col("s"), budget, overlap).alias("c")).alias("p"))
    doc = packed.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: F.transform(x["c"], lambda c: F.struct(x["section"].alias("section"), c["text"].alias("text"), c["num_tokens"].alias("num_tokens")))))
    return doc.select("doc_id", F.posexplode(flat).alias("pos", "c")).select("doc_id", "pos", "c.section", "c.text", "c.num_tokens")


def split_long(text: Column, limit: int = 250) -> Column:
    """Fragments of at most ``limit`` words: whole sentences, giant ones cut."""
    def cut(s: Column) -> Column:
        w = F.split(s, "\\s+")
        n = F.ceil(F.size(w) / limit).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * limit + 1, limit), " "))

    pieces = F.flatten(F.transform(T.sentences(text), cut))
    return F.transform(pack(pieces, limit, 0), lambda c: c["text"])


def character_overlap(chunked: DataFrame) -> DataFrame:
    """doc_id, pos, shared: characters that end the chunk before and begin this one, by the prefix function; linear in their length."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("pos"))

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str) -> int:
            if not x:
                return 0
            s = y + "\0" + x[-len(y) :]
            fail = [0] * len(s)
            for i in range(1, len(s)):
                k = fail[i - 1]
                while k and s[i] != s[k]:
                    k = fail[k - 1]
                fail[i] = k + (s[i] == s[k])
            return fail[-1]

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")

    return chunked.withColumn("_before", before).withColumn("shared", shared("_before", "text")).drop("_before")


def repack_loosely(chunked: DataFrame, budget: int, overlap: int) -> DataFrame:
    """Leading sentences that the last two of the chunk before hold are dropped, and the document is packed anew, sections lost."""
    s = chunked.withColumn("s", T.sentences(F.col("text")))
    last = F.coalesce(F.lag("s").over(Window.partitionBy("doc_id").orderBy("pos")), F.array().cast("array<string>"))
    s = s.withColumn("last", last).withColumn("prior", F.slice("last", F.greatest(F.size("last") - 1, F.lit(1)), 2))
    begin = F.struct(F.lit(True).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        again = a["skip"] & F.array_contains(F.col("prior"), x)
        return F.struct(again.alias("skip"), F.when(again, a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"))

    new = F.aggregate("s", begin, step, lambda a: a["out"])
    s = s.select("doc_id", F.struct("pos", new.alias("s")).alias("p"))
    doc = s.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["s"])).alias("s"))
    return doc.select("doc_id", F.posexplode(pack(F.col("s"), budget, overlap)).alias("pos", "c")).select("doc_id", "pos", "c.text", "c.num_tokens")
