"""Benchmark decontamination by winnowing [native].

A document word is hit if it lies inside an occurrence of ``WINDOW``
consecutive words of a benchmark item (of the whole item, if that is shorter).

Winnowing keeps, of every ``WINDOW - GRAM + 1`` neighbouring hashes of
``GRAM``-word grams, the smallest.  Two equal windows hold the same hashes and
so keep the same one: joining the kept fingerprints of documents and items finds
every shared window, at two fingerprints for eight positions instead of all.
Hits are then extended: around each place of a matched gram, the windows that
hold it are compared with the items' windows as text, so a hash collision can
add work but no result.

Items shorter than the window are one window of their own length; for each such
length that occurs in the benchmark (nine at most) every gram of that length is
a fingerprint.

The benchmark's fingerprints are broadcast if they were counted and are at most
``BROADCAST_ROWS``; beyond that the same join shuffles.  Pairs of documents and
items are never listed: windows are distinct on the benchmark side and carry
their items, so a common passage costs one row for each place in a document.

Nulls: null texts have no words and are clean; null doc_ids are matched with
themselves; items that repeat an id count once.  Items with a null id have windows, hits and
contaminated documents like all others; only the lists of item ids leave them out.
Rows that repeat are each reported.  An empty benchmark leaves all clean; empty
documents give an empty result.  Other columns are ignored, and kept by
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, Scratch, ascii_lower, bind, words

WINDOW, GRAM = 10, 4
KEPT_OF = WINDOW - GRAM + 1
#: Rows of at most 100 bytes: 50 MB.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    return words(ascii_lower(text), NON_ALNUM)


def _shifted(a: Column, by: int, f) -> Column:
    """f(a[i], a[i + by]) for every i that has both."""

    def pairs(v: Column) -> Column:
        n = F.greatest(F.size(v) - by, F.lit(0))
        return F.zip_with(F.slice(v, 1, n), F.slice(v, by + 1, n), f)

    return bind(a, pairs)


def gram_hashes(w: Column) -> Column:
    """Hashes of the 4-word grams: words, pairs, pairs of pairs."""
    pair = lambda a, b: F.xxhash64(a, b)
    one = F.transform(w, lambda x: F.xxhash64(x))
    return _shifted(_shifted(one, 1, pair), 2, pair)


def kept_hashes(grams: Column) -> Column:
    """Minima of 7 neighbours, by doubling: 2, 4, then 4 and 4 overlapping."""
    least = lambda a, b: F.least(a, b)
    return F.array_distinct(_shifted(_shifted(_shifted(grams, 1, least), 2, least), 3, least))


def run_hashes(w: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    count = F.size(w) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _runs(w: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("s"), F.lit(n).alias("n"), F.array_join(F.slice(w, s + 1, n), " ").alias("run")))


def _key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Repeated ids with different texts are different rows; equal rows share one."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")).alias("__q_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__q_th")]


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast what has been counted and is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """n, run, items: the distinct windows and the ids of the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    items = items.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    runs = items.select("item", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("run")).distinct()
    return scratch.save(runs.groupBy("n", "run").agg(F.collect_set("item").alias("items")), "windows")


def _tagged(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("fp")))


def _places(w: Column, matched: Column, n: int) -> Column:
    """Starts of the windows to compare: those that hold a matched gram, or the matched runs themselves."""
    fps = F.transform(F.filter(matched, lambda x: x["n"] == n), lambda x: x["fp"])
    h = gram_hashes(w) if n == WINDOW else run_hashes(w, n)
    at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(fps, x), i)), lambda i: i.isNotNull())
    if n != WINDOW:
        return at
    first = lambda p: F.greatest(p - (KEPT_OF - 1), F.lit(0))
    last = lambda p: F.least(p, F.size(w) - n)
    none = F.array().cast("array<int>")
    return F.array_distinct(F.flatten(F.transform(at, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(none))))


def fingerprints(w: Column, lengths: list[int]) -> Column:
    """(n, fp) of a text for every window length in use."""
    parts = []
    for n in lengths:
        f = kept_hashes(gram_hashes(w)) if n == WINDOW else F.array_distinct(run_hashes(w, n))
        parts.append(_tagged(f, n))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def find_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """id, hash, starts (s, n), items for the documents that have any window."""
    wins = windows(benchmark, scratch)
    lengths = sorted(r[0] for r in wins.select("n").distinct().collect())  # ten at most
    if not lengths:
        empty = "__q_id string, __q_th bigint, starts array<struct<s:int,n:int>>, items array<string>"
        return docs.sparkSession.createDataFrame([], empty)
    known = wins.select(F.explode(fingerprints(F.split("run", " "), lengths)).alias("f"), F.col("n").alias("wn")).select("f.*", "wn")
    known = scratch.save(known.where(F.col("n") == F.col("wn")).select("n", "fp").distinct(), "known")
    tokenised = docs.select(*_key(), tokens(F.col("text")).alias("w"))
    own = tokenised.select("__q_id", "__q_th", F.explode(fingerprints(F.col("w"), lengths)).alias("f")).select("__q_id", "__q_th", "f.n", "f.fp")
    matched = own.join(_sized(known), ["n", "fp"], "left_semi")
    matched = matched.groupBy("__q_id", "__q_th").agg(F.collect_set(F.struct("n", "fp")).alias("m"))
    matched = scratch.save(matched, "matched")

    again = docs.select(*_key(), "text").join(matched, ["__q_id", "__q_th"]).dropDuplicates(["__q_id", "__q_th"])
    again = again.select("__q_id", "__q_th", "m", tokens(F.col("text")).alias("w"))
    parts = []
    for n in lengths:
        parts.append(_runs(F.col("w"), _places(F.col("w"), F.col("m"), n), n))
    runs = again.select("__q_id", "__q_th", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("r")).select("__q_id", "__q_th", "r.*")
    hits = runs.join(_sized(wins), ["n", "run"])
    found = hits.groupBy("__q_id", "__q_th").agg(F.collect_set(F.struct("s", "n")).alias("starts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return scratch.save(found, "found")


def n_covered(starts: Column) -> Column:
    """Words in the union of the windows (s, n)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(x["s"] + x["n"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], x["s"] + x["n"]).alias("end"),
    )
    return F.aggregate(F.sort_array(starts), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "winnow")
    found = find_hits(docs, benchmark, scratch)
    slim = docs.select("doc_id", *_key(), F.size(tokens(F.col("text"))).cast("bigint").alias("n_words"))
    out = slim.join(found, ["__q_id", "__q_th"], "left").select(
        "doc_id", "n_words",
        F.coalesce(n_covered(F.col("starts")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.sort_array("items"), F.array().cast("array<string>")).alias("items"),
    )
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay."""
    scratch = Scratch(docs.sparkSession, "clean")
    found = find_hits(docs, benchmark, scratch).select("__q_id", "__q_th")
    keyed = docs.select("*", *_key())
    return keyed.join(found, ["__q_id", "__q_th"], "left_anti").select(*docs.columns)


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    scored = contamination(docs, benchmark)
    out = scored.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
    return out


def _words_sql(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
i AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
i2 AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS run
      FROM (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i2)),
p AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
      FROM d, (SELECT DISTINCT n FROM i2) l WHERE len(w) >= n),
h AS (SELECT r, k, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND array_to_string(p.w[p.k:p.k + p.n - 1], ' ') = g.run),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
