"""Mixing sources to target weights by hash-threshold histograms [native].

Every source has a budget of words.  A document's place in its source is a hash
of its id, and the mix takes the documents whose hash lies below the source's
threshold.  The threshold is found without sorting documents: sum sizes by
source and hash bucket, walk the buckets to the one in which the budget runs
out, and look into that bucket alone at the next digits.  ``LEVELS`` rounds of
``DIGITS`` hexadecimal digits fix 48 bits, so the last bucket holds one id even
in a source of 10^12 documents.  Each round reads the slim table of sizes and
shuffles at most ``16 ** DIGITS`` pre-aggregated rows a source; a hot source is
as many rows as any other.  Thresholds nest: a larger budget takes a superset.

A budget above the source's size takes every document once or twice and the
threshold decides over the next repeat, so no document exceeds
``MAX_REPEATS`` times its size.

Nulls: a null source is a source of its own, ordered last; a null text has size
0; a null doc_id hashes as the empty string.  Rows that repeat a doc_id share
its hash, so they are taken or left together.  An empty table, or one without
words, gives targets of 0 and takes nothing.  Other columns are ignored here
and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, words

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
DIGITS, LEVELS = 3, 4
HASH = DIGITS * LEVELS


def place(doc_id: Column) -> Column:
    """The document's place in its source: leading hexadecimal digits of a hash of its id."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """source, source_size, target, repeats, left: budgets by water-filling.

    One row a source.  Sources fill to ``level * weight`` words but stop at
    ``MAX_REPEATS`` times their size.  Ordered by the level at which they stop,
    a prefix has stopped; running sums give the level behind every prefix and
    the first one that holds is the level for all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    cap = F.lit(float(MAX_REPEATS)) * F.col("source_size")
    per = per.withColumn("cap", cap).withColumn("stop", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "total": F.lit(float(share)) * F.sum("source_size").over(everything),
            "stopped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.when(F.col("total") > F.col("stopped"), (F.col("total") - F.col("stopped")) / F.col("open")).otherwise(F.lit(0.0))
    per = per.withColumn("level", level)
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", F.first(F.when(F.col("level") <= F.col("stop"), F.col("level")), ignorenulls=True).over(whole))
    fill = F.when(F.col("level") < F.col("stop"), F.col("level") * F.col("weight")).otherwise(F.col("cap"))
    per = per.withColumn("target", fill)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("repeats", F.least(repeats, F.lit(MAX_REPEATS)).cast("bigint"))
    left = F.col("target") - F.col("repeats") * F.col("source_size")
    return per.select("source", "source_size", "target", "repeats", left.alias("left"))


def thresholds(sizes: DataFrame, per: DataFrame, scratch: Scratch) -> DataFrame:
    """per with ``below``: the place up to which a source's documents are taken once more.

    ``at`` is the prefix of the boundary bucket so far; ``~`` sorts behind all
    digits and stands for a budget that no bucket exhausts.
    """
    state = scratch.save(per.withColumn("at", F.lit("")), "level0")
    for level in range(1, LEVELS + 1):
        n = level * DIGITS
        on = sizes["source"].eqNullSafe(state["source"]) & F.col("place").startswith(F.col("at"))
        inside = sizes.join(state.select("source", "at", "left"), on).select(sizes["source"], F.substring("place", 1, n).alias("b"), "size", "left")
        hist = inside.groupBy("source", "b", "left").agg(F.sum("size").alias("s"))
        running = F.sum("s").over(Window.partitionBy("source").orderBy("b"))
        hist = hist.withColumn("upto", running).where(F.col("upto") > F.col("left"))
        first = hist.groupBy(F.col("source").alias("k")).agg(F.min_by(F.struct("b", (F.col("upto") - F.col("s")).alias("before"), "s"), "b").alias("x"))
        state = state.join(first, state["source"].eqNullSafe(first["k"]), "left").select(
            "source", "source_size", "target", "repeats",
            (F.col("left") - F.coalesce(F.col("x.before"), F.lit(0))).alias("left"),
            F.coalesce(F.col("x.b"), F.lit("~")).alias("at"), F.col("x.s").alias("edge"),
        )
        state = scratch.save(state, f"level{level}")
    # the last bucket is one id: take it if that comes nearer to the target
    taken = (F.col("at") != "~") & (2 * F.col("left") >= F.col("edge"))
    return state.select("source", "source_size", "target", "repeats", F.when(taken, F.concat("at", F.lit("~"))).otherwise(F.col("at")).alias("below"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), place(F.col("doc_id")).alias("place"))
    sizes = scratch.save(slim, "sizes")
    per = thresholds(sizes, targets(sizes, weights, share), scratch)
    out = sizes.join(per.withColumnRenamed("source", "k"), F.col("source").eqNullSafe(F.col("k")))
    copies = F.col("repeats") + (F.col("place") < F.col("below")).cast("bigint")
    out = out.withColumn("taken", F.col("size") * F.least(copies, F.lit(MAX_REPEATS)))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.least(copies, F.lit(MAX_REPEATS)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """The mixed corpus: every row of ``docs``, all columns, as often as the mix takes it.

    Rows without words count nothing and aren't part of a mix.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    sizes = docs.select("source", F.size(words(F.col("text"))).cast("bigint").alias("size"), place(F.col("doc_id")).alias("place"))
    sizes = scratch.save(sizes, "sizes")
    per = thresholds(sizes, targets(sizes, weights, share), scratch)
    per = per.select(F.col("source").alias("__q_k"), F.col("repeats").alias("__q_repeats"), F.col("below").alias("__q_below"))
    copies = F.col("__q_repeats") + (place(F.col("doc_id")) < F.col("__q_below")).cast("bigint")
    joined = docs.join(per, docs["source"].eqNullSafe(F.col("__q_k")))
    n = F.when(F.size(words(F.col("text"))) > 0, F.least(copies, F.lit(MAX_REPEATS))).otherwise(F.lit(0)).cast("int")
    out = joined.withColumn("__q_copy", F.explode(F.array_repeat(F.lit(1), n))).select(*[docs[c] for c in docs.columns])
    return out


def op4(docs: DataFrame) -> DataFrame:
    mixed = mix_sizes(docs)
    out = mixed.select("doc_id", "size", "source_size", "target", "taken")
    return out


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS place
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s0),
s2 AS (SELECT *, 3e0 * source_size AS cap, 3e0 * source_size / weight AS stop FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         coalesce(sum(cap) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS stopped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
       FROM s2),
s4 AS (SELECT *, CASE WHEN total > stopped THEN (total - stopped) / CAST(open AS DOUBLE) ELSE 0e0 END AS own FROM s3),
s5 AS (SELECT *, first_value(CASE WHEN own <= stop THEN own END IGNORE NULLS) OVER (ORDER BY stop, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM s4),
s6 AS (SELECT *, CASE WHEN level < stop THEN level * weight ELSE cap END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS repeats FROM s6),
u AS (SELECT d.source, place, sum(size) AS s, min(target - repeats * source_size) AS lft
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source GROUP BY 1, 2),
r AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY place) AS upto FROM u),
b AS (SELECT source, min(place) AS at FROM r WHERE upto > lft GROUP BY source),
t AS (SELECT b.source, b.at, 2 * (r.lft - (r.upto - r.s)) >= r.s AS edge
      FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source AND b.at = r.place)
SELECT d.doc_id, d.size, s7.source_size, s7.target,
       CAST(d.size * least(3, s7.repeats + CASE WHEN t.at IS NULL OR d.place < t.at OR (t.edge AND d.place = t.at) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source
LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
