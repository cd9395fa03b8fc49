"""From a pool of chunks to documents and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .retrieve import ranked

TOP_DOCS, FRAGMENTS, TOPIC_SHARE, BOILERPLATE = 3, 10, 0.8, 0.60
STRATEGIES = ("max", "sum", "mean")


def topic_votes(pool: DataFrame) -> DataFrame:
    """query_id, topic, share: the winning topic by positive scores; chunks without a topic have no vote."""
    v = pool.where(F.col("topic").isNotNull()).groupBy("query_id", "topic").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("s"))
    g = v.groupBy("query_id").agg(F.max_by("topic", F.struct("s", F.negative("topic"))).alias("winner"), F.max("s").alias("m"), F.sum("s").alias("t"))
    return g.select("query_id", F.col("winner").alias("topic"), F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(F.lit(0.0)).alias("share"))


def dominant_topic(pool: DataFrame, threshold: float = TOPIC_SHARE) -> DataFrame:
    """Only the winning topic's chunks where its share reaches the threshold; else the whole pool."""
    v = topic_votes(pool).select("query_id", F.col("topic").alias("_t"), F.col("share").alias("_s"))
    return pool.join(v, "query_id", "left").where(F.coalesce(F.col("_s") < threshold, F.lit(True)) | (F.col("topic") == F.col("_t"))).drop("_t", "_s")


def documents(pool: DataFrame, strategy: str = "top6", n: int = TOP_DOCS, alpha: float = 0.0) -> DataFrame:
    """query_id, rank, doc_id, score: chunks' scores summed up by document (max, sum, mean, or topM: the M best).

    ``alpha`` divides by the number of the document's chunks in the pool to that power.
    """
    m = int(strategy[3:]) if strategy.startswith("top") and strategy[3:].isdigit() else None
    if m is None and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    w = Window.partitionBy("query_id", "doc_id")
    p = pool.withColumn("_n", F.count(F.lit(1)).over(w))
    if m is not None:
        p = p.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id"))).where(F.col("_r") <= m)
    f = {"max": F.max, "mean": F.avg}.get(strategy, F.sum)
    score = f("score") if not alpha else f("score") / F.pow(F.greatest(F.max("_n"), F.lit(1)), F.lit(alpha))
    return ranked(p.groupBy("query_id", "doc_id").agg(F.round(score, 9).alias("score")), "score", "doc_id", limit=n)


def quota_documents(pool: DataFrame, by_sum: int, n: int = TOP_DOCS) -> DataFrame:
    """The first ``by_sum`` documents by their top6, the others by their best chunk."""
    first = documents(pool, "top6", by_sum).withColumn("part", F.lit(0))
    rest = documents(pool.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"), "max", n).withColumn("part", F.lit(1))
    both = first.unionByName(rest)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank"))).where(F.col("rank") <= n)


def discounted(pool: DataFrame, share: str = "reference_share", how: str = "smooth") -> DataFrame:
    """Scores of bibliographic chunks lowered: left out, halved, quartered, or by their share."""
    high = F.col(share) >= BOILERPLATE
    if how == "exclude":
        return pool.where(~high)
    factor = {"half": F.when(high, 0.5).otherwise(1.0), "quarter": F.when(high, 0.25).otherwise(1.0), "smooth": 1 - F.col(share)}[how]
    return pool.withColumn("score", F.col("score") * factor)


def permute_saturated(docs: DataFrame, key: Column, least: int = 5) -> DataFrame:
    """Documents with at least ``least`` chunks change places among themselves by a key; all others stay where they are."""
    s = docs.withColumn("_s", F.col("chunks") >= least).withColumn("_key", key)
    w = Window.partitionBy("query_id", "_s")
    s = s.withColumns({"_place": F.row_number().over(w.orderBy("rank")), "_turn": F.row_number().over(w.orderBy(F.desc("_key"), "rank"))})
    places = s.where("_s").select("query_id", F.col("_place").alias("_turn"), F.col("rank").alias("new_rank"))
    moved = s.where("_s").join(places, ["query_id", "_turn"])
    still = s.where("not _s").withColumn("new_rank", F.col("rank"))
    return moved.unionByName(still).withColumn("rank", F.col("new_rank")).drop("_s", "_key", "_place", "_turn", "new_rank")


def recency(docs: DataFrame, weight: float, last: int = T.MAX_YEAR, first: int = T.MIN_YEAR) -> DataFrame:
    """The delivered documents in a new order, newer ones a little ahead; undated ones and reported scores stay."""
    age = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (last - F.col("year")) / float(last - first)))
    lifted = F.round(F.col("score") + weight * F.when(F.col("year").isNotNull(), age).otherwise(0.0), 9)  # least() would skip a null
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(lifted), "rank")))


def ordered_fragments(pool: DataFrame, docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """pool with ``position``: readable language, top document, little boilerplate, shared words, then rank.  Nothing is dropped.

    pool has lang, text and reference_share; tokens has query_id, tokens.
    """
    top = docs.select("query_id", "doc_id").withColumn("_top", F.lit(True))
    p = pool.join(top, ["query_id", "doc_id"], "left").join(tokens, "query_id", "left")
    keys = [
        (~F.coalesce(F.col("lang").isin(*T.READABLE), F.lit(False))).cast("int").alias("unreadable"),
        F.col("_top").isNull().cast("int").alias("outside"),
        (F.col("reference_share") >= BOILERPLATE).cast("int").alias("boilerplate"),
        F.when(F.size("tokens") > 0, (~F.arrays_overlap(T.content_tokens(F.col("text")), "tokens")).cast("int")).otherwise(1).alias("uncovered"),
    ]
    out = p.select(*pool.columns, *keys)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("unreadable", "outside", "boilerplate", "uncovered", "rank")))


def take_fragments(ordered: DataFrame, n: int = FRAGMENTS, order: str = "position") -> DataFrame:
    """The first n with distinct normalised texts, ranked 1 to n; later ones fill up."""
    key = T.dedup_key(F.col("text"))
    first = ordered.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", key).orderBy(order))).where("_d = 1").drop("_d")
    return first.withColumn("fragment", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).where(F.col("fragment") <= n)


def aligned_fragments(ordered: DataFrame, docs: DataFrame, inside: int, n: int = FRAGMENTS) -> DataFrame:
    """``inside`` places for the top documents' chunks, the others for any chunk not taken; texts are distinct within each part."""
    top = docs.select("query_id", "doc_id")
    a = take_fragments(ordered.join(top, ["query_id", "doc_id"], "left_semi"), inside).withColumn("part", F.lit(0))
    b = take_fragments(ordered.join(a.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"), n).withColumn("part", F.lit(1))
    both = a.unionByName(b)
    return both.withColumn("fragment", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "fragment"))).where(F.col("fragment") <= n)


def round_robin(ordered: DataFrame, docs: DataFrame, quota: int) -> DataFrame:
    """``turn``: top documents first, then by rounds of ``quota`` chunks a document, then as ordered."""
    top = docs.select("query_id", "doc_id").withColumn("_top", F.lit(True))
    p = ordered.join(top, ["query_id", "doc_id"], "left")
    i = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("position"))
    p = p.withColumns({"out": F.col("_top").isNull().cast("int"), "round": F.floor((i - 1) / quota)})
    return p.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("out", "round", "position"))).drop("_top")


def without_near_duplicates(ordered: DataFrame, threshold: float = 0.7, n: int = FRAGMENTS) -> DataFrame:
    """The first n, near duplicates of earlier ones replaced by the next clean fragment of the rest, or kept if there is none."""
    import pandas as pd

    def greedy(p: pd.DataFrame) -> pd.DataFrame:
        rows = p.sort_values("position").reset_index(drop=True)
        sets = [set(s) for s in rows["s"]]
        like = lambda i, js: any(len(sets[i] & sets[j]) >= threshold * max(1, len(sets[i] | sets[j])) for j in js)
        taken, spare = [], list(range(n, len(rows)))
        for i in range(min(n, len(rows))):
            if like(i, taken):
                swap = next((j for j in spare if not like(j, taken)), None)
                if swap is not None:
                    spare.remove(swap)
                    i = swap
            taken.append(i)
        out = rows.loc[taken, ["query_id", "chunk_id"]].copy()
        out["fragment"] = range(1, len(taken) + 1)
        return out

    s = ordered.select("query_id", "chunk_id", "position", T.shingles(F.col("text")).alias("s"))
    kinds = dict(s.dtypes)
    return s.groupBy("query_id").applyInPandas(greedy, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, fragment int")


def extended(fragments: DataFrame, chunks: DataFrame, limit: int = 250) -> DataFrame:
    """Fragments followed by the sentences of the next chunk that they lack, as far as the limit allows.  chunks: doc_id, pos, text."""
    after = chunks.select("doc_id", (F.col("pos") - 1).alias("pos"), T.sentences(F.col("text")).alias("_more"))
    p = fragments.join(after, ["doc_id", "pos"], "left")
    n = lambda c: F.size(F.split(c, "\\s+"))
    step = lambda a, s: F.when((F.instr(a, s) == 0) & (n(a) + n(s) <= limit), F.concat_ws(" ", a, s)).otherwise(a)
    return p.withColumn("text", F.aggregate(F.coalesce("_more", F.array().cast("array<string>")), F.col("text"), step)).drop("_more")


def result_objects(queries: DataFrame, docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """query_id, documents, fragments as nested arrays, and whether documents are missing."""
    d = docs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("documents"))
    f = fragments.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("fragment").alias("rank"), "chunk_id", "doc_id", "text"))).alias("fragments"))
    out = queries.select("query_id").join(d, "query_id", "left").join(f, "query_id", "left")
    return out.withColumn("incomplete", F.coalesce(F.size("documents"), F.lit(0)) < TOP_DOCS)
