"""Metrics, statistics, diagnoses and checks of results."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

IDEAL = sum(1 / math.log2(r + 1) for r in range(1, 11))
ADOPT, MARGIN = 0.0, -0.02


def scores(results: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """query_id, precision, recall, f1 at k for every query with relevant documents; repeated documents count once; missing results 0."""
    top = results.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    rel = qrels.select("query_id", "doc_id").distinct()
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    got = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    hit = top.join(rel, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    s = n.join(got, "query_id", "left").join(hit, "query_id", "left").na.fill(0, ["returned", "hits"])
    p = F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(F.lit(0.0))
    r = F.when(F.col("returned") > 0, F.col("hits") / F.least("relevant", "returned")).otherwise(F.lit(0.0))
    s = s.withColumns({"precision": p, "recall": r})
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return s.select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f, 6).alias("f1"))


def ndcg(fragments: DataFrame, qrels: DataFrame, gain: Column | None = None) -> DataFrame:
    """query_id, ndcg over ten places; relevance comes from the fragment's document, the ideal has ten relevant ones."""
    rel = qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1.0))
    f = fragments.where(F.col("rank") <= 10).join(rel, ["query_id", "doc_id"], "left")
    g = F.coalesce("rel", F.lit(0.0)) * (gain if gain is not None else F.lit(1.0))
    got = f.groupBy("query_id").agg(F.sum(g / F.log2(F.col("rank") + 1)).alias("dcg"))
    return qrels.select("query_id").distinct().join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / IDEAL, 6).alias("ndcg"))


def graded_ndcg(fragments: DataFrame, grades: DataFrame) -> DataFrame:
    """Grades 0 to 2 of fragments, missing ones 0."""
    f = fragments.where(F.col("rank") <= 10).join(grades, ["query_id", "chunk_id"], "left")
    got = f.groupBy("query_id").agg(F.sum(F.coalesce("grade", F.lit(0)) / F.lit(2.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
    return got.select("query_id", F.round(F.col("dcg") / IDEAL, 6).alias("ndcg"))


def f1_ceiling(relevant: Column, k: int = 3) -> Column:
    """The best F1 at k with so many relevant documents."""
    hits = F.least(relevant, F.lit(k))
    p = hits / F.lit(float(k))
    return F.when(hits > 0, 2 * p / (p + 1)).otherwise(F.lit(0.0))


def bootstrap(deltas: list[float], repeats: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """Mean difference and its 90% interval.  Deltas are one a query: a bounded list."""
    r = random.Random(seed)
    n = len(deltas)
    means = sorted(sum(deltas[r.randrange(n)] for _ in range(n)) / n for _ in range(repeats))
    return sum(deltas) / n, means[int(0.05 * repeats)], means[int(0.95 * repeats) - 1]


def bootstrap_frame(paired: DataFrame, repeats: int = 10_000) -> DataFrame:
    """low, mean, high of ``delta`` by Poisson resampling: each query's weight in each round is a hash, so nothing is collected."""
    rounds = paired.select("query_id", "delta", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("round"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(" ", F.col("query_id").cast("string"), F.col("round").cast("string"))), 1, 5), 16, 10).cast("int") + 0.5) / float(1 << 20)
    cuts, p, total = [], math.exp(-1), math.exp(-1)
    for k in range(1, 8):
        cuts.append(total)
        p /= k
        total += p
    weight = sum(((u > c).cast("int") for c in cuts[1:]), (u > cuts[0]).cast("int"))
    m = rounds.groupBy("round").agg((F.sum(F.col("delta") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("m"))
    return m.agg(F.round(F.percentile("m", 0.05), 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.95), 6).alias("high"))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > MARGIN, "adopt").when(high < ADOPT, "discard").otherwise("undecided")


def sign_test(wins: int, losses: int) -> float:
    """Two-sided, exact; ties don't count."""
    n = wins + losses
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def sign_test_column(wins: Column, losses: Column) -> Column:
    """The same over two columns: each binomial term from the one before."""
    n = wins + losses
    first = F.struct((-n * math.log(2)).alias("t"), F.exp(-n * math.log(2)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    fewer = F.least(wins, losses)
    terms = F.when(fewer > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(fewer, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, first, step, lambda a: a["s"])))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """query_id, delta: b less a; queries that one lacks count 0 there."""
    x, y = a.select("query_id", F.col(metric).alias("x")), b.select("query_id", F.col(metric).alias("y"))
    return x.join(y, "query_id", "full_outer").select("query_id", (F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))).alias("delta"))


def wins(deltas: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    return deltas.agg(count(F.col("delta") > tolerance).alias("wins"), count(F.col("delta") < -tolerance).alias("losses"), count(F.abs("delta") <= tolerance).alias("ties"))


def pool_recall(pool: DataFrame, qrels: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """depth, recall, never: share of relevant documents by the rank of their first chunk."""
    first = pool.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    r = qrels.select("query_id", "doc_id").distinct().join(first, ["query_id", "doc_id"], "left")
    r = r.select("*", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    return r.groupBy("depth").agg(F.round(F.avg(F.coalesce(F.col("first") <= F.col("depth"), F.lit(False)).cast("double")), 6).alias("recall"), F.count(F.when(F.col("first").isNull(), 1)).alias("never"))


def found_by(a: DataFrame, b: DataFrame, qrels: DataFrame) -> DataFrame:
    """in_a, in_b, n: relevant documents found by either pool, both or none."""
    x, y = (p.select("query_id", "doc_id").distinct() for p in (a, b))
    r = qrels.select("query_id", "doc_id").distinct()
    m = r.join(x.withColumn("a", F.lit(True)), ["query_id", "doc_id"], "left").join(y.withColumn("b", F.lit(True)), ["query_id", "doc_id"], "left")
    return m.groupBy(F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b")).agg(F.count(F.lit(1)).alias("n"))


def failure_class(pool: DataFrame, qrels: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """query_id, doc_id, class: absent from the corpus, outside the pool, in the pool, delivered."""
    first = pool.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    r = qrels.join(first, ["query_id", "doc_id"], "left").join(known.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    c = F.when(F.col("known").isNull(), "absent").when(F.col("first").isNull(), "outside").when(F.col("first") > depth, "in_pool").otherwise("delivered")
    return r.select("query_id", "doc_id", c.alias("class"))


def overlap(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """query_id, jaccard, same_first of two pools' first k."""
    s = lambda p, n: p.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(key).alias(n), F.min_by(key, "rank").alias(f"{n}1"))
    j = s(a, "x").join(s(b, "y"), "query_id")
    return j.select("query_id", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), (F.col("x1") == F.col("y1")).alias("same_first"))


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, state: missing or orphan."""
    missing = expected.select(key).distinct().join(present, key, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(present.select(key).distinct().join(expected, key, "left_anti").withColumn("state", F.lit("orphan")))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id of results whose ordered documents differ."""
    s = lambda x, n: x.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias(n))
    return s(a, "x").join(s(b, "y"), "query_id", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("query_id")


def fragment_audit(fragments: DataFrame, limit: int = 250) -> DataFrame:
    """Word counts by nearest rank and what is wrong with fragments; one row."""
    n = T.word_count(F.col("text"))
    count = lambda c: F.count(F.when(c, 1))
    f = fragments.select(n.alias("n"), "uncovered", "unreadable")
    nearest = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("bigint")
    return f.agg(nearest(0.5).alias("p50"), nearest(0.9).alias("p90"), F.max("n").alias("most"), count(F.col("uncovered") == 1).alias("uncovered"), count(F.col("unreadable") == 1).alias("unreadable"), count(F.col("n") > limit).alias("too_long"))


def spread(fragments: DataFrame) -> DataFrame:
    g = fragments.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m"))
    return g.agg(F.round(F.avg("k"), 6).alias("mean_documents"), F.max("m").alias("most"), F.percentile("m", 0.5).alias("median_most"))


def inversions(fragments: DataFrame) -> DataFrame:
    """query_id, inversions: pairs delivered against their rank; fragments are at most ten a query."""
    a = fragments.select("query_id", F.col("fragment").alias("f"), F.col("rank").alias("r"))
    b = fragments.select("query_id", F.col("fragment").alias("g"), F.col("rank").alias("s"))
    return a.join(b, "query_id").where("f < g AND r > s").groupBy("query_id").agg(F.count(F.lit(1)).alias("inversions"))


def consensus(votes: DataFrame, human: DataFrame, least: int) -> DataFrame:
    """query_id, doc_id, votes of at least so many; queries with human labels are left alone."""
    v = votes.groupBy("query_id", "doc_id").agg(F.countDistinct("annotator").alias("votes")).where(F.col("votes") >= least)
    return v.join(human.select("query_id").distinct(), "query_id", "left_anti")


def agreement(labels: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, f1 of one annotator against the truth; both empty is 1."""
    a, t = labels.select("query_id", "doc_id").distinct(), truth.select("query_id", "doc_id").distinct()
    n = lambda x, c: x.groupBy("query_id").agg(F.count(F.lit(1)).alias(c))
    j = queries.select("query_id").join(n(a, "a"), "query_id", "left").join(n(t, "t"), "query_id", "left").join(n(a.join(t, ["query_id", "doc_id"], "left_semi"), "h"), "query_id", "left").na.fill(0)
    f = F.when(F.col("a") + F.col("t") == 0, 1.0).otherwise(2 * F.col("h") / (F.col("a") + F.col("t")))
    return j.select("query_id", F.round(f, 6).alias("f1"))


def parse_sheet(lines: DataFrame) -> DataFrame:
    """query_id, doc_id from lines (sheet, ord, line): ``## query`` heads a section, ``- [x] doc`` is marked."""
    head = F.nullif(F.regexp_extract("line", "^## (\\S+)", 1), F.lit(""))
    s = lines.select("sheet", "ord", "line", head.alias("head"))
    s = s.withColumn("query_id", F.last("head", ignorenulls=True).over(Window.partitionBy("sheet").orderBy("ord")))
    return s.select("query_id", F.nullif(F.regexp_extract("line", "^- \\[[xX]\\] (\\S+)", 1), F.lit("")).alias("doc_id")).where("doc_id is not null")


def violations(fragments: DataFrame, docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """query_id, rule of everything that a result may not be."""
    tag = lambda df, rule: df.select("query_id", F.lit(rule).alias("rule")).distinct()
    n = docs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("m"))
    f = fragments.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("fragment").alias("m"))
    rules = [
        tag(n.where("n <> 3 OR m <> 3"), "three documents ranked 1 to 3"), tag(f.where("n <> 10 OR m <> 10"), "ten fragments ranked 1 to 10"),
        tag(fragments.where(T.word_count(F.col("text")) > 250), "at most 250 words"), tag(fragments.where(F.trim("text") == ""), "no empty text"),
        tag(fragments.join(metadata, "chunk_id", "left_anti"), "fragments are indexed"), tag(docs.join(metadata, "doc_id", "left_anti"), "documents are indexed"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def complete(text: Column) -> Column:
    """Whether a text ends as a sentence does, a footnote number allowed."""
    return text.rlike("[.!?…:;][\"”»)\\]]*[0-9]{0,3}\\s*$")
