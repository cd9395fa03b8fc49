import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import vectors as V
from quarry.queries.evaluation import qrels


def test_items_of_any_length_are_found_whole(spark, tmp_path):
    items = ["one two three four five", "a b", "x", "b c d", "", None, "two three four fiv", "ree four five six", "one two three four five six seven"]
    docs = ["zero one two three four five six", "aa bb", "a b c d", "", None, "x" * 100000 + " a b", "one two\nthree four five"]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in qrels(spark, str(tmp_path)).select("query_id", "doc_id").collect())
    assert got == sorted((i, k) for i, a in enumerate(items) for k, b in enumerate(docs) if a is not None and b is not None and a in b)


@pytest.mark.parametrize("how", ["mean", "max"])
def test_neighbours_scores_match_all_pairs(spark, how):
    r = random.Random(4)
    rows = [(k, k // r.choice([2, 3, 5]), [float(r.randrange(-9, 9)) for _ in range(4)]) for k in range(60)]
    asked = [(q, np.array([r.randrange(-9, 9) for _ in range(4)], dtype=float)) for q in range(5)]
    df = V.with_neighbours(spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, embedding array<double>").repartition(3))
    got = sorted((x.query_id, x.rank, x.chunk_id, round(x.score, 6)) for x in V.search(df, asked, 7, near=("before", "after"), how=how).collect())
    want = []
    for q, v in asked:
        scored = []
        for k, doc, x in rows:
            own = sorted(c for c, d, _ in rows if d == doc)
            near = [float(np.dot(rows[c][2], v)) for c in own[max(0, own.index(k) - 1) : own.index(k) + 2]]
            scored.append((-(max(near) if how == "max" else round(sum(near) / len(near), 9)), k))
        want += [(q, n + 1, k, round(-s, 6)) for n, (s, k) in enumerate(sorted(scored)[:7])]
    assert got == want


def peak(spark) -> float:
    """MB that the largest Python worker has come to."""

    def most(frames):
        import resource

        time.sleep(0.3)
        for f in frames:
            yield f.assign(id=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)

    return spark.range(4, numPartitions=4).mapInPandas(most, "id bigint").agg(F.max("id")).first()[0] / 1024


def test_search_does_not_hold_all_scores(spark):
    r = np.random.default_rng(3)
    v, asked = r.integers(-3, 4, (6000, 4)).astype(float), r.integers(-3, 4, (6000, 4)).astype(float)
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "chunk_id bigint, embedding array<double>").coalesce(1).cache()
    df.count()
    before = peak(spark)
    got = V.search(df, list(enumerate(asked)), 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("x")).collect()
    assert peak(spark) - before < 200  # all scores are 288 MB, their order as much again
    assert len(got) == len(asked)
    for x in got[::50]:  # small whole numbers, so that many tie
        s = v @ asked[x.query_id]
        assert [(y.chunk_id, y.score) for y in x.x] == [(k, s[k]) for k in np.argsort(-s, kind="stable")[:3]]


def test_search_in_many_small_steps_is_exact(spark, monkeypatch):
    r = np.random.default_rng(5)
    v, asked = r.integers(-2, 3, (300, 4)).astype(float), r.integers(-2, 3, (7, 4)).astype(float)
    df = spark.createDataFrame([(f"c{k:03}", "t" * 50, [float(y) for y in x]) for k, x in enumerate(v)], "chunk_id string, text string, embedding array<double>").repartition(2)
    for held in (64 << 20, 1000):  # the second hands rows on before it has seen all
        monkeypatch.setattr(V, "TILE", 16)
        monkeypatch.setattr(V, "HELD", held)
        batches = [b for p in range(2) for b in df.where(F.spark_partition_id() == p).toArrow().to_batches(max_chunksize=60)]
        best = V._Best(len(asked), 4, "chunk_id")
        given = []
        for b in batches:
            s = asked @ b.column("embedding").flatten().to_numpy().reshape(-1, 4).T
            q, row = np.nonzero(~(s < best.least[:, None]))
            best.add(q, s[q, row], row, b.select(["chunk_id", "text"]))
            if best.full():
                query, score, row, table = best.prune()
                if best.bytes > held // 2:
                    given += zip(query.tolist(), score.tolist(), table.column("chunk_id").take(row).to_pylist())
                    best.clear()
        if (last := best.prune()) is not None:
            given += zip(last[0].tolist(), last[1].tolist(), last[3].column("chunk_id").take(last[2]).to_pylist())
        for q in range(len(asked)):
            s = v @ asked[q]
            want = [(f"c{k:03}", s[k]) for k in np.argsort(-s, kind="stable")[:4]]
            assert [(c, x) for _, x, c in sorted((g for g in given if g[0] == q), key=lambda g: (-g[1], g[2]))[:4]] == want


def test_rows_without_a_vector_come_last_and_parts_are_scored(spark):
    rows = [(1, None), (2, [1.0, 2.0]), (3, [-1.0, 4.0]), (4, None)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").coalesce(1)
    got = V.search(df, [("q", np.array([1.0, 0.5]))], 4, parts={"first": (0, 1)}).orderBy("rank").collect()
    assert [(x.chunk_id, x.score, x.first) for x in got] == [(2, 2.0, 1.0), (3, 1.0, -1.0), (1, None, None), (4, None, None)]
    assert V.search(df, [], 4).count() == 0


def test_sign_tests_agree(spark):
    cases = [(0, 0), (1, 0), (10, 4), (4, 10), (7, 7), (300, 260), (2000, 1900)]
    df = spark.createDataFrame(cases, "w bigint, l bigint")
    for x in df.select("w", "l", E.sign_test_column(F.col("w"), F.col("l")).alias("p")).collect():
        assert x.p == pytest.approx(E.sign_test(x.w, x.l), rel=1e-6)
