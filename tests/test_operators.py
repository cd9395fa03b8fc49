"""Small inputs with known results, and what must hold whatever the input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking as C
from quarry.operators import evaluate as E
from quarry.operators import graph as G
from quarry.operators import results as A
from quarry.operators import retrieve as R
from quarry.operators import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "broken, whole",
    [("satel￾lites", "satellites"), ("AI￾related", "AIrelated"), ("AI￾Related", "AI-Related"), ("COVID￾19", "COVID-19"), ("US￾based", "US-based"), ("a ￾b", "a b"), ("co­op", "coop"), ("19￾th", "19-th")],
)
def test_repair_breaks(spark, broken, whole):
    if broken == "AI￾related":
        whole = "AI-related"
    assert one(spark, broken, T.repair_breaks) == whole


def test_clean_text_order(spark):
    assert one(spark, " a\x07 \t b \n\n\n\n c \x7f", T.clean_text) == "a b\n\n c"
    assert one(spark, None, T.clean_text) is None


@pytest.mark.parametrize(
    "text, low, high",
    [
        ("", 1, 1),
        ("Plain prose about rivers. It cites nothing at all and goes on for a while.", 0, 0),
        ('[12] "A long enough title here," accessed March 3, 2019, https://a.org/b.', 1, 1),
        ('Useful prose that says something of note. 144 Richard Fisher, "The Whole Long Title of It," Journal, vol. 3, June 2, 2018.', 0.2, 0.9),
    ],
)
def test_reference_share(spark, text, low, high):
    assert low <= one(spark, text, T.reference_share) <= high


def test_glossary_keeps_order_and_repeats_nothing(spark):
    got = one(spark, "¿Amenazas Contraespaciales y guerra electrónica?", T.expand_query)
    assert got == "¿Amenazas Contraespaciales y guerra electrónica? counterspace electronic warfare jamming"
    assert one(spark, "nothing here", T.expand_query) == "nothing here"


def test_years_and_recency_words(spark):
    assert one(spark, "ai-index-2024-ch1-1889-2051", T.year_of) == 2024
    assert one(spark, "no year", T.year_of) is None
    assert one(spark, "avances recientes", T.asks_for_recent) and not one(spark, "prerecent 1967", T.asks_for_recent)


PROSE = "One two three. Four five six seven. Eight nine. Ten eleven twelve thirteen fourteen. Fifteen."


def test_packing_keeps_sentences_whole(spark):
    sentences = one(spark, PROSE, T.sentences)
    assert len(sentences) == 5
    for budget in (3, 5, 8, 100):
        for overlap in (0, 1):
            got = [c.text for c in one(spark, PROSE, lambda c, b=budget, o=overlap: C.pack(T.sentences(c), b, o))]
            assert " ".join(dict.fromkeys(s for c in got for s in one(spark, c, T.sentences))) == PROSE
            assert all(len(c.split()) <= budget or len(one(spark, c, T.sentences)) == 1 for c in got)
            if overlap == 0:
                assert " ".join(got) == PROSE


def test_packing_overlap_by_hand(spark):
    got = one(spark, ["a b.", "c d.", "e.", "f g h i j.", "k."], lambda c: C.pack(c, 4, 1), "array<string>")
    assert [c.text for c in got] == ["a b. c d.", "c d. e.", "f g h i j.", "k."]


def test_sections_and_positions(spark):
    df = spark.createDataFrame([(1, "Intro here.\n# One\nBody one. More.\n## Empty\n# Two\nBody two.")], "doc_id int, text string")
    got = C.chunks(df).orderBy("pos").collect()
    assert [(c.pos, c.section, c.text) for c in got] == [(0, None, "Intro here."), (1, "One", "Body one. More."), (2, "Two", "Body two.")]
    assert got[1].chunk_id == "1-c0001"


def test_overlap_comes_off_and_repack_restores(spark):
    df = spark.createDataFrame([(1, 0, "s", "Alfa uno. Beta dos. Gamma tres."), (1, 1, "s", "Gamma tres. Delta cuatro."), (1, 2, "t", "Delta cuatro. Eps.")], "doc_id int, pos int, section string, text string")
    assert [r.k for r in C.without_overlap(df).orderBy("pos").collect()] == [0, 1, 0]
    got = [r.text for r in C.repack(df, 100, 0).orderBy("pos").collect()]
    assert got == ["Alfa uno. Beta dos. Gamma tres. Delta cuatro.", "Delta cuatro. Eps."]
    assert [r.shared for r in C.character_overlap(df).orderBy("pos").collect()] == [0, len("Gamma tres."), len("Delta cuatro.")]


def test_split_long(spark):
    long = " ".join(f"W{i}" for i in range(600)) + "."
    parts = one(spark, f"Short one. {long}", C.split_long)
    assert [len(p.split()) for p in parts] == [2, 250, 250, 100] and " ".join(parts) == f"Short one. {long}"


def pool(spark, rows):
    data = [(1, i + 1, c, d, float(s), t) for i, (c, d, s, t) in enumerate(rows)]
    return spark.createDataFrame(data, "query_id int, rank int, chunk_id int, doc_id string, score double, topic int")


def test_topic_filter(spark):
    p = pool(spark, [(1, "a", 0.9, 2), (2, "b", 0.8, 2), (3, "c", 0.1, 3), (4, "d", 0.0, None)])
    assert {r.doc_id for r in A.dominant_topic(p, 0.5).collect()} == {"a", "b"}
    tie = pool(spark, [(1, "a", 0.5, 1), (2, "b", 0.5, 2)])
    assert A.dominant_topic(tie, 0.9).count() == 2


def test_strategies_and_identities(spark):
    p = pool(spark, [(1, "A", 0.9, 1), (2, "C", 0.7, 1), (3, "B", 0.5, 1), (4, "A", 0.2, 1), (5, "D", 0.1, 1)])
    order = lambda s, **k: [r.doc_id for r in A.documents(p, s, 4, **k).orderBy("rank").collect()]
    assert order("max") == ["A", "C", "B", "D"] == order("top1")
    assert order("mean") == ["C", "A", "B", "D"]
    assert order("top6") == order("sum") == order("top6", alpha=0.0)
    with pytest.raises(ValueError):
        A.documents(p, "best")


def test_cascade_identity_and_flat_pool(spark):
    p = pool(spark, [(1, "A", 0.3, 1), (2, "B", 0.2, 1)]).withColumn("second", F.lit(0.7))
    assert [r.total for r in R.cascade(p, {"second": 0.0}, how=None).orderBy("rank").collect()] == [0.3, 0.2]
    assert [r.total for r in R.cascade(p, {"second": 5.0}).orderBy("rank").collect()] == [1.0, 0.0]  # a flat range adds nothing


def test_rrf_and_rank_scale(spark):
    p = pool(spark, [(1, "A", 0.9, 1), (2, "B", 0.5, 1)])
    fused = R.rrf([p, p.withColumn("rank", 3 - F.col("rank"))]).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == [1, 2] and math.isclose(fused[0].score, round(1 / 61 + 1 / 62, 9))
    assert [r.scaled for r in R.rank_scaled(p, "score").orderBy("rank").collect()] == [1.0, 0.0]


def test_bm25_finds_the_rare_term(spark):
    docs = spark.createDataFrame([(i, "common words everywhere") for i in range(20)] + [(99, "common zebra words")], "doc_id int, text string")
    got = R.bm25(docs, spark.createDataFrame([(1, "zebra zebra")], "query_id int, text string"), 5).collect()
    idf = math.log(1 + (21 - 1 + 0.5) / 1.5)
    assert [(r.doc_id, r.score) for r in got] == [(99, round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75)), 6))]


def test_search_is_exact_and_filters_come_after(spark):
    enc = V.get_encoder("hashing")
    v = enc.encode_passages([f"t{i}" for i in range(50)])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    assert not np.allclose(v[0], V.HashingEncoder("another").encode_passages(["t0"])[0])
    df = spark.createDataFrame([(i, i % 2, [float(y) for y in x]) for i, x in enumerate(v)], "chunk_id bigint, topic int, embedding array<float>").repartition(3)
    got = V.search(df, [(7, v[7])], 5).orderBy("rank").collect()
    want = np.argsort(-(v.astype(float) @ v[7].astype(float)), kind="stable")[:5]
    assert [r.chunk_id for r in got] == list(want) and abs(got[0].score - 1) < 1e-5
    assert V.filtered_search(df, [(7, v[7])], 5, F.col("topic") == 9).count() == 0


def test_fragments_reorder_and_drop_nothing(spark):
    data = [(1, 1, 10, "A", 0.9, "fr", "some words", 0.0), (1, 2, 11, "B", 0.8, "en", "zebra crossing", 0.9), (1, 3, 12, "A", 0.7, "en", "zebra herd", 0.0), (1, 4, 13, "A", 0.6, "en", "Zebra  herd", 0.0)]
    p = spark.createDataFrame(data, "query_id int, rank int, chunk_id int, doc_id string, score double, lang string, text string, reference_share double")
    docs = spark.createDataFrame([(1, 1, "A")], "query_id int, rank int, doc_id string")
    tokens = spark.createDataFrame([(1, ["zebra"])], "query_id int, tokens array<string>")
    o = A.ordered_fragments(p, docs, tokens)
    assert [r.chunk_id for r in o.orderBy("position").collect()] == [12, 13, 11, 10]
    assert [r.chunk_id for r in A.take_fragments(o).orderBy("fragment").collect()] == [12, 11, 10]
    assert A.aligned_fragments(o, docs, 1).orderBy("fragment").first().chunk_id == 12


def test_recency_weight_zero_is_identity(spark):
    d = spark.createDataFrame([(1, 1, "A", 0.5, 1999), (1, 2, "B", 0.45, 2025), (1, 3, "C", 0.4, None)], "query_id int, rank int, doc_id string, score double, year int")
    ids = lambda w: [r.doc_id for r in A.recency(d, w).orderBy("rank").collect()]
    assert ids(0.0) == ["A", "B", "C"] and ids(0.5) == ["B", "A", "C"]


def test_metrics_by_hand(spark):
    res = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id int, rank int, doc_id string")
    rel = spark.createDataFrame([(1, "a"), (1, "x"), (2, "y")], "query_id int, doc_id string")
    got = {r.query_id: r for r in E.scores(res, rel).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.333333, 0.5, 0.4) and got[2].f1 == 0
    assert E.sign_test(10, 4) == pytest.approx(0.1796, abs=1e-3) and E.sign_test(0, 0) == 1
    low, high = E.bootstrap([0.1] * 8)[1:]
    assert low == pytest.approx(0.1) and high == pytest.approx(0.1)


def test_graph_evidence_and_ties(spark):
    s = spark.createDataFrame([("d1", "c1", "Ada Lovelace met Charles Babbage in London."), ("d2", "c2", "London saw Ada Lovelace.")], "doc_id string, chunk_id string, sentence string")
    e = G.triples(s, {"met": "meet"})
    assert {(r.src, r.relation, r.dst) for r in e.collect()} == {("Ada Lovelace", "meet", "Charles Babbage"), ("Charles Babbage", "related_to", "London"), ("London", "related_to", "Ada Lovelace")}
    q = spark.createDataFrame([(1, "london")], "query_id int, entity string")
    assert {r.chunk_id: r.evidence for r in G.evidence(e, q, 5).collect()} == {"c1": 1, "c2": 1}
    p = spark.createDataFrame([(1, 1, "c0", 0.5), (1, 2, "c1", 0.5)], "query_id int, rank int, chunk_id string, score double")
    assert {r.chunk_id: r.new_rank for r in G.break_ties(p, G.evidence(e, q, 5)).collect()} == {"c1": 1, "c0": 2}


def test_components_of_long_chains_are_whole(spark):
    names = [f"n{i:03d}" for i in range(80)]
    chain = [(a, b) for a, b in zip(names, names[1:])] + [("x1", "x2")]
    got = {(x.node, x.root) for x in G.components(spark.createDataFrame(chain, "src string, dst string")).collect()}
    assert got == {(n, "n000") for n in names} | {("x1", "x1"), ("x2", "x1")}


def test_conservation_counts_headings_and_keeps_documents_without_chunks(spark, tmp_path):
    from quarry.registry import QUERIES

    texts = ["One two. Three\n#  Four five\nSix. Seven", "## Only a title", "", " \n", None, "#\tA\n# B\nC d.", "####### no heading", "Twice here.", "Twice here."]
    docs = spark.createDataFrame([(min(k, 7), t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["chk11_conservation"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.words, r.whole) for r in got) == [(0, 8, True), (1, 4, True), (2, 0, True), (3, 0, True), (4, 0, True), (5, 6, True), (6, 3, True), (7, 2, True), (7, 2, True)]
