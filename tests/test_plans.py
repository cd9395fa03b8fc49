"""Whole plans, sources, sinks and the stream."""

import json

from quarry.operators import graph as G
from quarry.operators import vectors as V
from quarry.plans.answer import Settings, answer, offline
from quarry.sources import sinks
from quarry.sources import structured as S
from quarry.streaming.ingest import ingest

FILES = [
    ("F1_Alpha/a.md", "# Head\nThe river is long and wide. It is in the north of the land."),
    ("F2_Beta/b.txt", "The mountain is high. It has snow on it for most of the year. " * 8),
    ("F2_Beta/c.csv", "name: x | value: 1\n\nname: y | value: 2"),
    ("F3_Gamma/skip.avif", "not read"),
    ("F3_Gamma/d.md", "Another text of the kind that is about rivers and lakes, to be found."),
]


def test_offline_then_answer(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    manifest = spark.createDataFrame([(p.lower(), p.split("/")[1].lower(), f"D{i}") for i, (p, _) in enumerate(FILES)], "path_norm string, name_norm string, id string")
    first, second = V.get_encoder("embedding"), V.get_encoder("second")
    chunks = offline(files, manifest, {"embedding": first, "second": second}).cache()
    got = chunks.collect()
    assert {r.doc_id for r in got} == {"D0", "D1", "D2", "D4"} and sum(r.doc_id == "D2" for r in got) == 2
    assert all(r.chunk_id == f"{r.doc_id}-c{r.pos:04d}" for r in got) and {r.topic for r in got} == {1, 2, 3}
    done = spark.createDataFrame([("D0",)], "doc_id string")
    assert "D0" not in {r.doc_id for r in offline(files, manifest, {}, done).collect()}
    queries = spark.createDataFrame([(0, "q1", "River in the north, recent"), (1, "q2", "")], "ord int, query_id string, text string")
    edges = G.triples(chunks.selectExpr("doc_id", "chunk_id", "text AS sentence"))
    out = answer(queries, chunks, first, {"second": second}, edges, Settings(pool=20, recency_weight=0.1)).collect()
    assert {r.query_id for r in out} == {"q1", "q2"}
    for r in out:
        assert [d.rank for d in r.documents] == [1, 2, 3][: len(r.documents)]
        assert [f.rank for f in r.fragments] == list(range(1, len(r.fragments) + 1)) and all(len(f.text.split()) <= 250 for f in r.fragments)
    again = answer(queries, chunks, first, {"second": second}, edges, Settings(pool=20, recency_weight=0.1)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_query_files_of_any_encoding(spark, tmp_path):
    rows = [{"id": "q1", "consulta": "¿qué hay?"}, {"query_id": "q2", "query": "more"}, {"query_id": "q3", "text": "  "}]
    body = "\r\n\r\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    for name, data in (("u", body.encode()), ("b", b"\xef\xbb\xbf" + body.encode()), ("w", body.encode("cp1252"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "q.jsonl").write_bytes(data)
        got = S.read_queries(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [(r.query_id, r.text) for r in got] == [("q1", "¿qué hay?"), ("q2", "more")]


def test_tables_graphs_and_results_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("pais,indicador\nChile,3\nPeru,\n")
    assert [r.text for r in S.read_table(spark, str(tmp_path / "t.csv")).orderBy("pais").collect()] == ["pais: Chile | indicador: 3", "pais: Peru"]
    edges = spark.createDataFrame([("A & B", "r", "C", "ORG", "PER", "d", "c")], "src string, relation string, dst string, src_type string, dst_type string, doc_id string, chunk_id string")
    sinks.write_graphml(G.nodes(edges), edges, str(tmp_path / "g"))
    back = S.read_graphml(spark, str(tmp_path / "g")).collect()
    assert [(r.src, r.dst, r.fields["relation"]) for r in back] == [("A & B", "C", "r")]
    res = spark.createDataFrame([("q1", ["a"]), ("q2", ["b"])], "query_id string, documents array<string>")
    order = spark.createDataFrame([("q2", 0), ("q1", 1)], "query_id string, ord int")
    sinks.write_results(res, order, str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["query_id"] for x in lines] == ["q2", "q1"]


def test_graphs_in_parts_are_read_whole(spark, tmp_path):
    edge = '<edge source="{0}" target="{1}"><data key="relation">r</data></edge>'
    parts = ['<graphml><graph edgedefault="directed">', '<node id="A"></node>', edge.format("A", "B"), edge.format("B &amp; C", "D"), edge.format("E", "F"), "</graph></graphml>"]
    (tmp_path / "g").mkdir()
    for k in range(3):
        (tmp_path / "g" / f"part-{k}.txt").write_text("\n".join(parts[2 * k : 2 * k + 2]) + "\n")
    back = S.read_graphml(spark, str(tmp_path / "g")).collect()
    assert sorted((r.src, r.dst, r.fields["relation"]) for r in back) == [("A", "B", "r"), ("B & C", "D", "r"), ("E", "F", "r")]


def test_stream_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "One sentence here. And another."), (2, "Second text.")], "doc_id bigint, text string")
    docs.write.parquet(src)
    for check in ("c1", "c2"):  # the second stream sees the same files again
        ingest(spark, src, out, str(tmp_path / check)).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3, "A third.")], "doc_id bigint, text string").write.mode("append").parquet(src)
    ingest(spark, src, out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 3
