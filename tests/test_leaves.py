from quarry import queries as _  # noqa: F401
from quarry.registry import QUERIES


def test_leaves_of_whole_texts_match_a_json_parser(spark, tmp_path):
    texts = ["short", 'said "a", then [1, "b"]: {"c": "d"} and \\ or \\" at the end\\', "line\nbreak\ttab\r" * 20, "été 中文 " * 5000, "", "x" * 200000 + '", "y"']
    rows = [(i, t, "en", "a: b") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.event_id, x.pos): x.leaf for x in QUERIES["src06c_string_leaves"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): v for i, t, lang, source in rows for k, v in enumerate([lang, source, t])}
