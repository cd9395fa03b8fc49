import duckdb

from quarry import queries as _  # noqa: F401
from quarry.registry import ORACLES, QUERIES


def test_relations_are_the_first_verb_between(spark, tmp_path):
    texts = ["Anna met and found Bert in town.", "Anna traf den Bert.", "Anna rencontre Bert.", "Anna compró a Bert.", "Anna and Bert met."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.relation) for x in QUERIES["grf02_relations"](spark, str(tmp_path)).collect() if (x.src, x.dst) == ("Anna", "Bert")}
    assert got == {(0, "meet"), (1, "treffen"), (2, "rencontrer"), (3, "comprar"), (4, "related_to")}
    assert {x.relation: x.n for x in QUERIES["grf10_relations"](spark, str(tmp_path)).collect()}["meet"] == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("CREATE VIEW benchmark AS SELECT doc_id AS item_id, text FROM documents")
    for name in ("grf02_relations", "grf10_relations", "snk05_graphml_lines"):
        df, sql = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        assert sorted(tuple(x) for x in df.select(*(c[0] for c in sql.description)).collect()) == sorted(sql.fetchall())
