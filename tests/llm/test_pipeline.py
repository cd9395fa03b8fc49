import random

import corpus_pipeline as p
from quarry.llm import quality_rules

from .brute import WORD
from .test_decontaminate import plain as hits
from .test_mixing import filled

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COMMON = "the of and to in is it that for on with as was by this are at from".split()


def planted():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(COMMON) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(n))
    items = [(i, prose(25), None) for i in range(5)]
    docs = [(i, prose(r.randrange(70, 160))) for i in range(150)]
    passage = prose(60)
    copies = [(1000 + i, docs[i][1]) for i in range(20)]
    near = [(2000 + i, " ".join([*docs[i][1].split()[:-1], "changed"])) for i in range(20, 40)]
    junk = [(3000 + i, prose(100).replace(" ", "%%% ")) for i in range(10)] + [(3100, None), (3101, ""), (3102, prose(20))]
    leaks = [(4000 + i, f"{prose(40)} {items[i][1]} {prose(40)}") for i in range(5)]
    shared = [(5000 + i, f"{prose(60)} {passage} {prose(60)}") for i in range(8)]
    rows = [(i, t, "en", r.choice([None, "a", "b", "b", "b"]), len(t or "")) for i, t in docs + copies + near + junk + leaks + shared]
    r.shuffle(rows)
    return rows, items, passage


def test_stages_against_plain_versions(spark, tmp_path):
    rows, items, passage = planted()
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string, extra string").write.parquet(f"{d}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append({x.doc_id: x for x in docs.collect()})
    clean = set(range(150))
    verdicts = quality_rules.op10(spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert set(out[0]) == {x.doc_id for x in verdicts if x.kept} and clean <= set(out[0]) and not any(3000 <= i < 4000 for i in out[0])
    assert set(out[1]) == {i for i in out[0] if not 1000 <= i < 3000}  # copies and near copies, the smallest id stays
    # bytes that an earlier document has go, by a table of all 100-byte strings
    seen = set()
    for i in sorted(out[1]):
        b = out[1][i].text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        assert out[2][i].text == bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore") and out[2][i].n_chars == len(out[2][i].text)
    assert sum(passage in x.text for x in out[2].values()) == 1
    dirty = {i for i, *_, bad in hits([(i, x.text) for i, x in out[2].items()], items) if bad}
    assert set(out[3]) == set(out[2]) - dirty and {4000 + i for i in range(5)} == dirty
    sizes = {}
    for x in out[3].values():
        sizes[x.source] = sizes.get(x.source, 0) + len(WORD.findall(x.text))
    target, taken = filled(sizes), {}
    for x in docs.collect():
        taken[x.source] = taken.get(x.source, 0) + len(WORD.findall(x.text))
    assert all(abs(taken[s] - target[s]) < 200 for s in target)
    assert sorted(map(str, p.run(spark, d).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables_null_ids_and_repeated_rows(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randrange(3, 9))) for _ in range(800)]
    prose = lambda: " ".join(r.choice(COMMON) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(90))
    texts = [prose() for _ in range(3)]
    rows = [(None, texts[0], None, None, None, 1), (5, texts[1], "en", "a", 3, 2), (5, texts[1], "en", "a", 3, 2), (7, texts[1], None, "a", 3, 4), (8, None, None, None, None, None), (9, texts[2], "en", None, 1, 1)]
    for name, some in (("some", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, SCHEMA + ", _row int").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(p.STAGES[:4]):
            stage(spark, docs, d).write.parquet(f"{d}/out{k}")
            docs = spark.read.parquet(f"{d}/out{k}")
        assert sorted((str(x.doc_id), x.text) for x in docs.collect()) == (sorted([("None", texts[0]), ("5", texts[1]), ("9", texts[2])]) if some else [])
        assert docs.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), "_row"]
        assert not some or {x.doc_id for x in p.STAGES[4][1](spark, docs, d).collect()} <= {None, 5, 9}
