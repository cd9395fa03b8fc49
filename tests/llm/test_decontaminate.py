import hashlib
import random

from quarry.llm import decontaminate as c

from .brute import ALNUM, LOWER

DOCS, ITEMS = "doc_id bigint, text string, n int, run string, items string, _id string, __x int", "item_id bigint, text string, _id string"


def plain(docs, items):
    toks = lambda t: ALNUM.findall((t or "").translate(LOWER))
    wins = {}
    for i, t, _ in items:
        w = toks(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).update(() if i is None else (str(i),))
    out = []
    for i, t, *_ in docs:
        w, hit, found = toks(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                x = wins.get(tuple(w[k : k + n]))
                if x is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(2)
    word = lambda: r.choice("alpha beta gamma delta eins zwei été x1 y".split())
    items = [(i, " ".join(word() for _ in range(r.randrange(10, 30))), "clash") for i in range(12)]
    items += [(50, "short item words", None), (51, "one", None), (52, "", None), (53, None, None), (None, "null id item", None), (3, items[3][1], None), (54, "a, b! C? d e f g h i j", None)]
    docs = []
    for i in range(120):
        w = [word() + str(r.randrange(30)) for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(3)):
            t = (r.choice(items[:13])[1] or "").split()
            a = r.randrange(max(1, len(t) - 11))
            k = r.randrange(len(w) + 1)
            w[k:k] = t[a : a + r.choice([9, 10, 11, 15])]
        docs.append((i, r.choice([" ", "\n", " - "]).join(w).title(), 1, "clash", None, "id", 1))
    docs += [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (902, "Short, ITEM words", None, None, None, None, None), (903, "A b c d e f g h i j" * 500, None, None, None, None, None), (None, docs[3][1], None, None, None, None, None), (5, docs[5][1], None, None, None, None, None)]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = plain(docs, items)
    assert sorted((tuple(x) for x in c.op8(d, b).collect()), key=str) == want
    monkeypatch.setattr(c, "BROADCAST_ROWS", 0)  # the way beyond the broadcast
    assert sorted((tuple(x) for x in c.op8(d, b).collect()), key=str) == want
    clean = c.decontaminate(d, b)
    assert clean.columns == d.columns and sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(x[0]) for x in want if not x[-1])


def test_empty_tables(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert c.op8(spark.createDataFrame([], DOCS), b).collect() == []
    assert not any(x.contaminated for x in c.op8(d, spark.createDataFrame([], ITEMS)).collect())


def test_passages_of_items_without_an_id_are_taken_out(spark):
    passage = "one passage of an item that has no id but twelve words"
    docs = [(1, f"before {passage} after", None, None, None, None, None), (2, "before and after", None, None, None, None, None)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(None, passage, None)], ITEMS)
    assert [x.doc_id for x in c.decontaminate(d, b).collect()] == [2]
    assert sorted((x.doc_id, x.n_hit, x.n_items, x.contaminated) for x in c.op8(d, b).collect()) == [(1, 12, 0, True), (2, 0, 0, False)]
