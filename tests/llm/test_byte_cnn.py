import random
import zlib

import numpy as np

from quarry.llm import byte_cnn as c

DOCS, LABELS = "doc_id bigint, text string, lang string, score double", "doc_id bigint, quality int, toxic int, text string"


def test_maxima_match_brute_force_and_batches_do_not_matter():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 255, 256, 257, 2000)]
    net = c.Network()
    x = c.Layout(texts)
    got, _ = c.block_maxima(x, net.table)
    for i, t in enumerate(texts):
        at = x.first[i]
        padded = (t or b"\0") + bytes(2 * c.BLOCK)
        for b in range(0, max(1, len(t)), c.BLOCK):
            starts = range(b, min(b + c.BLOCK, max(1, len(t))))
            want = np.max([sum(net.table[k, padded[s + k]] for k in range(c.WIDTH)) for s in starts], axis=0)
            assert np.allclose(got[at], want, atol=1e-4)
            at += 1
    assert np.allclose(net.logits(texts), [net.logits([t])[0] for t in texts], atol=1e-4)


def test_gradients_match_differences():
    texts, y, net = [b"abc def " * 60, b"xx"], np.array([1.0, 0.0]), c.Network()
    loss = lambda: float(np.mean(np.logaddexp(0, net.logits(texts)) - y * net.logits(texts)))
    g = net.gradients(texts, y)
    for p, d in list(zip(net.parts(), g))[1:]:
        i = tuple(np.unravel_index(np.argmax(np.abs(d)), d.shape))
        p[i] += 1e-5
        up = loss()
        p[i] -= 2e-5
        down = loss()
        p[i] += 1e-5
        assert abs((up - down) / 2e-5 - d[i]) < 1e-3


def test_held_out_accuracy_and_defined_edge_cases(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice("alpha beta gamma delta river stone house light".split()) for _ in range(r.randrange(5, 90)))
    docs, labels = [], []
    for i in range(600):
        t = good()
        if i % 3 == 0:
            t = t.replace(" ", r.choice(["%% ", "$$ "]))
        docs.append((i, t, None, None))
        labels.append((i, int(i % 3 != 0), None, "clash"))
    docs += [(1000, None, None, None), (None, "", "en", 1.0), (1001, "alpha beta " * 30000, None, None), (5, docs[5][1], None, None)]
    labels += [(5, 1, None, None), (7, None, None, None), (None, 1, None, None)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = c.op2(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 600 and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert sum(x.predicted == int(x.doc_id % 3 != 0) for x in held) / len(held) > 0.95
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t, s) for i, y, t, s in labels if i is not None and y is not None], LABELS)
    again = {x.doc_id: x.score for x in c.op2(d, flipped).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-6 for x in held)  # held-out labels teach nothing
    assert c.op2(spark.createDataFrame([], DOCS), lab).collect() == []
    assert {x.score for x in c.op2(d, spark.createDataFrame([], LABELS)).collect()} == {0.5}


def test_the_sample_holds_whole_texts_within_its_bound(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i) * (500 if i == 7 else 1), None, None) for i in range(1, 40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, None, None) for i in range(1, 40)], LABELS)
    whole = {("x" * (10 + i) * (500 if i == 7 else 1)).encode() for i in range(1, 40)}
    texts, y, _ = c.sample(docs, labels, 600)
    assert set(texts) <= whole and 400 < sum(map(len, texts)) <= 600 and len(texts) == len(y)
    texts, _, share = c.sample(docs, labels)
    assert set(texts) == {t for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5 for t in [("x" * (10 + i) * (500 if i == 7 else 1)).encode()]}
    assert 0 < share < 1
