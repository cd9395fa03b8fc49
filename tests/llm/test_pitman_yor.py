import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import pitman_yor as py

from .brute import LOWER, WORD

SCHEMA = "doc_id bigint, text string, page string, score int"


def test_base_and_perplexity(spark):
    r = random.Random(8)
    # two dialects with a short word each, so that the words before tell something
    forms = [[d if k % 4 == 0 else f"{s}{k}{e}" for k in range(300)] for s, e, d in (("ba", "xo", "da"), ("ki", "mu", "ne"))]
    rows = []
    for i in range(400):
        w = forms[i % 2]
        rows.append((i, " ".join(w[min(299, int(r.expovariate(0.02)))] for _ in range(r.randrange(1, 60))), None, 1))
    rows += [(900, None, None, None), (901, "", None, None), (902, " \n\tBA1XO  é x\u001c ", None, None), (5, rows[5][1], "clash", None), (None, "ba1xo", None, None)]
    got = py.op7(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t, *_ in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    by = {x.doc_id: x for x in got}
    base = score = 0.0
    for i, t, *_ in rows:
        x, w = by[i], tokens(t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out(i), len(w), sum(c[k] > 0 for k in w), n)
        assert math.isclose(x.base_score, sum(math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w), rel_tol=1e-9)
        assert x.score < 0
        if x.held_out:
            base, score = base + x.base_score, score + x.score
    assert score > base  # better perplexity on held-out texts
    again = {x.doc_id: x.score for x in py.op7(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(math.isclose(again[x.doc_id], x.score) for x in got)


def test_very_long_texts_and_words_are_scored_whole(spark):
    rows = [(1, "a b c " * 50_000, None, 1), (2, "w" * 100_000, None, 1), (3, "a b c", None, 1), (4, "w" * 100_000 + " a", None, 1)]
    tokens = lambda t: WORD.findall(t) + [""]
    learnt = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in learnt for w in tokens(t))
    got = {x.doc_id: x for x in py.op7(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(c.values()))
        assert math.isfinite(got[i].score) and got[i].score < 0


def test_spelling_sums_to_one():
    words = py.Words.of(pa.array(["", "abc", "abd", "été", "a"]))
    keys, place, _, _ = words.letters()
    r = np.random.default_rng(0)
    s = py.Spelling().fit(keys, np.bincount(place) * 3.0, r, None)
    s = py.Spelling().fit(keys, np.bincount(place) * 3.0, r, s)
    for context in np.unique(keys >> 8):
        assert abs(s.of(context << 8 | np.arange(256)).sum() - 1) < 1e-5


def test_tables_follow_the_sequential_process():
    r = np.random.default_rng(1)
    n = np.full(20000, 40)
    t = py.seat(n, np.full(20000, 0.2), 1.0, 0.5, 0.0, r)
    want = []
    for _ in range(4000):
        tables = 1
        for k in range(1, 40):
            fresh = (1 + 0.5 * tables) * 0.2
            tables += r.random() < fresh / (fresh + k - 0.5 * tables)
        want.append(tables)
    assert abs(t.mean() - np.mean(want)) < 0.1 and t.min() >= 1
    big = py.seat(np.array([10**6] * 200), np.full(200, 0.2), 1.0, 0.0, 0.0, r)
    assert abs(big.mean() - (1 + 0.2 * np.log(10**6))) < 0.5


def test_empty_tables(spark):
    assert py.op7(spark.createDataFrame([], SCHEMA)).collect() == []
    (x,) = py.op7(spark.createDataFrame([(10, "only held out", None, None)], SCHEMA)).collect() if zlib.crc32(b"10") % 5 == 1 else (None,)
    assert x is None or x.train_tokens == 0


def test_contexts_share_their_parent_and_sum_to_one(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(3000) if i not in set(held)][:300]
    rows = [(i, " ".join(r.choice(words[:6] if r.random() < 0.7 else words) for _ in range(r.randrange(1, 30)))) for i in train]
    asked = [(u, w) for u in ("w0", "w33", "never") for w in [*words, "xyz", ""]]  # a frequent, a rare and an unknown context
    rows += [(i, f"{u} {w}") for i, (u, w) in zip(held, asked)]
    rows.append((held[-1], " ".join(r.choice(words) for _ in range(150_000))))
    got = {x.doc_id: x for x in py.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), tokens=True).collect()}
    assert all(math.isclose(sum(x.token_scores), x.score) and math.isclose(x.perplexity, 10 ** (-x.score / x.n_tokens)) for x in got.values())
    assert len(got[held[-1]].token_scores) == 150_001
    p = {a: 10 ** got[i].token_scores[1] for i, a in zip(held, asked)}
    known = {u: sum(p[u, w] for w in [*words, ""]) for u in ("w0", "w33", "never")}
    assert 0.5 < known["never"] < 1
    for u in ("w0", "w33"):  # what is left over is the parent's rest times the share that backs off to it
        assert math.isclose(1 - known[u], p[u, "xyz"] / p["never", "xyz"] * (1 - known["never"]), rel_tol=1e-3)


def test_copies_of_what_was_learnt_stand_out(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(200)]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:80]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = list(zip(train, texts + texts[:40])) + [(i, texts[k] if k < 40 else " ".join(r.choice(words) for _ in range(60))) for k, i in enumerate(held)]
    got = {x.doc_id: x.score for x in py.op7(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    twice, once = [got[i] for i in train[:40]], [got[i] for i in train[40:200]]
    assert min(twice) > max(once)
    assert min(got[i] for i in held[:40]) > max(got[i] for i in held[40:])
