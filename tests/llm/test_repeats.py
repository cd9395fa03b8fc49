import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import repeats as r9

SCHEMA = "doc_id bigint, text string, page string, found int"


def plain(rows):
    """(id, bytes, removed, runs, digest) of each row; rows in order of id, then place."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 6)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(6)]
    line = "a common line of some seventy bytes that many of the documents share ok. "
    out = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 200, line * 6]
    for _ in range(n):
        t = " ".join(word() for _ in range(r.randrange(0, 150)))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(t) + 1)
            p = r.choice(passage)
            a = r.randrange(60)
            t = t[:k] + r.choice([p, p[a:], p[: len(p) - a], line]) + t[k:]
        out.append(t)
        if r.random() < 0.2:
            k = r.randrange(len(t) + 1)
            out.append(r.choice([t, t[:k] + "z" + t[k:]]))
    return out


#: Many pages, buckets and crowded anchors.
SMALL = {"page_bytes": 3000, "bucket": 2000, "index": 1000, "crowd": 2}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_matches_brute_force(spark, sizes):
    t = texts(5, 120)
    rows = [(i * 7 % 1009, x) for i, x in enumerate(t)] + [(None, t[20])]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in r9.op9(df, **sizes).collect()), key=str)
    assert got == plain(rows)
    kept = {x.doc_id: x.text for x in r9.drop_repeats(df).collect() if x.doc_id is not None}
    want = {i: n - g for i, n, g, _, _ in plain(rows) if i is not None and (n == 0 or g < n)}
    assert set(kept) == set(want) and all(len((kept[i] or "").encode()) in range(want[i] - 6, want[i] + 1) for i in kept)


def test_classes_match_sorted_prefixes():
    r = np.random.default_rng(3)
    for n, values, length in ((1, 2, 3), (50, 2, 5), (400, 3, 9), (3000, 2, 12), (500, 1, 20)):
        t = np.concatenate([r.integers(1, values + 1, n), [0]]).astype(np.int16)
        order, kind = r9.same_prefix_classes(t, length)
        prefixes = [tuple(t[p : p + length]) for p in order]
        assert prefixes == sorted(prefixes) or all(a <= b for a, b in zip(prefixes, prefixes[1:]))
        assert [a != b for a, b in zip(prefixes, prefixes[1:])] == [a != b for a, b in zip(kind, kind[1:])]


def test_empty_table(spark):
    assert r9.op9(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_ids_are_ordered_and_nothing_is_too_long(spark):
    shared = "a passage of more than a hundred bytes that two documents have in common, word for word, from here to its very end. "
    long = " ".join(str(i) for i in range(200_000))
    rows = [("b", "x " + shared + "y", None, 1), ("a", "z " + shared, None, 2), (None, shared, None, 3), ("c", long, None, 4)]
    got = {x.doc_id: x.text for x in r9.drop_repeats(spark.createDataFrame(rows, "doc_id string, text string, page string, found int")).collect()}
    assert got[None] == shared and got["a"] == "z " and got["b"] == "xy" and got["c"] == long
    assert list(r9._ids(pa.table({"doc_id": pa.array(["b", None, "a", "ab"])})).argsort()) == [1, 2, 3, 0]
