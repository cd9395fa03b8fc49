import random

from quarry.llm import mixing

from .brute import WORD

SCHEMA = "doc_id bigint, source string, text string, size string, left double, place int"


def filled(sizes):
    """Targets by resharing what exceeds three times a source's size until nothing does."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in open_)
        target = {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


def rows(seed):
    r = random.Random(seed)
    out = []
    for i in range(600):
        s = r.choice([None, "a", "b", "c", "d", "é", "zz"] if r.random() < 0.2 else ["hot"])
        out.append((i, s, None if i % 50 == 0 else "w\t" * r.randrange(0, 30), "clash", 1.0, 2))
    return out + [(None, "a", "x y", None, None, None), (7, "hot", "again here", None, None, None), (9999, "one", "big " * 500, None, None, None)]


def test_targets_and_taken(spark):
    for seed in (1, 2):
        data = rows(seed)
        df = spark.createDataFrame(data, SCHEMA)
        got = mixing.op4(df).collect()
        sizes, n = {}, {}
        for i, s, t, *_ in data:
            n[i, s, t] = len(WORD.findall(t or ""))
            sizes[s] = sizes.get(s, 0) + n[i, s, t]
        want = filled(sizes)
        assert len(got) == len(data) and sum(want.values()) == sum(sizes.values()) or abs(sum(want.values()) - sum(sizes.values())) < 1e-6
        source = {i: s for i, s, *_ in data}
        taken, largest = {}, {}
        for x in got:
            s = source[x.doc_id]
            assert abs(x.target - want[s]) < 1e-6 and x.source_size == sizes[s]
            assert x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
            taken[s] = taken.get(s, 0) + x.taken
            largest[s] = max(largest.get(s, 0), x.size)
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
        assert sorted(map(str, got)) == sorted(map(str, mixing.op4(df).collect()))
        mixed = mixing.mix(df).collect()
        assert sum(len(WORD.findall(x.text)) for x in mixed) == sum(taken.values())
        assert set(mixed[0].asDict()) == set(df.columns)


def test_empty_tables(spark):
    assert mixing.op4(spark.createDataFrame([], SCHEMA)).collect() == []
    (x,) = mixing.op4(spark.createDataFrame([(1, "a", None, None, None, None)], SCHEMA)).collect()
    assert (x.size, x.target, x.taken) == (0, 0.0, 0)
