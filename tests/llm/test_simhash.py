import random

from quarry.llm import simhash
from quarry.llm.common import Scratch

from .brute import groups
from .brute import simhash as plain

SCHEMA = "doc_id bigint, text string, fp string, node int"


def test_fingerprints_and_groups_match_brute_force(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "Gamma", "été", "x\u001cy", "z w"]
    texts = [None, "", " \t\n\x0b\x0c\r ", "One", "one", "two words", "a  b\tc", " a b c "]
    for _ in range(60):
        w = [r.choice(words) + str(r.randrange(40)) for _ in range(r.randrange(3, 200))]
        texts += [" ".join(w), "\n".join(w), " ".join(w[:-1] + ["other"])]
    ids = [*range(len(texts) - 2), 5, None]
    rows = [(i, t, "clash", 1) for i, t in zip(ids, texts)]
    got = simhash.op6(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain(t, 3) for t in texts]
    want = sorted(zip((str(i) for i in ids), (f"{x:016x}" for x in fps), groups(fps, ids, 2)), key=str)
    assert sorted(((str(x.doc_id), x.fingerprint, x.component_id) for x in got), key=str) == want


def test_crowded_cells_lose_no_link(spark):
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(3)]
    fps = {s for s in seeds}
    while len(fps) < 300:
        x = r.choice(sorted(fps))
        fps.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    for crowd in (1000, 4):
        got = simhash.links(df, Scratch(spark, "t"), 2, 3, crowd).collect()
        assert {frozenset((x.a, x.b)) for x in got} == want


def test_empty_table(spark):
    assert simhash.op6(spark.createDataFrame([], SCHEMA)).collect() == []


def test_forests_keep_the_groups(spark):
    import numpy as np

    r = random.Random(6)
    seeds = [(r.getrandbits(64), [r.getrandbits(64) for _ in range(4)]) for _ in range(12)]
    rows = []
    for i in range(400):
        fp, wide = r.choice(seeds)
        for _ in range(r.randrange(7)):
            fp ^= 1 << r.randrange(64)
        wide = [w ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (2**64 - 1) for w in wide]
        rows.append((i, fp, wide))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(f), [signed(w) for w in ws]) for i, f, ws in rows], "node bigint, fp bigint, wide array<bigint>")
    link = lambda a, b: (a[1] ^ b[1]).bit_count() <= 7 and sum((x ^ y).bit_count() for x, y in zip(a[2], b[2])) <= 44
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(400):
        for j in range(i):
            if link(rows[i], rows[j]):
                root[find(i)] = find(j)
    want = [find(i) for i in range(400)]
    got = simhash.forest_links(df, 7, 9, 44).collect()
    assert all(link(rows[x.a], rows[x.b]) for x in got)
    root[:] = range(400)
    for x in got:
        root[find(x.a)] = find(x.b)
    have = [find(i) for i in range(400)]
    assert len(set(zip(want, have))) == len(set(want)) == len(set(have))
    assert np.all(np.array(want) >= 0)


def test_one_of_each_group_stays(spark):
    r = random.Random(9)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(300)) for _ in range(20)]
    rows = [(i, t, "clash", i) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[150] = "changed"
        rows += [(100 + i, " ".join(w), None, 1), (200 + i, t.upper() + " ", None, 1)]
    rows += [(500, None, None, 1), (501, " ", None, 1), (7, base[7], "again", 2), (None, "only one of its kind here", None, 1)]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted([*range(20), 500, None], key=str)
    assert simhash.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_copies_link_at_an_exact_similarity(spark):
    r = random.Random(13)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    likeness = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    rows, kept, seen = [], [], []
    for i in range(120):
        base = [f"w{r.randrange(9000)}" for _ in range(r.randrange(60, 400))]
        other = list(base)
        for k in r.sample(range(len(other)), 1 + len(other) * r.randrange(1, 6) // 100):  # scattered edits: 0.6 to 0.9
            other[k] = f"new{k}"
        s = likeness(base, other)
        seen.append(s)
        rows += [(2 * i, " ".join(base), None, 1), (2 * i + 1, " ".join(other), None, 1)]
        kept += [2 * i] if s >= 0.8 else [2 * i, 2 * i + 1]
    assert sum(0.8 <= s < 0.86 for s in seen) > 10 and sum(0.7 < s < 0.8 for s in seen) > 10
    got = simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.doc_id for x in got) == kept


def test_groups_in_blocks_match_all_pairs(spark, monkeypatch):
    """Families whose members drift apart, so that hubs don't reach them; all pairs decide."""
    monkeypatch.setattr(simhash, "LONG_RUN", 3)
    r = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(6):
        t = [r.choice(words) for _ in range(120)]
        for _ in range(14):
            t = list(t)
            for _ in range(r.choice([1, 2, 2, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = {}
    for i in range(len(sets)):
        want.setdefault(find(i), set()).add(i)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    scratch = Scratch(spark, "near")
    marked = scratch.save(simhash.profiles(docs), "p").selectExpr("doc_id", "copy", "xxhash64(copy) AS node", "struct(false AS none, doc_id) AS first")
    groups_ = marked.selectExpr("node", "CAST(doc_id / 28 AS bigint) AS root")  # candidates: three lots of two families
    got = {x.node: x.root for x in simhash.verified(docs, marked, groups_, scratch, block=4).collect()}
    found = {}
    for x in marked.collect():
        found.setdefault(got.get(x.node, x.node), set()).add(x.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and len(want) > 6
    kept = {x.doc_id for x in simhash.drop_near_copies(docs).collect()}
    assert kept == {min(g) for g in want.values()}


def test_candidates_are_linked_fingerprints_of_samples(spark):
    """Fingerprints of four shingles each against plain ones; one bit apart links, two don't, and neither do texts far apart."""
    import numpy as np

    r = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for n in (1, 3, 2500):
        hashes = sorted(r.getrandbits(64) for _ in range(n))
        got = simhash.sketch(np.array(hashes, dtype=np.uint64))[1].view(np.uint64).tolist()
        orders = [int(x) for x in simhash._ODD]
        for i, fp in enumerate(got):
            sample = [min(hashes, key=lambda h: h * o % 2**64) for o in orders[4 * i : 4 * i + 4]]  # noqa: B023
            assert fp == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in sample) > 2)
        assert len(got) == 32
    rows = []
    for k in range(60):
        wide = [r.getrandbits(64) for _ in range(4)]
        fps = [r.getrandbits(64) for _ in range(32)]
        apart = (1, 1, 2, 2)[k % 4]
        other = [r.getrandbits(64) for _ in range(31)] + [fps[7] ^ sum(1 << b for b in r.sample(range(64), apart))]
        far = [~w & (2**64 - 1) if k % 2 else w ^ 7 for w in wide]
        rows += [(2 * k, [signed(w) for w in wide], [signed(f) for f in fps]), (2 * k + 1, [signed(w) for w in far], [signed(f) for f in other])]
    df = spark.createDataFrame(rows, "node bigint, wide array<bigint>, fps array<bigint>")
    got = {frozenset((x.a, x.b)) for x in simhash.sample_links(df).collect()}
    assert got == {frozenset((2 * k, 2 * k + 1)) for k in range(0, 60, 4)}


def test_small_tables_go_to_few_files(spark, monkeypatch):
    """Of 97 shuffle partitions; components of a path and pairs, and near copies, stay what they are."""
    import glob

    from quarry.llm.components import components

    written = {}
    save = Scratch.save

    def counted(self, df, name, *rest):
        out = save(self, df, name, *rest)
        written[name] = len(glob.glob(f"{self.path.removeprefix('file:')}/{name}/part-*"))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        edges = [(k, k + 1) for k in range(300)] + [(1000 + 2 * k, 1001 + 2 * k) for k in range(300)]
        scratch = Scratch(spark, "t")
        got = {x.node: x.root for x in components(scratch.save(spark.createDataFrame(edges, "a bigint, b bigint"), "edges"), scratch).collect()}
        assert got == {k: 0 for k in range(301)} | {k: k - k % 2 for k in range(1000, 1600)}
        docs = [(i, " ".join(f"w{i // 2 * 1000 + k}" for k in range(100 + i % 2))) for i in range(400)]
        kept = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
        assert sorted(x.doc_id for x in kept) == list(range(0, 400, 2))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    most = spark.sparkContext.defaultParallelism
    assert all(n <= most for name, n in written.items() if name not in ("profiles", "hubbed", "edges")) and len(written) > 10
