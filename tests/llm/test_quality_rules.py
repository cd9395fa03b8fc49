import unicodedata

import numpy as np

from quarry.llm import quality_rules as q

from .brute import WORD, quality_counts

SCHEMA = "doc_id bigint, text string, w string, kept boolean, _row int"
GOOD = "The river of the town is long and it is in the north, and the people of it are there with the boats."
TEXTS = [
    None, "", " \n\t", GOOD, GOOD * 4, "a b c a b c a b c", "one\ntwo\none\n one\n\n \n\none", "x# y* $z %|<>& !!", "é ü\x1cß　z", "w " * 3000,
    "\n".join(["Menu | Home | About | News"] * 30), " ".join(f"word{i}%%%" for i in range(200)), " ".join(f"LOUD{i}!!" for i in range(200)),
]


def fixture(spark):
    from random import Random

    r = Random(3)
    words = "the of and to in is it that for on with as was by this river town people boat north house stone light garden winter".split()
    good = [" ".join(r.choice(words) + ("," if r.random() < 0.05 else "") for _ in range(r.randrange(60, 200))) for _ in range(120)]
    return [(i, t, "clash", False, 1) for i, t in enumerate(TEXTS)] + [(100 + i, t, None, None, None) for i, t in enumerate(good)] + [(3, TEXTS[3], None, None, None), (None, good[0], None, None, None)]


def test_counts_match_brute_force(spark):
    rows = fixture(spark)
    got = q.op10(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((str(i), *quality_counts(t)) for i, t, *_ in rows)
    assert sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got) == want
    for x in got:
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept)


def test_verdicts_and_filter_agree(spark):
    df = spark.createDataFrame(fixture(spark), SCHEMA)
    got = q.op10(df).collect()
    kept = {x.doc_id for x in got if x.kept}
    assert not kept & {10, 11, 12} and all(i in kept for i in range(100, 220) if i in {x.doc_id for x in got if not x.base_failed})
    stays = q.keep_good(df)
    assert stays.columns == df.columns and sorted(str(x.doc_id) for x in stays.collect()) == sorted(str(x.doc_id) for x in got if x.kept)


def plain_shares(t):
    """The shares the rules look at, letter by letter."""
    t = t or ""
    n_words, word_chars, symbols, dup, repeat = quality_counts(t)
    solid = [c for c in t if c not in " \t\n\x0b\x0c\r"]
    letters, capitals = (sum(unicodedata.category(c).startswith(k) for c in solid) for k in ("L", "Lu"))
    lines = sum(1 for x in t.split("\n") if WORD.search(x))
    share = lambda a, b: a / b if b else 0.0
    return n_words, repeat, {
        "symbol_share": share(symbols, n_words), "repeat_share": share(repeat, n_words), "dup_line_share": share(dup, lines), "letter_share": share(letters, word_chars),
        "capital_share": share(capitals, letters), "bang_share": share(t.count("!"), n_words), "bar_share": share(t.count("|"), n_words),
        "stop_share": share(sum(w.lower() in q.STOP_WORDS for w in WORD.findall(t)), n_words), "mean_word": share(word_chars, n_words),
    }


def test_posteriors_match_plain_em_text_by_text(spark):
    rows = fixture(spark)
    facts = [plain_shares(t) for _, t, *_ in rows]
    votes = np.zeros((len(rows), len(q.RULES)), dtype=int)
    for i, (n, _, x) in enumerate(facts):
        for r, (share, way, good, bad) in enumerate(q.RULES.values()):
            v, sign = x[share], 1 if way == "<" else -1
            votes[i, r] = 0 if not n else -1 if sign * (v - bad) >= 0 else 1 if good is not None and sign * (v - good) <= 0 else 0
    belief = np.array([[[(q.ACCUSERS if rule[2] is None else q.JUDGES)[k][v] for v in (-1, 0, 1)] for rule in q.RULES.values()] for k in (0, 1)])
    says, good = belief.copy(), 0.8
    for _ in range(500):
        p = np.array([says[k][np.arange(len(q.RULES)), votes + 1].prod(axis=1) for k in (0, 1)])
        post = good * p[1] / (good * p[1] + (1 - good) * p[0])
        weight = np.array([1 - post, post])
        prior = q.PRIOR_TEXTS * np.array([0.2, 0.8])
        seen = np.array([[[weight[k][votes[:, r] == v].sum() for v in (-1, 0, 1)] for r in range(len(q.RULES))] for k in (0, 1)]) + prior[:, None, None] * belief
        says = seen / seen.sum(axis=2, keepdims=True)
        good = (weight[1].sum() + prior[1]) / (len(rows) + prior.sum())
    want = sorted((str(i), round(float(x), 4), bool(n >= 50 and 100 * rep <= 50 * n and x >= 0.5)) for (i, *_), x, (n, rep, _) in zip(rows, post, facts))
    got = sorted((str(x.doc_id), round(x.p_good, 4), x.kept) for x in q.op10(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
    assert all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, want))


def test_em_finds_the_share_of_simulated_texts():
    from random import Random

    r, patterns = Random(7), {}
    for _ in range(20000):  # rules are wrong about a tenth of the good texts and right about most bad ones
        good = r.random() < 0.3
        votes = tuple((-1 if r.random() < (0.1 if good else 0.6) else 0) if rule[2] is None else (1 if r.random() < (0.9 if good else 0.4) else -1) for rule in q.RULES.values())
        patterns[votes] = patterns.get(votes, 0) + 1
    share, says = q.fit(sorted(patterns.items()))
    assert abs(share - 0.3) < 0.03
    assert all(abs(says[1][i][-1] - 0.1) < 0.03 and abs(says[0][i][-1] - 0.6) < 0.03 for i, rule in enumerate(q.RULES.values()))


def test_em_finds_who_is_right():
    from random import Random

    r = Random(1)
    names = list(q.RULES)
    patterns = {}
    for _ in range(5000):
        good = r.random() < 0.7
        votes = []
        for n in names:
            accuses = q.RULES[n][2] is None
            if n == "letters":  # this one guesses
                votes.append(r.choice([1, -1]))
            elif good:
                votes.append(0 if accuses else 1)
            else:
                votes.append(-1 if r.random() < 0.5 else 0)
        patterns[tuple(votes)] = patterns.get(tuple(votes), 0) + 1
    share, says = q.fit(sorted(patterns.items()))
    k = names.index("letters")
    sure = names.index("symbols")
    assert abs(share - 0.7) < 0.1
    assert says[0][sure][-1] / says[1][sure][-1] > 10 * says[0][k][-1] / says[1][k][-1]


def test_empty_table(spark):
    assert q.op10(spark.createDataFrame([], SCHEMA)).collect() == []
