import random

import pytest

from quarry.llm import licenses

from .brute import phrase_places

SCHEMA = "doc_id bigint, text string, labels string"
TEXTS = [
    None, "", "   ", "CC BY", "cc-by cc by,CC\nBY", "ccc by", "cc bye", "All rights, reserved. all rights reserved", "GNU General Public License v3",
    "the Generäl public license general public license", "Released under the MIT Licence.", "Relesed undr the MIT License", "Licensed under CC BY-NC 4.0.",
    "x " * 5000 + "all rights reserved" + " y" * 5000, "Licensed under the Apache Lisence, Version 2.0", "plain words of no note at all", "\x00cc\x7fby\x1f",
]


def test_base_places_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "cc by", None)]
    got = {x.doc_id: x for x in licenses.op5(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(TEXTS):
        w, places = phrase_places(t, licenses.BASE)
        at = [k for _, k in places]
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None)), t
        assert x.base_labels == ",".join(sorted({k for k, _ in places}))
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))
        assert 0 <= x.score <= 1
    assert got[10].labels == "mit" and got[11].labels == "mit" and "cc-by-nc" in got[12].labels and got[14].labels == "apache"
    assert got[15].labels == "" and got[15].score == 0


@pytest.mark.parametrize("notice", list(licenses.NOTICES))
def test_every_notice_is_found_with_all_edits_it_may_have(notice):
    k = licenses.edits_allowed(notice)
    spoilt = list(notice)
    for i in range(k):
        spoilt[(i + 1) * len(notice) // (k + 1) - 1] = "q"
    label = licenses.NOTICES[notice]
    assert label in {x[0] for x in licenses.scan("some text " + "".join(spoilt) + " and more")[1]}
    assert label not in {x[0] for x in licenses.scan("some text and more")[1]}


def edits(a, b):
    """Least number of edits between two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spoil(r, notice, times):
    x = list(notice)
    for _ in range(times):
        i = r.randrange(len(x))
        x[i : i + 1] = r.choice([[], ["q"], [x[i], r.choice("ab ")]])
    return " ".join("".join(x).split())


def test_spans_match_edit_distances_by_brute_force():
    r = random.Random(11)
    names = list(licenses.NOTICES)
    found_any = 0
    for _ in range(60):
        parts = []
        for _ in range(4):
            notice = r.choice(names)
            parts += [" ".join(r.choice(["and", "a", "no", "license", "the", "public", "by", "x"]) for _ in range(r.randrange(5))), spoil(r, notice, r.randrange(licenses.edits_allowed(notice) + 2))]
        text = " ".join(" ".join(parts).split())
        base, spans = licenses.scan(text)
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
        ends = [s - 1 for s in starts[1:]] + [len(text)]
        for label, a, z, e, notice in spans:
            assert a in starts and z in ends and label == licenses.NOTICES[notice]
            assert e == edits(text[a:z], notice) <= licenses.edits_allowed(notice)
        places = [(0, at, at + len(p)) for p, label in licenses.BASE.items() for x, at in base if x == label]
        reported = [(e, a, z) for _, a, z, e, _ in spans] + places
        for notice in names:
            k = licenses.edits_allowed(notice)
            near = [(edits(text[a:z], notice), a, z) for a in starts for z in ends if abs(z - a - len(notice)) <= k]
            for e, a, z in near:
                if e <= k:  # it is a span, or a better one is in its place
                    found_any += 1
                    assert any(o[0] <= e and min(z, o[2]) > max(a, o[1]) for o in reported), (text, notice, text[a:z])
    assert found_any > 100


def test_spans_stay_inside_words_and_apart():
    labels = lambda t: [(x[0], x[1]) for x in licenses.scan(t)[1]]
    assert labels("cc by ncx foo") == [] and labels("cc by and more") == []
    assert labels("cc by nd") == [("cc-by-nd", 0)] and labels("c by nc") == [("cc-by-nc", 0)]
    both = "licensed under the apachx license licensed under the apache license"
    assert labels(both) == [("apache", 0), ("apache", 34)]
    assert labels("gnu leser general public license") == [("lgpl", 0)]
    many = licenses.scan("licensed under the apache x " * 20_000)[1]  # in proportion to the text
    assert len(many) == 10_000  # each match reaches into the next notice


def test_empty_table(spark):
    assert licenses.op5(spark.createDataFrame([], SCHEMA)).collect() == []
