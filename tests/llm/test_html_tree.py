import random
import time

import numpy as np

from quarry.llm import html_tree as h

SCHEMA = "page_id bigint, url string, html string, text string"
ARTICLE = "<article><h1>Title &amp; more</h1><p>First   one.\n Still.<p>Second<br>line &lt;x&gt;.</p><ul><li>Item one is here.<li>Item two is here.</ul></article>"
PAGE = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a='</p>';</script></head><body><header><div>Site name</div></header>"
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='cookie-notice'>We use cookies.</div>" + ARTICLE + "<div class=ad>Buy this now.</div><section class=comments><p>Great text, I agree.</p><p>Me too, thanks a lot.</p></section>"
    "<aside><h3>Related</h3><ul><li><a href=/c>Other</a></ul></aside><form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 all</footer></body></html>"
)
MAIN = "Title & more\n\nFirst one. Still.\n\nSecond line <x>.\n\nItem one is here.\n\nItem two is here."


def test_main_text_and_defined_edge_cases(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, None), (2, None, None, None), (None, "v", "", None), (3, "w", "<p", None), (4, "x", "<article><p>" + "word " * 50000 + ".</p></article>", None)]
    got = h.op1(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == 6 and by[1].text == MAIN and by[1].n_chars == len(MAIN)
    assert by[2].text == by[None].text == "" and by[2].n_chars == 0
    assert by[4].n_chars == 50000 * 5 + 1
    assert h.op1(spark.createDataFrame([], SCHEMA)).collect() == []


def test_messages_give_the_exact_marginals():
    t = h.parse(PAGE[PAGE.index("<div class=ad") : PAGE.index("<aside")])
    vocabulary = {f: i for i, f in enumerate(sorted({f for fs in t.features for f in fs}))}
    r = np.random.default_rng(0)
    w, theta = r.normal(size=len(vocabulary)), r.normal(size=(2, 2, 2))
    forest = h.Forest([t], vocabulary)
    n, total = len(t.parent), 0
    want = np.zeros(n)
    unary = np.array([sum(w[vocabulary[f]] for f in fs) for fs in t.features])
    for states in range(1 << n):
        y = np.array([states >> i & 1 for i in range(n)])
        score = np.exp((unary * y).sum() + sum(theta[forest.leaf[i], y[p], y[i]] for i, p in enumerate(t.parent) if p >= 0))
        total += score
        want += score * y
    assert np.allclose(forest.marginals(w, theta)[0], want / total)


#: Written by hand, without the landmarks of ``PAGE``; (page, main text).
PLAIN = [
    (
        "<html><body><div><h1>The river</h1><p>The river is long, and it flows to the sea in the north.</p><p>People live there with their boats and they like it.</p></div>"
        "<h3>3 Comments</h3><p>Great text, I liked it a lot.</p><p>Thanks for this.</p><p>Me too, I agree with all of it.</p></body></html>",
        "The river\n\nThe river is long, and it flows to the sea in the north.\n\nPeople live there with their boats and they like it.",
    ),
    (
        "<html><body><table><tr><td><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></td></tr><tr><td><font size=5><b>Old style title</b></font><br><br>First part of the story, "
        "which is told at length here. It goes on and on, with many words.<br><br>Second part of the story, told as well.</td></tr><tr><td>Copyright 1999 by me</td></tr></table></body></html>",
        "Old style title First part of the story, which is told at length here. It goes on and on, with many words. Second part of the story, told as well.",
    ),
    (
        "<body><div class='x1'><a href=/>Logo</a></div><div class='c-12'><div class='q'><h1>Headline of it</h1><p>It was a bright cold day in April, and the clocks were striking thirteen.</p>"
        "<p>Winston Smith slipped quickly through the glass doors of Victory Mansions.</p></div></div><div class='z9'><h2>Related</h2><ul><li><a href=1>One story</a><li><a href=2>Another story</a></ul></div>"
        "<p>We use cookies to improve. Accept</p></body>",
        "Headline of it\n\nIt was a bright cold day in April, and the clocks were striking thirteen.\n\nWinston Smith slipped quickly through the glass doors of Victory Mansions.",
    ),
    ("<p>Just a paragraph of text, nothing else is on this page.</p><p>And another one, as long as that.</p>", "Just a paragraph of text, nothing else is on this page.\n\nAnd another one, as long as that."),
]


def test_pages_without_landmarks(spark):
    got = {x.page_id: x.text for x in h.op1(spark.createDataFrame([(i, None, p, None) for i, (p, _) in enumerate(PLAIN)], SCHEMA)).collect()}
    for i, (_, want) in enumerate(PLAIN):
        assert got[i] == want


def test_texts_follow_brute_force_marginals():
    """The whole way from a page to its text, with marginals by enumeration of all states."""
    model = h.trained()
    vocabulary, w, theta = model
    r, checked = random.Random(5), 0
    pieces = ["<p>Some words of a text, told at length.</p>", "<div><a href=x>Home</a></div>", "<h2>2 comments</h2>", "<div class=ad>Buy.</div>", "<article><p>Here it is, the whole story.</p></article>", "<h1>Title</h1>", "<li>one"]
    while checked < 12:
        page = "".join(r.choice(pieces) for _ in range(r.randrange(1, 5)))
        t = h.parse(page)
        n = len(t.parent)
        if n > 12:
            continue
        unary = np.array([sum(w[vocabulary[f]] for f in fs if f in vocabulary) for fs in t.features])
        mass = np.zeros(n)
        total = 0.0
        for states in range(1 << n):
            y = np.array([states >> i & 1 for i in range(n)])
            score = np.exp((unary * y).sum() + sum(theta[int(t.text[i] is not None), y[p], y[i]] for i, p in enumerate(t.parent) if p >= 0))
            total += score
            mass += score * y
        want = [x for x, p in zip(t.text, mass / total) if x is not None and p > 0.5]
        assert [x for x, p in h.main_texts([page], model)[0] if p > 0.5] == want
        checked += 1


def test_deep_unclosed_and_hidden_elements():
    texts = lambda page: [x for x in h.parse(page).text if x is not None]
    start = time.time()
    assert texts("<div>" * 20_000 + "<p>text here") == ["text here"]
    assert texts("<video>" * 20_000 + "<li><p>" * 3000 + "x") == ["x"]
    assert time.time() - start < 10
    assert texts("a <select><option>no</select> b <svg><text>no</text></svg> c") == ["a b c"]
    assert texts("a <object>no <object>no</object> no</object> b <canvas>c") == ["a b c"]
    assert list(h.batches_of([5, 1, 1, 9, 1], 4)) == [(0, 1), (1, 2), (3, 1), (4, 1)] and list(h.batches_of([], 4)) == []


def test_held_out_layouts():
    r, right, total = random.Random(1234), 0, 0
    vocabulary, w, theta = h.trained()
    for _ in range(150):
        t = h.parse(h.labelled_page(r))
        p, _ = h.Forest([t], vocabulary).marginals(w, theta)
        leaf = np.array([x is not None for x in t.text])
        right += ((p > 0.5) == h.labels(t))[leaf].sum()
        total += leaf.sum()
    assert right / total > 0.97
