"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements, with every run of text as a leaf.
Each node is content or not.  A node's features speak for either state, and a
potential between parent and child says how likely a state is handed down.
Sum-product messages, first upward, then downward, give the exact marginal of
every node; the text leaves that are more likely content than not are the page's
main text, in page order.

The weights maximise the likelihood of labelled pages (their gradient needs the
same messages).  The labelled pages come from ``labelled_page``: layouts with
menus, headers, footers, sidebars, notices, adverts, forms and comments around
and inside an article, labelled as they are written; in a third of them no
element, class or id tells what it is, only headings, shape and wording do.

Messages run over a whole batch of pages at once, one vectorised step for each
depth of the trees.  The scan is one narrow pass; a page is read whole, in time
proportional to its length, and a batch is bounded in bytes.

Of scripts, styles and other raw text everything up to the end tag is left out,
or up to the end of the page if there is none, as browsers do.  Other elements
without readable text (``UNSEEN``) are left out with all they nest; one that is
never closed is ignored alone.

Nulls: a null or empty page gives an empty text.  Null ids and urls stay null,
repeated rows are pages of their own, an empty table gives an empty result, and
other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose text no reader sees.
RAW = frozenset("script style noscript template iframe title textarea xmp noembed noframes".split())
UNSEEN = frozenset("svg math object canvas audio video select datalist".split())
BLOCK = frozenset(
    "html head body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend label button blockquote pre figure figcaption address hr details summary center menu dialog hgroup search".split()
)
VOID = frozenset("hr br img input meta link base col area embed source track wbr".split())
#: A start tag of the key ends an open element of the values, not beyond the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: How far up an element is sought that the start of its sibling ends.
NESTED = 64
KEYWORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "side": "sidebar side aside widget related recommended recommendations trending popular rail",
    "foot": "footer foot copyright legal colophon imprint",
    "head": "header masthead topbar top logo branding",
    "comment": "comment comments discussion disqus reply replies respond responses",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup overlay paywall privacy warning message",
    "share": "share social sharing follow buttons",
    "form": "form search login register contact feedback",
    "main": "article content main post entry story body text prose",
}
_GROUP = {w: g for g, ws in KEYWORDS.items() for w in ws.split()}
#: Words that short texts and headings around an article use.
SAYS = {
    "comment": "comment comments reply replies replied responses commented discussion kommentare kommentar comentarios commentaires réponses",
    "side": "related recommended trending popular latest ähnliche relacionados similaires",
    "notice": "cookie cookies consent newsletter subscribe subscription sign accept privacy unsubscribe",
    "foot": "© copyright rights reserved imprint impressum",
    "ad": "advertisement sponsored advert anzeige publicidad publicité",
    "share": "share tweet follow print",
}
_SAYS = {w: g for g, ws in SAYS.items() for w in ws.split()}
_WORD = re.compile(r"[^\W\d_]+|©")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _says(text: str) -> str:
    """What a short text is about, by the first word that tells."""
    return next((_SAYS[w] for w in _WORD.findall(text.lower()) if w in _SAYS), "")


def _portion(n: int, total: int) -> str:
    share = n / total if total else 0
    return "tiny" if share < 0.03 else "small" if share < 0.15 else "some" if share < 0.4 else "most" if share < 0.75 else "all"


def _unseen(page: str, name: str) -> dict[int, int]:
    """By the place of each start tag of ``name`` that has an end tag, where that one ends."""
    out, open_ = {}, []
    for m in re.finditer(f"<(/?){name}(?=[\\s/>])[^>]*>", page, re.IGNORECASE):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


class Tree:
    """Parallel lists, one item a node; parents stand before their children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.features: list[set[str]] = []
        self.text: list[str | None] = []
        self.marks: list[str] = []

    def add(self, parent: int, features: set[str], text: str | None, mark: str = "") -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.features.append(features)
        self.text.append(text)
        self.marks.append(mark)
        return len(self.parent) - 1


def _bucket(n: int) -> str:
    return "0" if n == 0 else "5" if n < 5 else "15" if n < 15 else "50" if n < 50 else "200" if n < 200 else "more"


def _links(links: int, words: int) -> str:
    share = links / words if words else 0
    return "0" if links == 0 else "low" if share < 0.3 else "mid" if share < 0.7 else "high"


def parse(page: str) -> Tree:
    """The tree of a page.  Never fails: what isn't a tag is text."""
    t = Tree()
    root = t.add(-1, {"root"}, None)
    stack: list[list] = [["", root, [0, 0, 0, 0], ""]]  # tag, node, [words, words in links, paragraphs, main headings], what its last heading says
    words: dict[int, int] = {}
    open_: dict[str, int] = {"": 1}  # how many of each tag are open
    unseen: dict[str, dict[int, int]] = {}
    pieces: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if not pieces:
            return
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            tag, node, counts, after = stack[-1]
            n = text.count(" ") + 1
            counts[0] += n
            counts[1] += min(n, linked)
            density, says = _links(min(n, linked), n), _says(text) if n <= 15 else ""
            ends = text[-1] in ".!?:;…"
            features = {"text", f"in:{tag}", f"words:{_bucket(n)}", f"links:{density}", f"in:{tag}:links:{density}", f"ends:{ends}", f"ends:{ends}:words:{_bucket(n)}"}
            if says:
                features.add(f"says:{says}")
                if tag in HEADINGS and len(stack) > 1:
                    stack[-2][3] = says
            elif tag in HEADINGS and len(stack) > 1:
                stack[-2][3] = ""
            if after:
                features.add(f"after:{after}")
            words[t.add(node, features, text)] = n
        linked = 0

    def close() -> None:
        flush()
        tag, node, (n, links, paragraphs, main), _ = stack.pop()
        open_[tag] -= 1
        density = _links(links, n)
        t.features[node] |= {f"size:{_bucket(n)}", f"density:{density}", f"{tag}:density:{density}", f"paragraphs:{min(paragraphs, 3)}", f"main:{min(main, 1)}:paragraphs:{min(paragraphs, 3)}"}
        words[node] = n
        if stack:
            up = stack[-1][2]
            up[0] += n
            up[1] += links
            up[2] += paragraphs + (tag == "p")
            up[3] += main + (tag == "h1")

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            pieces.append(chunk)
            if in_link:
                linked += len(chunk.split())
        if not m:
            break
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not ending:
            if not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in UNSEEN and not ending:
            if name not in unseen:
                unseen[name] = _unseen(page, name)
            at = unseen[name].get(m.start(), at)
            continue
        if name == "a":
            in_link = 0 if ending else 1
        elif name == "br":
            pieces.append(" ")
        if name not in BLOCK:
            continue
        if ending:
            if open_.get(name):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        flush()
        if open_.get("p") and (name != "p" or stack[-1][0] == "p"):
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends before any block
                if stack[k][0] == "p":
                    while len(stack) > k:
                        close()
                    break
                if stack[k][0] in ("td", "th", "li", "blockquote", "div", "section", "article", "body"):
                    break
        if name in ENDS and any(open_.get(x) for x in ENDS[name][0]):
            ended, stops = ENDS[name]
            for k in range(len(stack) - 1, max(0, len(stack) - NESTED), -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ended:
                    while len(stack) > k:
                        close()
                    break
        after = stack[-1][3]
        features, mark = {f"tag:{name}", f"under:{stack[-1][0]}:{name}"}, ""
        if after:
            features.add(f"after:{after}")
        for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            key, value = key.lower(), value.strip("\"'")
            if key in ("hidden", "aria-hidden") and value.lower() != "false" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                features.add("hidden")
            elif key in ("class", "id", "role"):
                features |= {f"word:{_GROUP[w]}" for w in (x.lower() for x in _PART.findall(value)) if w in _GROUP}
                mark = value if key == "id" and value.startswith("label-") else mark
        node = t.add(stack[-1][1], features, None, mark)
        if name not in VOID:
            stack.append([name, node, [0, 0, 0, 0], ""])
            open_[name] = open_.get(name, 0) + 1
    while stack:
        close()
    whole = words[root]
    for node, n in words.items():
        kind = "text" if t.text[node] is not None else "node"
        t.features[node].add(f"{kind}:portion:{_portion(n, whole)}")
    return t


class Forest:
    """Trees side by side, as arrays."""

    def __init__(self, trees: list[Tree], vocabulary: dict[str, int]) -> None:
        sizes = np.array([len(t.parent) for t in trees])
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if trees else np.zeros(0, int)
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + o) for t, o in zip(trees, offsets)]).astype(np.int64)
        depth = np.concatenate([t.depth for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.leaf = np.array([x is not None for t in trees for x in t.text], dtype=np.int64)
        pairs = [(i, vocabulary[f]) for i, fs in enumerate(f for t in trees for f in t.features) for f in fs if f in vocabulary]
        self.at, self.feature = np.array(pairs, dtype=np.int64).reshape(-1, 2).T

    def marginals(self, weights: np.ndarray, potentials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and the pair marginals of every node with its parent (rows: parent's state)."""
        n = len(self.parent)
        own = np.stack([np.zeros(n), np.bincount(self.at, weights=weights[self.feature], minlength=n)], axis=1)
        theta = potentials[self.leaf]  # n, parent's state, own state
        below, up = own.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(theta[level] + below[level][:, None, :], axis=2)
            np.add.at(below, self.parent[level], up[level])
        belief, pair = below.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            cavity = belief[self.parent[level]] - up[level]
            joint = cavity[:, :, None] + theta[level]
            belief[level] = below[level] + np.logaddexp.reduce(joint, axis=1)
            pair[level] = joint + below[level][:, None, :]
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        pair = np.exp(pair - np.logaddexp.reduce(pair.reshape(n, 4), axis=1)[:, None, None])
        return content, pair


def _words(r: random.Random, n: int) -> str:
    syllables = ["the", "an", "er", "on", "ti", "es", "re", "lo", "ma", "su", "vi", "que"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))


def labelled_page(r: random.Random) -> str:
    """A page whose elements carry ``label-1`` (content) or ``label-0`` as id wherever the label changes."""
    sentence = lambda a=5, b=20: _words(r, r.randrange(a, b)).capitalize() + r.choice("....!?")
    plain = lambda k=1, m=5: " ".join(sentence() for _ in range(r.randrange(k, m)))
    odd = lambda: r.choice([_words(r, 1), sentence(1, 4), f"{_words(r, 1)} " * r.randrange(10, 120), _words(r, 30), sentence(1, 3).upper()])
    text = lambda: plain() if r.random() < 0.75 else odd()
    link = lambda n=3: f'<a href="/x">{_words(r, r.randrange(1, n + 1))}</a>'
    menu = lambda tag="ul": f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(r.randrange(3, 9))) + f"</{tag}>"
    close_p = lambda: r.choice(["</p>", "</p>", ""])
    para = lambda: f"<p>{r.choice(['', '<b>', '<i>'])}{text()}{r.choice(['', '<br>', ' ' + link()])} {r.choice(['', sentence()])}{close_p()}"

    def box(tag: str, words: str, inside: str) -> str:
        style = r.random()
        named = f'class="{r.choice(words.split())}"' if style < 0.8 else f'role="{words.split()[0]}"'
        return f'<{tag} id="label-0" {named}>{inside}</{tag}>'

    def noise() -> str:
        kind = r.randrange(12)
        prose = r.choice([sentence(), text(), f"<p>{text()}</p>", f"<p>{sentence()}</p>"])
        if kind == 0:
            return f'<nav id="label-0">{menu()}</nav>'
        if kind == 1:
            return box("div", KEYWORDS["nav"], r.choice([menu(), " ".join(link() for _ in range(6))]))
        if kind == 2:
            return box("div", KEYWORDS["ad"], prose)
        if kind == 3:
            return box(r.choice(["div", "section", "ul"]), KEYWORDS["comment"], "".join(f"<{x}>{text()}</{x}>" for x in ["li" if r.random() < 0.3 else "p"] * r.choice([1, 2, 4, 8, 30])))
        if kind == 4:
            return box(r.choice(["div", "section", "p"]), KEYWORDS["notice"], sentence() if r.random() < 0.5 else prose if r.random() < 0.5 else text())
        if kind == 5:
            return f'<aside id="label-0">{r.choice([menu(), prose, f"<h3>{_words(r, 2)}</h3>{menu()}"])}</aside>'
        if kind == 6:
            return box("div", KEYWORDS["side"], r.choice([menu(), prose, f"<h3>{_words(r, 2)}</h3>{menu()}"]))
        if kind == 7:
            return f'<form id="label-0"><label>{_words(r, 2)}</label><input name="q"><button>{_words(r, 1)}</button>{r.choice(["", f"<p>{sentence()}</p>"])}</form>'
        if kind == 8:
            return box("div", KEYWORDS["share"], " ".join(link(1) for _ in range(4)))
        if kind == 9:
            return box("div", KEYWORDS["form"], f"<form><p>{sentence()}</p><input><button>{_words(r, 1)}</button></form>")
        if kind == 10:
            return f'<dialog id="label-0">{prose}</dialog>'
        return f'<div id="label-0" style="display:none">{prose}</div>'

    def content() -> str:
        parts = [r.choice([f"<h1>{_words(r, 6)}</h1>", f"<h1>{sentence()}</h1>", f"<header><h1>{_words(r, 5)}</h1></header>", ""])]
        for _ in range(r.choice([1, 1, 2, 4, 8, 14, 50])):
            kind = r.random()
            if kind < 0.70:
                parts.append(para())
            elif kind < 0.78:
                parts.append(f"<h2>{_words(r, 4)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randrange(2, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{text()}</p></blockquote>")
            elif kind < 0.91:
                parts.append("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 2)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                parts.append(f"<pre>{_words(r, 8)}</pre>")
            elif kind < 0.95:
                parts.append(f"<figure><figcaption>{sentence()}</figcaption></figure>")
            else:
                parts.append(noise())
        return "".join(parts)

    def bare() -> str:
        """A page without telling elements, classes or ids: divisions, headings and paragraphs."""
        heading = lambda group: f'<{(x := r.choice(["h2", "h3", "h4", "div", "p"]))} id="label-0">{r.choice(["", f"{r.randrange(1, 99)} ", f"{_words(r, 1)} "])}{r.choice(SAYS[group].split()).capitalize()}</{x}>'
        rows = lambda one, tag: "".join(f'<{tag} id="label-0">{one()}</{tag}>' for _ in range(r.choice([1, 2, 3, 8, 20])))
        zero = lambda inside: f'<{(x := r.choice(["div", "div", "p", "section", "span"]))} id="label-0">{inside}</{x}>' if r.random() < 0.8 else f'<div><div id="label-0">{inside}</div></div>'

        def around() -> str:
            kind = r.randrange(6)
            if kind == 0:
                return zero(r.choice([" | ", " ", " &middot; "]).join(link() for _ in range(r.randrange(2, 9))))
            if kind == 1:
                return f'<div id="label-0">{menu()}</div>' if r.random() < 0.7 else f'<ul id="label-0">{menu()[4:-5]}</ul>'
            if kind == 2:
                return zero(f"{sentence(2, 6)} {r.choice(SAYS['notice'].split())} {sentence(2, 5)}")
            if kind == 3:
                return zero(f"{r.choice(SAYS['share'].split())} {link(1)} {link(1)}")
            if kind == 4:
                return zero(f"{r.choice(SAYS['ad'].split())} {_words(r, r.randrange(1, 8))}")
            return zero(_words(r, r.randrange(1, 4)))

        def behind() -> str:
            kind = r.randrange(3)
            if kind == 0:
                tag = r.choice(["p", "div", "li"])
                inside = heading("comment") + rows(lambda: r.choice([text, sentence])() if r.random() < 0.7 else f"<b>{_words(r, 1)}</b> {sentence()}", tag)
                return inside if r.random() < 0.5 else f'<div id="label-0">{inside}</div>'
            if kind == 1:
                return heading("side") + f'<ul id="label-0">{menu()[4:-5]}</ul>'
            return around()

        marked = lambda inner: "".join(f'<{x} id="label-1">{y}</{x}>' for x, y in inner)
        parts = [("h1", r.choice([_words(r, 5), sentence()]))] if r.random() < 0.7 else []
        for _ in range(r.choice([1, 2, 3, 5, 9, 20])):
            parts.append(("h2", _words(r, 4)) if r.random() < 0.12 else ("ul", "".join(f"<li>{sentence()}</li>" for _ in range(3))) if r.random() < 0.08 else ("blockquote", text()) if r.random() < 0.05 else (r.choice(["p"] * 9 + ["div"]), plain() if r.random() < 0.9 else text()))
        inner = marked(parts)
        if r.random() < 0.65:
            inner = f'<{(x := r.choice(["div", "div", "section", "td"]))} id="label-1">{inner}</{x}>'
        front, back = "".join(around() for _ in range(r.randrange(0, 4))), "".join(behind() for _ in range(r.randrange(0, 4)))
        foot = zero(f"{r.choice(['&copy;', 'Copyright', 'All rights reserved'])} {r.choice(['', '2020 '])}{_words(r, r.randrange(1, 6))}") if r.random() < 0.7 else ""
        body = f"{front}{inner}{back}{foot}"
        if r.random() < 0.2:  # laid out by a table
            if r.random() < 0.5:
                broken = "<br><br>".join([f"<b>{_words(r, 4)}</b>", *(plain() for _ in range(r.randrange(1, 6)))])
                inner = f'<span>{broken}</span>'
            cells = [x.replace("<p ", "<div ") for x in (front, back, foot) if x]
            rows_ = [f"<td>{x}</td>" for x in cells[:1]] + [f'<td id="label-1">{inner}</td>'] + [f"<td>{x}</td>" for x in cells[1:]]
            glue = r.choice(["</tr><tr>", ""])
            body = f"<table><tr>{glue.join(rows_)}</tr></table>"
            if r.random() < 0.5:  # cells of their own, without a division inside
                around_ = [f'<td id="label-0">{" ".join(link() for _ in range(r.randrange(2, 6)))}</td>', f'<td id="label-0">{r.choice(["&copy;", "Copyright"])} {_words(r, 4)}</td>']
                body = f'<table><tr>{glue.join([around_[0], rows_[min(1, len(cells))] if cells else rows_[0], around_[1]])}</tr></table>'
        return f"<html><head><title>{_words(r, 3)}</title></head><body>{body if r.random() < 0.6 else f'<div>{body}</div>'}</body></html>"

    if r.random() < 1 / 3:
        return bare()
    head = ""
    if r.random() < 0.6:
        inside = r.choice([f"<div>{_words(r, 2)}</div>", f"<h2>{_words(r, 3)}</h2>", f"<p>{sentence()}</p>", menu(), f"<h1>{_words(r, 2)}</h1>", f"<h1>{link()}</h1><p>{_words(r, 4)}</p>"])
        head = f'<header id="label-0">{inside}</header>' if r.random() < 0.6 else box("div", KEYWORDS["head"], inside)
    foot = ""
    if r.random() < 0.8:
        inside = r.choice([sentence(), menu(), f"<p>{sentence()}</p>", f"&copy; {_words(r, 4)}", f"<p>{text()}</p>{menu()}"])
        foot = f'<footer id="label-0">{inside}</footer>' if r.random() < 0.7 else box("div", KEYWORDS["foot"], inside)
    shape = r.random()
    inner = content()
    if shape < 0.45:
        inner = f'<article id="label-1">{inner}</article>'
    elif shape < 0.6:
        inner = f'<main id="label-1">{inner}</main>'
    elif shape < 0.85:
        inner = f'<div id="label-1" class="{r.choice(KEYWORDS["main"].split())}">{inner}</div>'
    else:
        inner = f'<{(x := r.choice(["div", "section", "td"]))} id="label-1"><h1>{_words(r, 4)}</h1>{inner}{para()}{para()}</{x}>'
    if r.random() < 0.3:
        inner = f"<{(x := r.choice(['main', 'div', 'section']))}>{inner}{noise() if r.random() < 0.4 else ''}</{x}>"
    before = "".join(noise() for _ in range(r.randrange(0, 4)))
    after = "".join(noise() for _ in range(r.randrange(0, 4)))
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body>{head}{before}{inner}{after}{foot}</body></html>"


def labels(t: Tree) -> np.ndarray:
    """States of a labelled page's nodes: that of the closest marked ancestor, else not content."""
    out: list[int] = []
    for parent, mark in zip(t.parent, t.marks):
        out.append(int(mark[-1]) if mark else out[parent] if parent >= 0 else 0)
    return np.array(out)


#: Of the first steps; later ones are shorter.
RATE = 0.2


def trained(pages: int = 600, steps: int = 160, seed: int = 7) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """vocabulary, weights, potentials: gradient ascent on the likelihood of the labelled pages."""
    r = random.Random(seed)
    trees = [parse(labelled_page(r)) for _ in range(pages)]
    names = sorted({f for t in trees for fs in t.features for f in fs})
    vocabulary = {f: i for i, f in enumerate(names)}
    forest = Forest(trees, vocabulary)
    y = np.concatenate([labels(t) for t in trees])
    has_parent = forest.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.leaf[has_parent], y[forest.parent[has_parent]], y[has_parent]), 1)
    w, theta = np.zeros(len(names)), np.zeros((2, 2, 2))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, theta)]
    for step in range(1, steps + 1):
        p, pair = forest.marginals(w, theta)
        grad_w = np.bincount(forest.feature, weights=(y - p)[forest.at], minlength=len(w)) - 0.05 * w
        expected = np.stack([pair[has_parent & (forest.leaf == k)].sum(axis=0) for k in (0, 1)])
        for x, g, (m, v) in zip((w, theta), (grad_w, seen - expected - 0.05 * theta), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return vocabulary, w, theta


def main_texts(pages: list[str | None], model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> list[list[tuple[str, float]]]:
    """Of each page its text blocks and the probability that they are content."""
    vocabulary, w, theta = model
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    p, _ = Forest(trees, vocabulary).marginals(w, theta)
    out, at = [], 0
    for t in trees:
        out.append([(x, float(p[at + i])) for i, x in enumerate(t.text) if x is not None])
        at += len(t.parent)
    return out


def batches_of(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """(begin, length) of runs whose sizes add up to ``limit`` at most, or of one item."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i - begin
            begin, total = i, 0
        total += n
    if sizes:
        yield begin, len(sizes) - begin


def extract(pages: DataFrame, threshold: float = 0.5, at_once: int = 2_000_000, model: tuple | None = None) -> DataFrame:
    """page_id, url, text and the number of blocks kept and left; ``model`` from ``trained`` may be reused."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [(n or 0) + 1000 for n in pc.binary_length(whole.column("html")).to_pylist()]
            for begin, length in batches_of(sizes, at_once):
                b = whole.slice(begin, length)
                found = main_texts(b.column("html").to_pylist(), model)
                kept = [[x for x, p in blocks if p > threshold] for blocks in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(["\n\n".join(x) for x in kept], pa.string()), pa.array([len(x) for x in kept], pa.int32()), pa.array([len(x) - len(y) for x, y in zip(found, kept)], pa.int32())],
                    ["page_id", "url", "text", "n_kept", "n_left"],
                )

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_kept int, n_left int")


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
