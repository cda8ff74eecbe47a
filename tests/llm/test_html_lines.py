"""Extraction against a tree of the page, plain definitions of surge and dive, and pages whose main text is known."""

import html
import random
import re
from html.parser import HTMLParser

import pytest

from foliograph.llm import html_text as h

SMALL = "/root/testdata/sf0.001"
WORDS = "over the long road went many people who had seen nothing of it before and some of them never came back again".split()


class Tree(HTMLParser):
    """Lines of well-formed pages: (text, letters, letters in links, path of open elements), by recursion over a stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.lines, self.text, self.linked, self.ident = [], [], "", 0, 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.lines.append((text, self.linked, tuple(self.path)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in ("a", "b"):
            self.flush()
        self.ident += 1
        if tag != "br":
            self.path.append((tag, dict(attrs).get("class") or "", self.ident))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
        assert self.path.pop()[0] == tag

    def handle_data(self, data):
        self.text += data
        if any(t == "a" for t, *_ in self.path):
            self.linked += len(data.strip())


BESIDE = {"nav", "header", "footer", "aside", "form"}
BAD = {"ad", "comments", "cookie-notice", "sidebar-left"}


def plain_main_text(page):
    """The definition, with sets and all windows summed anew."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    bad = lambda path: any(t in BESIDE or c in BAD for t, c, _ in path)
    rows, before = [], False
    for text, linked, path in tree.lines:
        out = bad(path)
        if out != before:
            rows += [("", 0, ())] * h.WINDOW
        before = out
        marked = any(t in ("article", "main") for t, *_ in path)
        rows.append(("", 0, ()) if out else (text, h.MARKED * len(text) if marked else len(text) - linked, path))
    sums = [sum(n for _, n, _ in rows[i : i + h.WINDOW]) for i in range(len(rows))]

    def spans(threshold):
        found, i = [], 0
        while i < len(rows):
            if sums[i] > threshold:
                j = next((j for j in range(i + 1, len(rows)) if sums[j] == 0), len(rows))
                found.append((i, j))
                i = j
            else:
                i += 1
        return found

    found = spans(h.THRESHOLD) or spans(0)
    if not found:
        return ""
    mass = lambda s: sum(n for _, n, _ in rows[s[0] : s[1]])
    core = max(found, key=mass)
    elements = {}
    for _, n, path in rows[core[0] : core[1]]:
        for depth, e in enumerate(path):
            if e[0] in h.CONTAINERS:
                m, k, _ = elements.get(e, (0, 0, 0))
                elements[e] = (m + n, k + (n > 0), depth)
    several = min(2, sum(n > 0 for _, n, _ in rows[core[0] : core[1]]))
    chosen = max((e for e, (n, k, _) in elements.items() if 2 * n > mass(core) and k >= several), key=lambda e: elements[e][2], default=None)
    if chosen:
        path = next(p for _, _, p in rows if chosen in p)
        above = path[: path.index(chosen) + 1]
        chosen = next((e for e in above if e[0] == "article"), next((e for e in above if e[0] == "main"), chosen))
    kept = {i for s in found if mass(s) >= h.SHARE * mass(core) for i in range(*s)}
    return "\n".join(t for i, (t, _, p) in enumerate(rows) if t and (i in kept or chosen is None or chosen in p))


def sentence(rng, most=40):
    return html.escape(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most)))) + rng.choice([".", " &amp; so on.", "?", "<br>again."])


def random_page(rng, article, most=40):
    """A page and the lines that are its main text."""
    block = lambda tag, c="", inner=None: f"<{tag}{f' class={c!r}' if c else ''}>{inner or sentence(rng, 12)}</{tag}>"
    links = lambda: block("ul", "", "".join(f"<li><a href='/{i}'>{rng.choice(WORDS)}</a></li>" for i in range(rng.randint(2, 7))))
    noise = lambda: rng.choice([lambda: block("nav", "", links()), lambda: block("div", "ad"), lambda: block("aside", "", block("p")), lambda: block("form", "", block("p")), lambda: block("div", "cookie-notice", block("p")), lambda: block("div", "sidebar-left", block("p") + links())])()
    own = [sentence(rng, 8), *[sentence(rng, most) for _ in range(rng.randint(1, 12))]]
    text = lambda t: " ".join(html.unescape(t.replace("<br>", " ")).split())
    inner = f"<h1>{own[0]}</h1>" + "".join((noise() if rng.random() < 0.2 else "") + rng.choice([f"<p>{p}</p>", f"<ul><li>{p}</li></ul>", f"<div class='share-price'>{p}</div>"]) for p in own[1:])
    body = f"<{article}>{inner}</{article.split()[0]}>"
    head = "".join(noise() for _ in range(rng.randint(0, 3)))
    tail = "".join(noise() for _ in range(rng.randint(0, 3))) + block("div", "comments", "".join(block("p", "", sentence(rng, 60)) for _ in range(rng.randint(0, 5))) or "none")
    return f"<html><body><header>{block('h2')}</header>{head}<div>{body}</div>{tail}<footer>{block('p')}</footer></body></html>", [text(t) for t in own]


@pytest.mark.parametrize("article", ["article", "main", "div class='story'", "section"])
def test_pages_against_the_definition(article):
    rng = random.Random(5)
    for _ in range(250):
        page, _ = random_page(rng, article)
        assert h.main_text(page) == plain_main_text(page), page


@pytest.mark.parametrize("article,exact", [("article", 1.0), ("main", 1.0), ("div class='story'", 0.97), ("section", 0.97)])
def test_known_main_text(article, exact):
    """Pages with the whole main text and nothing else, and words lost or brought in over all pages."""
    rng, same, found, wanted, both = random.Random(6), 0, 0, 0, 0
    for _ in range(300):
        page, own = random_page(rng, article)
        got = h.main_text(page).split("\n")
        same += got == own
        found, wanted, both = found + sum(map(len, got)), wanted + sum(map(len, own)), both + sum(len(x) for x in got if x in own)
    assert same / 300 >= exact and both / found > 0.99 and both / wanted > 0.99, (same / 300, both / found, both / wanted)


def test_pages_of_the_table():
    """Every page there has its text between ``article`` tags, in h1 and p, with open ``b`` and ``br``."""
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{SMALL}/pages.parquet").column("html").to_pylist():
        inner = page.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert h.main_text(page) == "\n".join(b for b in blocks if b)


def test_articles_beside_the_text_are_not_the_text():
    long = "A paragraph of running text that is long enough to surge above the threshold of the windows."
    assert h.main_text(f"<body><aside><article><p>{long}</p></article></aside><div><p>{long} Yes.</p></div></body>") == f"{long} Yes."
    assert h.main_text("<form><article><p>One.</p></article></form>") == "One."
    assert h.main_text(f"<form id='aspnet'><div><p>{long}</p></div></form>") == long
    assert h.main_text("<article><p><a href='/x'>All of it is a link.</a></p></article>") == "All of it is a link."


def test_names_of_elements():
    for value in ("ad", "ad-box", "adBox", "cookie-notice", "site_header", "nav main-menu", "share-buttons", "ad-slot-3", "col-2 sidebar", "sidebar-widgets", "adsbygoogle", "navPrevious"):
        assert h._named(value, h.NAMES), value
    for value in ("share-price", "additive", "navy", "ad-copywriting", "social-security-reform", "header-less", "content", ""):
        assert not h._named(value, h.NAMES), value
