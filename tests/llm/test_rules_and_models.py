"""Mixing, quality, packing, extraction, licences, toxicity, URLs and the pipeline against plain Python."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from foliograph.llm import html_text, licenses, mixing, packing, quality, queries, substrings, toxicity, urls
from foliograph.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=240, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9)))
        if i % 11 == 0:
            text += ("\n" + text) * 2
        rows.append((i, text, "en", "hot" if i % 3 == 0 else rng.choice(["é", "z", "a", None])))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string").repartition(5).cache()


def plain_targets(size, share=1.5):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(size, 0.0), share * sum(size.values())
    free = set(size)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(2 * size[s] for s in over)
        free -= over
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    return target


def test_mixing(docs):
    rows = mixing.plan(docs).collect()
    size, taken = defaultdict(int), defaultdict(int)
    of = {r[0]: r[3] for r in corpus()}
    for r in rows:
        size[of[r.doc_id]] += r["size"]
        taken[of[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    wanted = plain_targets(size)
    for r in rows:
        assert abs(r.target - wanted[of[r.doc_id]]) < 1e-6 and r.source_size == size[of[r.doc_id]]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in size)
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and placed[0] >= 0 and placed[-1] <= sum(wanted.values())
    words = sum(len(WORD.findall(r.text)) for r in mixing.mix(docs).collect())
    assert words == sum(taken.values())


def test_mix_is_sorted_by_position(docs):
    """All of it, over the partitions: each document comes first where the plan says."""
    at = {r.doc_id: r.position for r in mixing.plan(docs).collect()}
    seen = list(dict.fromkeys(r.doc_id for r in mixing.mix(docs).collect()))
    assert len(seen) > 100 and [at[i] for i in seen] == sorted(at[i] for i in seen)
    assert set(seen) == {i for i, p in at.items() if p is not None}


def test_mixing_schedule_favours_early_sources(docs):
    """A source that tilts to the start has more of its words in the first half than one that tilts to the end."""
    of = {r[0]: r[3] for r in corpus()}
    rows = [r for r in mixing.plan(docs).collect() if r.position is not None]
    half = sum({of[r.doc_id]: r.target for r in rows}.values()) / 2
    names = sorted({of[r.doc_id] for r in rows}, key=lambda s: (s is None, s or ""))
    share = lambda s: sum(r.position < half for r in rows if of[r.doc_id] == s) / max(1, sum(of[r.doc_id] == s for r in rows))
    assert share(names[0]) > share(names[2])


def plain_quality(text):
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs):
    by = {r[0]: (r[1], r[3]) for r in corpus()}
    rows = quality.judge(docs).collect()
    failed = defaultdict(list)
    for r in rows:
        n, chars, symbols, dup, rep = plain_quality(by[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        failed[by[r.doc_id][1]].append(r)
    assert any(r.n_repeat_words for r in rows) and all(r.kept == (not r.base_failed and not r.host_failed) for r in rows)


def test_quality_rejects_a_bad_host(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "good") for i in range(60)]
    bad = [(100 + i, "too short", "bad") for i in range(58)] + [(200 + i, good[i][1], "bad") for i in range(2)]
    rows = quality.judge(spark.createDataFrame(good + bad, "doc_id bigint, text string, source string")).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(60)) and all(r.host_failed == (r.doc_id >= 100) for r in rows)


def test_packing_round_trip(docs):
    plain = Tokenizer.from_file(tokenizer_file())
    texts = {r[0]: r[1] for r in corpus()}
    pieces = packing.pack(docs, tokenizer_file()).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
        assert p.length == len(p.ids) and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) == p.ids_crc32
    for i, t in texts.items():
        own = sorted(by[i], key=lambda p: p.start)
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        assert [x for p in own for x in p.ids] == ids and own[0].doc_tokens == len(ids)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    for held in bins.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == [sum(q.length for q in held[:k]) for k in range(len(held))]
        assert sum(p.length for p in held) <= 1024


def test_packing_pads_little():
    packer, rng, out = packing.Packer(0), random.Random(0), []
    total = 0
    for i in range(3000):
        n = rng.randint(1, 3000)
        total += n
        for k, length in enumerate(packing.cuts(n)):
            out += packer.add((length, i, k))
    out += packer.finish()
    assert sum(p[0] for p in out) == total
    used = len({p[3] for p in out}) * 1024
    assert used / total < 1.005


@pytest.mark.parametrize("text", ["", "plain words, and more.", "été Ünïcode 12", "tab\tand\r\nreturn", "a b   c", "<|endoftext|> inside", "日本語 テキスト", "x" * 5000, "\x1c\x85 odd", "it's we'll   ", "‮ rtl"])
def test_ids_are_those_of_tokenizers(text):
    whole = Tokenizer.from_file(tokenizer_file())
    assert packing.encoder(tokenizer_file()).encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_the_table():
    """Whichever library a text goes to, on every document."""
    import pyarrow.parquet as pq

    whole, own = Tokenizer.from_file(tokenizer_file()), packing.encoder(tokenizer_file())
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        assert own.encode(text or "").tolist() == whole.encode(text or "", add_special_tokens=False).ids


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice"><p>We use cookies a lot, really.</p></div>
%s<aside><p>Sidebar text that is rather long to mislead the extraction</p></aside><form><p>Your name</p></form>
<section class="comments"><article><p>A reader wrote this long comment about the article.</p></article></section><footer>&copy; 2020</footer></body></html>"""


def test_html_article():
    body = '<article class="post"><h1>Head &amp;\n line</h1><p>First <b>para<br>graph</b><p>Sec&eacute;ond &lt;x&gt;<div class="ad">buy</div><ul><li>i<li>j</ul><p>.</article>'
    assert html_text.main_text(PAGE % body) == "Head & line\nFirst para graph\nSecéond <x>\ni\nj\n."


def test_html_without_article():
    long = "A paragraph of running text that is long enough to surge above the threshold of the windows."
    body = f'<div class="content"><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p></div><div class="links"><a href="/a">one</a></div>'
    assert html_text.main_text(PAGE % body) == f"Title\n{long}\nShort.\n{long}"


def test_html_on_broken_markup():
    assert html_text.main_text(None) == "" and html_text.main_text("<p") == "<p" and html_text.main_text("<!-- open") == ""
    assert html_text.main_text("<main><p>a < b & c<p attr='x>y'>d</main>") == "a < b & c\nd"
    assert html_text.main_text("<script>never ends") == ""


def test_html_head_without_an_end():
    assert html_text.main_text("<html><head><title>T</title><style>p{}</style><script>x</script><meta name=a><p>One.<p>Two.") == "One.\nTwo."
    assert html_text.main_text("<head><title>T</title><article><p>One.</article>") == "One."


def test_html_short_parts_beside_a_long_one():
    long = "A paragraph of running text that is long enough to surge above the threshold of the windows."
    advert = '<div class="ad">buy</div>'
    middle = f"<p>{long}</p>" * 40
    body = f'<div><p>Short.</p>{advert}{middle}{advert}<p>The end.</p></div><div id="x"><p>Aside of it.</p></div>'
    assert html_text.main_text(PAGE % body) == "\n".join(["Short.", *[long] * 40, "The end."])


def test_stretches():
    assert html_text.stretches([0, 0, 9, 9, 0, 0, 0, 5, 0], 3, 4) == [(0, 4), (5, 8)]
    assert html_text.stretches([1, 1, 1], 3, 5) == []


def plain_places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def test_license_bases_against_word_lists():
    rng = random.Random(1)
    bits = "under the mit license apache version 2 cc by nc CC-BY-NC x".split()
    for _ in range(400):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        n, n_base, first, last, base, labels, score, _ = licenses.scan_text(text.encode())
        at = sorted(i for p in licenses.BASE for i in plain_places(words, p))
        wanted = {label for p, label in licenses.BASE.items() if plain_places(words, p)}
        assert (n, n_base, first, last) == (len(words), len(at), at[0] if at else None, at[-1] if at else None)
        assert base == ",".join(sorted(wanted)) and wanted <= set(filter(None, labels.split(","))) and 0 <= score <= 1


@pytest.mark.parametrize("text,label", [
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("Licensed under the Apache License, Version 2.0", "apache-2"), ("licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa"), ("the BSD 3-Clause license applies", "bsd-3"), ("All rights reserved.", "all-rights-reserved"),
    ("GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("released under the MIT licence", "mit"), ("nothing here, mit Liebe", ""),
])
def test_license_labels(text, label):
    assert licenses.scan_text(text.encode())[5] == label


def test_license_containment():
    found = licenses.detect(licenses.normalized(b"Licensed under the MIT License"))
    assert [f[2] for f in found] == ["mit"] and found[0][:2] == (0, 5)
    assert sum(map(len, licenses.rules().values())) > 300


@pytest.mark.parametrize("text,label", [
    ("European Union Public Licence", "eupl-1.2"), ("Apache v2", "apache-2"), ("Creative Commons Attribution 4.0 International", "cc-by"), ("Artistic 2.0", "artistic-2"), ("Academic Free v3.0", "afl-3"),
])
def test_license_names_without_the_word_license(text, label):
    assert licenses.scan_text(text.encode())[5] == label
    assert label in licenses.scan_text(f"{'x ' * 80}{text} {'y ' * 80}".encode())[5].split(",")


def test_license_gates_lose_nothing():
    rng = random.Random(4)
    every = [s for group in licenses.rules().values() for s in group]
    lines = [line.split(" | ", 2)[2].replace("{L}", rng.choice(["license", "licence"])).replace("{v}?", rng.choice(["", "v", "version "])) for line in licenses.SIGNATURES.strip().split("\n")]
    bits = [w for name in lines for w in [re.sub(r"\{[^}]*\}|\(\?[:=]([^()|]*)[^()]*\)\??|[^a-z0-9 ]", r"\1", name)] if w]
    joints = ["the", "license", "licence", "licensed under", "released under the terms of the", "4 0", "v2", "2", "international", "x " * 40, "spdx license identifier"]
    for _ in range(400):
        words = licenses.normalized(" ".join(rng.choice(bits if rng.random() < 0.5 else joints) for _ in range(rng.randint(1, 12))).encode())
        line = words.decode()
        found = {(line.count(" ", 0, m.start()), line.count(" ", 0, m.end()) + 1, s.label, s.priority) for s in every for m in s.pattern.finditer(line)}
        settled = []
        for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in settled):
                settled.append(d)
        assert licenses.detect(words) == sorted(settled), line


def test_license_signatures_are_distinct():
    lines = licenses.SIGNATURES.strip().split("\n")
    assert len(lines) == len(set(lines)) == len({x.split(" | ", 2)[2] for x in lines}) == 309
    assert {s.pattern.pattern for group in licenses.rules().values() for s in group} and max(len(x.split()) for x in lines) < licenses.REACH


def test_license_containment_against_all_pairs():
    rng = random.Random(11)
    for _ in range(200):
        found = set()
        for _ in range(rng.randint(0, 40)):
            a = rng.randint(0, 30)
            found.add((a, a + rng.randint(1, 8), rng.choice("abc"), rng.choice([60, 75, 90, 92])))
        plain = []
        for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in plain):
                plain.append(d)
        assert licenses.settled(found) == sorted(plain)


def test_licenses_of_the_table():
    """All rules over whole texts, without gates or windows, on every document."""
    import pyarrow.parquet as pq

    every = {(s.label, s.priority, s.pattern) for group in licenses.rules().values() for s in group}
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        words = licenses.normalized((text or "").encode())
        line = words.decode()
        found = {(line.count(" ", 0, m.start()), line.count(" ", 0, m.end()) + 1, label, priority) for label, priority, pattern in every for m in pattern.finditer(line)}
        assert licenses.detect(words) == licenses.settled(found)


def test_maximal_segments_against_all_subsequences():
    """The recursive definition: the best segment of all, then the same to its left and right."""

    def plain(s, a, b):
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not best or best[0] <= 1e-12:
            return []
        i, j = best[3], best[4]
        return plain(s, a, i) + [(i, j - 1, best[0])] + plain(s, j, b)

    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-0.5] * 4 + [1.0, 2.25, 0.75]) for _ in range(rng.randint(0, 16))]
        hits = [(i, x) for i, x in enumerate(s) if x > 0]
        got = toxicity.maximal_segments(hits, -0.5)
        assert abs(sum(x for *_, x in got) - sum(x for *_, x in plain(s, 0, len(s)))) < 1e-9
        for a, b, x in got:
            assert abs(sum(s[a : b + 1]) - x) < 1e-9 and s[a] > 0 and s[b] > 0


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    calm, bad = [f"calm{a}{b}" for a in "abcdefgh" for b in "klmnopqr"], ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 200))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if rng.random() > 0.02 else 1 - int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, l = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")  # noqa: E741
    model = toxicity.fit(docs, l)
    got = toxicity.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.97 and all(r.predicted == int(r.score >= 0.5) for r in got)
    texts = dict(rows)
    for r in got:
        words = texts[r.doc_id].split()
        assert all(words[p.first] in ("vile", "nasty", "rotten") for p in r.passages)
    # Held-out labels play no part.
    other = l.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - l.toxic).otherwise(l.toxic))
    assert toxicity.fit(docs, other).odds == model.odds


def plain_verdicts(pages):
    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        tail = rest[len(host) :]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", tail)[0]

    def own(host, path):
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    def node(u):
        host, path = parts(u)
        host = re.sub(r"^(www\.|m\.)+", "", host)
        query = re.match(r"[^?#]*(\?[^#]*)?", u.split("://", 1)[1])[1] or "" if u and "://" in u else ""
        return "//" + host + re.sub("/+", "/", re.sub(r"(\.html?|/)$", "", path)) + query if u and "://" in u and host else None

    up = {}

    def find(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    named = lambda h: re.findall(r'canonical" href="([^"]*)"', re.sub("<!--.*?-->", "", h or "")) + re.findall(r"url=([^\"]*)\"", re.sub("<!--.*?-->", "", h or ""))
    for _, u, h in pages:
        if node(u):
            find(node(u))
        for t in named(h):
            if node(u) and node(t):
                a, b = find(node(u)), find(node(t))
                up[max(a, b)] = min(a, b)
    said = defaultdict(set)
    for _, u, h in pages:
        for x in [u, *named(h)] if node(u) else []:
            r = own(*parts(x))
            if r and node(x):
                said[find(node(x))].add(r.verdict)
    out = {}
    for i, u, _ in pages:
        r = own(*parts(u))
        s = said[find(node(u))] if node(u) else set()
        out[i] = (*parts(u), r.host + r.path if r else None, r.verdict if r else "block" if s == {"block"} else "allow")
    return out


def test_toxicity_odds_by_definition(spark):
    """Counts over the sample's documents and the log-odds from them, word by word."""
    rows, labels = toxic_corpus()
    rows += [(5000, rows[0][1]), (5001, None)]
    labels += [(5000, 1), (5001, 0), (0, 0), (7777, 1)]
    told = defaultdict(int)
    for i, toxic in labels:
        if zlib.crc32(str(i).encode()) % 5:
            told[i] = max(told[i], toxic)
    sample = {(text, told[i]) for i, text in rows if i in told}
    words, holding = [0, 0], (Counter(), Counter())
    for text, toxic in sample:
        w = re.findall(r"[^\W\d_]+", (text or "").lower())
        words[toxic] += len(w)
        holding[toxic].update({f for x in w for f in [x + ".", *(x[:n] for n in range(3, 10) if n <= len(x))]})
    n_c, n_t = words
    odds = {}
    for f, y in holding[1].items():
        x = holding[0][f]
        prior = toxicity.PRIOR * (x + y) / (n_t + n_c)
        p, q = (y + prior) / (n_t + toxicity.PRIOR), (x + prior) / (n_c + toxicity.PRIOR)
        even = [(x + y) * n / (n_t + n_c) for n in (n_t, n_c)]
        likely = 2 * (y * math.log(y / even[0]) + (x * math.log(x / even[1]) if x else 0))
        delta = math.log(p / (1 - p)) - math.log(q / (1 - q))
        if y >= toxicity.MIN_DOCS and delta >= toxicity.MIN_ODDS and math.sqrt(max(0, likely)) >= toxicity.MIN_Z:
            odds[f] = delta
    got = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).odds
    assert got.keys() == odds.keys() and odds and all(abs(got[f] - odds[f]) < 1e-9 for f in odds)


def linked_pages(n=300, seed=9):
    rng = random.Random(seed)
    host = lambda: rng.choice(["example.com", "www.Example.com", "m.example.com", "example.net", "a.example.net", "example.org", "other.io", "x.io"])
    end = lambda: rng.choice(["", "", "/", ".html", "?a=b", "?id=1", "?id=2#c", "#c", "?u=http://b.com/en/8", "#http://b.org/es/8", "/http://b.net/de/8"])
    url = lambda: f"{rng.choice(['http', 'https'])}://{host()}{rng.choice(['', '/' + rng.choice(['en', 'de', 'es', 'fr']) + '/' + rng.choice('789')])}{end()}"
    link = lambda: rng.choice([f'<link rel="canonical" href="{url()}">', f'<meta http-equiv="refresh" content="0; url={url()}">', f'<!-- <link rel="canonical" href="{url()}"> -->', f'<link rel="next" href="{url()}">'])
    pages = [(i, url(), "<p>plain" + "".join(link() for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))) for i in range(n)]
    return pages + [(900, None, None), (901, "nothing", ""), (902, "http://", "x"), (903, "http://A.ORG?q=/es/", None), (904, "http://a.com?u=http://b.com/en/x", "")]


def test_urls(spark):
    for seed in range(3):
        pages = linked_pages(seed=seed)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.decide(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
        assert got == plain_verdicts(pages)


def test_urls_against_sql(spark, tmp_path):
    """The tables have no links, so the query's SQL is held to pages that have."""
    import duckdb

    spark.createDataFrame(linked_pages(), "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(f"SELECT page_id, host, path, rule, verdict, component FROM ({queries.SQL['op10_urls']})").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in queries.op10_urls(spark, str(tmp_path)).collect())


def test_url_rules_hold_for_link_targets(spark):
    pages = [(1, "http://x.io/1", '<meta http-equiv="refresh" content="0; url=http://a.com/en/1">'), (2, "http://x.io/2", '<link rel="canonical" href="http://x.io/1">'), (3, "http://x.io/1?id=2", ""),
             (4, "http://y.io/", '<link rel="canonical" href="http://a.com/en/1"><link rel="canonical" href="http://example.com/en/7">')]
    got = {r.page_id: r.verdict for r in urls.decide(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow"}  # page 4 joins the blocked target with an allowed one
    got = {r.page_id: r.verdict for r in urls.decide(spark.createDataFrame(pages[:3], "page_id bigint, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def plain_fingerprint(text, n=4):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_pipeline(spark, tmp_path):
    """Each stage's result against plain Python on the stage before."""
    rows, labels = toxic_corpus(400)
    docs = [(i, t + (". Extra words make Longer lines. " * 2 if i % 9 == 0 else ""), "en", f"s{i % 4}", len(t)) for i, t in rows] + [(1000 + i, rows[i][1], "en", "s1", 1) for i in (1, 2, 3)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.fit(current, spark.read.parquet(str(tmp_path / "labels.parquet")))
    clean = stages["toxicity"](spark, current, str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t, *_ in docs if model.probability(model.judge(t)[0]) < 0.5)
    one = stages["near_duplicates"](spark, clean, str(tmp_path))
    left = {r.doc_id: r.text for r in clean.collect()}
    fps = {i: plain_fingerprint(t) for i, t in left.items()}
    group = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for i in left:
            low = min(group[j] for j in left if bin(fps[i] ^ fps[j]).count("1") <= 4)
            if low < group[i]:
                group[i], changed = low, True
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i in left if group[i] == i)
    cut = stages["substrings"](spark, one, str(tmp_path))
    kept = {r.doc_id: r.text for r in one.collect()}
    own = {i: substrings.digests(t)[2] for i, t in kept.items()}
    owner = {}
    for i in sorted(own):
        for k in own[i]:
            owner.setdefault(k, i)
    wanted = {i: substrings.cut_out(t, substrings.removals(t, {k for k in own[i] if k and owner[k] < i})) for i, t in kept.items()}
    assert {r.doc_id: r.text for r in cut.collect()} == wanted and all(r.n_chars == len(r.text) for r in cut.collect())
    mix = stages["mixing"](spark, cut, str(tmp_path))
    plan = {r.doc_id: r.taken for r in mixing.plan(cut).collect()}
    got = Counter()
    for r in mix.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == Counter({i: n for i, n in plan.items() if n})
    packed = stages["packing"](spark, mix, str(tmp_path)).collect()
    whole = Tokenizer.from_file(tokenizer_file())
    assert sum(p.length for p in packed) == sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix.collect())
    assert [json.dumps(sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "ids_crc32").collect())))] == [json.dumps(sorted(str(p) for p in spark.createDataFrame([(p.doc_id, p.length, p.ids_crc32) for p in packed], "doc_id bigint, length bigint, ids_crc32 bigint").collect()))]


def test_url_links_are_read_relative_to_the_page(spark):
    blocked = "http://a.org/es/7"
    pages = [
        (1, blocked, ""),
        (2, "https://www.a.org/fr/1", '<link rel="canonical" href="/es/7">'),
        (3, "https://b.io/x", '<link rel=canonical href="//a.org/es/7.html">'),
        (4, "http://a.org/fr/2", '<meta http-equiv="refresh" content="0; url=../es/7/">'),
        (5, "http://c.io/x", '<base href="http://a.org/es/"><link rel="canonical" href="7">'),
        (6, "http://d.io/x", '<link rel="canonical" href="http:&#47;&#x2F;a.org/es/7">'),
        (7, "http://e.io/x", '<link rel="canonical" href="/login?next=http://a.org/es/7">'),
        (8, "http://f.io/x", '<link rel="canonical" href="javascript:void(0)">'),
        (9, "http://g.io/x", '<link rel="canonical" href="//[bad/">'),
    ]
    got = {r.page_id: r.verdict for r in urls.decide(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "block" if i < 7 else "allow" for i in range(1, 10)}
