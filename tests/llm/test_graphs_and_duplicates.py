"""Components, SimHash and substring dedup against brute force."""

import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash

from foliograph.llm import simhash, substrings
from foliograph.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (7, 7)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {n: u.find(n) for n in u.up}
    assert components(df.limit(0), "a", "b").count() == 0


def plain_fingerprint(text, n=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(40)]
    out = [" ".join(b) for b in base]
    for _ in range(160):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice(words)
        out.append(" ".join(b))
    return out + ["", "one", "One", "two words", " A b\tC  d\n"]


def test_simhash_against_all_pairs(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    fps = [plain_fingerprint(t) for t in texts]
    u = Union()
    for i in range(len(fps)):
        u.find(i)
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                u.join(i, j)
    for tile in (4096, 3):
        got = simhash.near_duplicates(df, tile=tile).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", u.find(i)) for i in range(len(fps))}


def test_no_pair_within_the_radius_misses_all_blocks(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    rows = []
    for i, x in enumerate(a):
        y = int(x)
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        rows.append((i, int(np.int64(x)), int(np.uint64(y).astype(np.int64))))
    df = spark.createDataFrame(rows, "i int, x bigint, y bigint")
    for parts in (5, 6, 8):
        kx, ky = (df.select("i", simhash.block_keys(df[c], parts)) for c in "xy")
        assert kx.join(ky, ["i", "choice", "key"]).select("i").distinct().count() == 500
    assert [simhash.parts_for(n) for n in (0, 10**6, 10**9, 10**11)] == [5, 5, 6, 7]


def test_blocks_that_end_with_a_batch_lose_no_row():
    rng = random.Random(7)
    fps = sorted((rng.getrandbits(64) for _ in range(41)), key=lambda f: bin(f).count("1"))
    rows = [(0, 5, f) for f in fps] + [(0, 6, fps[0]), (1, 5, fps[0]), (1, 5, fps[0] ^ 1)]
    schema = pa.schema([("choice", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())])
    signed = lambda f: int(np.uint64(f).astype(np.int64))
    for width in (1, 7, 8, 40, 41, 100):
        batches = [pa.RecordBatch.from_pylist([{"choice": c, "key": k, "fp": signed(f)} for c, k, f in rows[i : i + width]], schema=schema) for i in range(0, len(rows), width)]
        out = [r for b in partial(simhash._compare_blocks, tile=8)(iter(batches)) for r in b.to_pylist()]
        held = np.concatenate([np.frombuffer(r["fps"], np.uint64) for r in out if r["fps"] is not None])
        assert sorted(held.tolist()) == sorted(fps)
        assert [(r["a"], r["b"]) for r in out if r["a"] is not None] == [(signed(fps[0]), signed(fps[0] ^ 1))]


def test_rows_without_a_doc_id_link_others(spark):
    """Two documents that are further apart than the radius are one group by a row between them."""
    rng, texts = random.Random(8), None
    while texts is None:
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        steps = [list(base)]
        for _ in range(12):
            steps.append(list(steps[-1]))
            steps[-1][rng.randrange(60)] = f"w{rng.randrange(300)}"
        fps = [simhash.fingerprint(" ".join(s).encode()) for s in steps]
        far = lambda i, j: bin(fps[i] ^ fps[j]).count("1")
        texts = next(([" ".join(steps[k]) for k in (i, m, j)] for i in range(13) for j in range(13) for m in range(13) if far(i, j) > 4 >= max(far(i, m), far(m, j))), None)
    rows = [(9, texts[0]), (None, texts[1]), (5, texts[2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {5}
    assert [r.component_id for r in simhash.near_duplicates(df.where("doc_id is null")).collect()] == [None]


def test_one_row_of_each_group_stays(spark):
    a, b = ("some words that stand here once and are looked at by all of them " * 3), ("nothing of the other text is said again in this one here at all " * 3)
    rows = [(1, a, 0), (1, a, 1), (1, b, 2), (2, a, 3), (3, b, 4), (3, b, 5), (4, "x", 6), (4, "x", 7), (None, a, 8)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, n int")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (4, "x"), (None, a)], key=str)


def plain_dedup(texts, run_words=substrings.RUN_WORDS):
    """Owners by one pass over all units, removals by the definition."""
    digests = {i: substrings.digests(t) for i, t in texts.items()}
    owner = {}
    for i in sorted(texts):
        for k in digests[i][2]:
            owner.setdefault(k, i)
    out = {}
    for i, t in texts.items():
        spans, counts, keys = digests[i]
        flags = ["short" if k == 0 else "repeat" if owner[k] < i or k in keys[:n] else "own" for n, k in enumerate(keys)]
        drop, n = [], 0
        while n < len(spans):
            m = n
            while m < len(spans) and flags[m] != "own":
                m += 1
            repeats = [x for x in range(n, m) if flags[x] == "repeat"]
            if repeats and sum(counts[repeats[0] : repeats[-1] + 1]) >= run_words:
                drop.append((spans[repeats[0]][0], spans[repeats[-1]][1]))
            n = max(m, n + 1)
        out[i] = drop
    return out


def test_substrings_against_one_pass(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 14))).capitalize() + "."
    passages = [" ".join(sentence() for _ in range(9)) for _ in range(5)]
    texts = {}
    for i in range(80):
        own = [sentence() for _ in range(20)]
        if i % 3 == 0:
            own.insert(rng.randrange(20), "tail of words " + rng.choice(passages) + " head of words")
        if i % 7 == 0:
            own += own[:12]
        if i % 10 == 9:
            own = [w.upper() for w in own]
        texts[i] = rng.choice([" ", "\n"]).join(own)
    texts[80] = texts[1]
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    wanted = plain_dedup(texts)
    got = {r.doc_id: ([(x.start, x.end) for x in r.removed], r.text) for r in substrings.dedup(df).collect()}
    assert {i: g[0] for i, g in got.items()} == wanted
    assert got[80][1] == "" and any(wanted[i] for i in texts if i % 3 == 0)
    for i, t in texts.items():
        if not wanted[i]:
            assert got[i][1] == t
    # Case aside, a passage stays in the first document that has it and in no other.
    for p in passages:
        assert [i for i, g in got.items() if p.lower() in g[1].lower()] == [i for i, t in texts.items() if p.lower() in t.lower()][:1]


def test_units_cover_the_text():
    for text in ["", "a", "One two. Three four\n\nfive Six", "x " * 3000, "word " * 50 + "End. " * 40]:
        at = 0
        for a, b in substrings.units(text):
            assert a >= at and text[at:a].strip() == "" and a < b
            at = b
        assert text[at:].strip() == ""


def test_short_units_of_one_text_only_stay():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [" ".join(word() for _ in range(3)) for _ in range(2)]
    unique = "\n".join(" ".join(word().title() for _ in range(1 + i % 2)) for i in range(300))
    other = substrings.digests("\n".join([common[0], *(" ".join(word() for _ in range(9)) for _ in range(9)), common[1]]))[2]
    assert substrings.removals("\n".join([common[0], unique, common[1]]), set(other)) == []
    # Each word alone is common, their order is not.
    words = [word().title() for _ in range(60)]
    seen = set(substrings.digests(" ".join(words))[2]) | set(substrings.digests(" ".join(words[::-1]))[2])
    rng.shuffle(words)
    assert substrings.removals("\n".join(words), seen) == []


def passage_cases():
    """Passages of 51 words and more in every shape: plain, title case, a word a line, without spaces."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    run = lambda n: [word() for _ in range(n)]
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(n))
    for _ in range(300):
        passage = run(rng.randint(51, 60))
        yield " ".join([*run(90), *passage, *run(90)]), " ".join([*run(rng.randint(0, 90)), *passage, *run(rng.randint(0, 90))]), " ".join(passage)
    for shape in ("\n".join, lambda w: " ".join(w).title(), lambda w: "  ".join(w).upper()):
        passage = run(51)
        yield " ".join([*run(40), *passage, *run(40)]), " ".join(run(33)) + " " + shape(passage) + " " + " ".join(run(7)), shape(passage)
    for passage in (han(102), "，".join(han(9) for _ in range(14)), "".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(120)), "".join(run(90))):
        yield han(50) + passage + han(50), han(20) + passage + han(9), passage
        yield "x" * 60 + passage + "y" * 60, "z" * 60 + passage + "v" * 60, passage


def test_no_passage_over_50_words_is_missed():
    for first, second, passage in passage_cases():
        own = set(substrings.digests(first)[2])
        ((a, b),) = substrings.removals(second, own)
        at = second.index(passage)
        assert at <= a < b <= at + len(passage) and b - a > len(passage) / 3
        assert substrings.removals(first, set()) == []


def test_periodic_text_keeps_its_first_stretch():
    words = ("tick tock boom " * 100).split()
    ((a, b),) = substrings.removals(" ".join(words), set())
    assert 30 <= len(" ".join(words)[:a].split()) <= 36 and b == len(" ".join(words))


def shared_corpus(seed=21):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    run = lambda n: [word() for _ in range(n)]
    passages = [run(rng.choice([12, 29, 31, 50, 51, 70, 140])) for _ in range(14)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += run(rng.randint(0, 80)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        if i % 8 == 0:
            words += words[: rng.randint(10, 120)]
        if i % 9 == 0:
            words = ["again"] * 200 + words
        rows.append((i // 2 if i % 10 == 4 else i, " ".join(w + rng.choice(["", "", ",", "."]) for w in words)))
    return rows


def test_substrings_by_their_meaning(spark):
    """Without digests or cuts: what is removed stands earlier as a run of 30 words at least, and of every run of 50 words
    that stands earlier at most 7 words at its start and 14 at its end are left."""
    rows = shared_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    hashed = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    order = sorted({(i, hashed[i, t], t) for i, t in rows})
    got = {(r.doc_id, hashed_text): spans for r in substrings.dedup(df.withColumn("source", df.text)).collect() for hashed_text, spans in [(r.source, [(x.start, x.end) for x in r.removed])]}
    before, lines, removed, wanted = set(), [], 0, 0
    n = substrings.RUN_WORDS
    for i, _, text in order:
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        words = [re.sub(r"[^a-z]", "", text[a:b].lower()) for a, b in at]
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        seen = [g in before for g in grams]
        # Earlier documents, or this one's own start without overlap.
        first = {}
        again = [seen[k] or first.setdefault(g, k) <= k - n for k, g in enumerate(grams)]
        may = [any(again[max(0, w - n + 1) : w + 1]) for w in range(len(words))]
        gone = [any(a <= x < b for a, b in got[i, text]) for x, _ in at]
        assert all(m or not g for m, g in zip(may, gone, strict=True)), (i, text)
        removed += sum(gone)
        start = 0
        while start < len(grams):
            end = start
            while end < len(grams) and seen[end]:
                end += 1
            last = end + n - 2  # last word of the run
            run = f" {' '.join(words[start : last + 1])} "
            if end > start and last - start + 1 >= 50 and any(run in x for x in lines):
                wanted += 1
                assert all(gone[start + 7 : last - 13]), (i, start, last)
            start = end + 1
        before.update(grams)
        lines.append(f" {' '.join(words)} ")
    assert removed > 500 and wanted > 10


def test_cutting_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        text = "ab  " * n
        began = time.process_time()
        assert substrings.cut_out(text, [(4 * i, 4 * i + 1) for i in range(n)]) == "b  " * n
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.01)
