"""Replies, residuals, tables and memory where SQL can't follow, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as t
from foliograph.functions.geometry import Box
from foliograph.operators import blocks, containment, external, quality, tables, translation
from foliograph.plans import text_queries

SMALL = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("html,cells", [
    ("<table><tr></tr><tr><td>a</td></tr></table>", [(0, 0, "a", True)]),
    ("<table><tr><td>a<p>b</p><div>c</div><li>d</td></tr></table>", [(0, 0, "abcd", True)]),
    ("<table><tr><td>a<br>b</td><td>never</tr><tr><td>c</td></tr></table>", [(0, 0, "a\nb", True), (1, 0, "c", False)]),
    ("<table><tr><td>a</td><td>b</td>", [(0, 0, "a", True), (0, 1, "b", True)]),
    ("<table><tr><td rowspan=x colspan=0>a</td></tr><tr> </tr><tr><th>b</th></tr></table>", [(0, 0, "a", True), (1, 0, "b", True)]),
    ("<table><td>a</td></tr><td>b</td></table>", [(0, 0, "a", True), (1, 0, "b", False)]),
    ("<p>no</p>", []),
])
def test_tables_that_are_not_well_formed(html, cells):
    assert [(c["row"], c["column"], c["source_text"], c["is_header"]) for c in tables.grid(html)[0]] == cells


def test_references_by_name_and_number(spark):
    assert one(spark, t.strip_markup(F.lit("caf&eacute; &#8211; &#x41;&nbsp;<>&lt;b&gt; &amp;lt; &notit; &unknown;<br>x")))[0] == "café – A\xa0<><b> &lt; ¬it; &unknown;\nx"
    assert one(spark, t.normalize_translation(F.lit("a &amp;amp; b")), t.strip_markup(F.lit("a\x0bb  c \r\n\r\nd")))[:] == ("a &amp; b", "a\nb\nc\nd")


def test_chart_names_and_messages(spark):
    said = lambda x: t.chart_proper_name(F.lit(x), [], [])
    assert one(spark, said("some company"), said("some incorporated"), said("some corp"), said("Acme"), said("漢 Acme"))[:] == (False, False, True, True, False)
    message = lambda x: external.content(F.lit(x))
    assert one(spark, message('" a "'), message('[{"type":"output_text","text":"x"},{"type":"text","text":"y"},{"text":"z"}]'), message('""'), message("[]"), message('{"a":1}'))[:] == ("a", "xy", None, None, None)


def test_replies(spark):
    asked = spark.createDataFrame([(b, i, f"i{i}", f"s{i}") for b in range(7) for i in range(3)], "batch int, position int, id string, source_text string")
    said = {
        0: ["i0", "i1", "i2"], 1: ["x", "x", "x"], 2: ["i0", "i1"], 3: ["i0", "i1", "i2", "i2"], 4: ["i0", "x", "x"], 5: ["i0", "i1", "i2", "x", "x"], 6: ["i0", "x"],
    }
    reply = spark.createDataFrame([(b, n, i, f"t{n}") for b, ids in said.items() for n, i in enumerate(ids)], "batch int, position int, id string, text string")
    got = translation.resolve_reply(asked, reply, ["batch"]).collect()
    assert {r.batch: r.status for r in got} == {0: "ok", 1: "positional", 2: "missing", 3: "duplicate", 4: "positional", 5: "unknown", 6: "unknown"}
    assert len(got) == 21 and {r.target_text for r in got if r.batch == 4} == {"t0", "t1", "t2"}


def plain_residuals(rows, terms, contexts, generic, remarks):
    """Those still to be translated, by the rules as they are told."""
    suffix = re.compile(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(t.COMPANY_SUFFIXES) + r")(?![A-Za-z0-9_])")
    latin = re.compile(r"[A-Za-z][A-Za-z .,&'®™/-]*")
    seen, out = set(), []
    for doc, order, text in sorted(rows):
        text = text.strip()
        if not text or (doc, text.lower()) in seen:
            continue
        seen.add((doc, text.lower()))
        if any(r in text.lower() for r in remarks) or any(text.lower() in x.lower() for x in terms.get(doc, ())):
            continue
        company = bool(re.search("[®™]", text))
        if not company and latin.fullmatch(text) and not suffix.search(text):
            company = any(suffix.search(c) and text.lower() in c.lower() for c in contexts.get(doc, ())) or bool(re.fullmatch("[A-Z][a-zA-Z]{2,}", text) and text.lower() not in generic)
        words = re.findall("[A-Za-z]+", text)
        metric = "|".join(t.METRICS)
        model = len(text) >= 2 and any([
            re.fullmatch(r"[A-Z](?:[&/][A-Z])+", text), re.fullmatch(rf"(?:Low|High)\s+(?:{metric})(?:\s+(?:{'|'.join(t.MATERIALS)}))?", text), re.fullmatch(r"[A-Z][A-Z0-9]*(?:[-./][A-Z0-9]+)*", text),
            "-" in text and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 ./-]*", text) and sum(c.isupper() for c in text) >= 2,
            re.search(rf"(?<![A-Za-z0-9_])(?:{'|'.join(t.STANDARDS)})(?![A-Za-z0-9_])", text) and not re.search("[ぁ-ヿ㐀-鿿가-힯]", text),
            re.match(rf"\[?\s*(?:{metric})(?![A-Za-z0-9_])", text) and set(words) <= {*t.METRICS, *t.METRIC_WORDS}, text in t.CHEMICALS,
            re.fullmatch(r"[A-Za-z0-9µμΩ°%().,+\-/\s]+", text) and re.search("[0-9]|%|°|/|µ|μ|Ω", text) and words and {w.lower() for w in words} <= set(t.UNITS),
        ])
        if not company and not model:
            out.append((doc, order, text))
    return out


def test_kept_residuals_over_all_rows(spark):
    rows, terms, contexts = text_queries.residual_rows(spark, SMALL)
    by = lambda df, c: {k: [r[c] for r in g] for k, g in groups(df).items()}

    def groups(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.doc_id, []).append(r)
        return out

    plain = plain_residuals([(r.doc_id, r.ord, r.text) for r in rows.collect()], by(terms, "term"), by(contexts, "source_text"), text_queries.GENERIC, ["fuzzy"])
    got = [(r.doc_id, r.ord, r.text) for r in text_queries.kept_residuals(spark, SMALL).collect()]
    assert sorted(got) == sorted(plain) and len({x[2] for x in got}) > 50
    kept = {(d, x.lower()) for d, _, x in plain}
    again = sorted((r.doc_id, r.ord) for r in rows.collect() if (r.doc_id, r.text.strip().lower()) in kept)
    assert sorted((r.doc_id, r.ord) for r in text_queries.surviving_residuals(spark, SMALL).collect()) == again


def test_sizes_down_to_the_least(spark):
    def plain(text, width, height, start, least):
        size = max(least, start)
        while size >= least:
            n = sum(max(1, -(-len(line) * 0.5 * size // max(1.0, width))) for line in text.split("\n"))
            if n * 1.12 * size <= height + 0.35 * size:
                return size, False
            size -= 0.5
        return least, True

    rng = random.Random(2)
    cases = [("x" * rng.randint(1, 200), rng.choice([20.0, 80.0, 300.0]), rng.choice([8.0, 14.0, 40.0, 90.0]), rng.choice([5.0, 7.2, 9.0, 12.25, 18.0]), rng.choice([4.5, 6.0, 7.0])) for _ in range(150)]
    df = spark.createDataFrame(cases, "t string, w double, h double, s double, l double")
    got = df.select("*", blocks.fit(F.col("t"), Box(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")), F.col("s"), F.col("l")).alias("f")).collect()
    assert all((r.f.font_size, r.f.overflow) == plain(r.t, r.w, r.h, r.s, r.l) for r in got)


def test_wrapping_by_character(spark):
    wrap = blocks.wrapper(lambda c: 1.0 if c == "W" else 0.5)
    rows = [("aaaa bbbb", 20.0), ("aaaa  bbbb", 20.0), ("WWWW", 20.0), ("a\n\nb", 20.0), ("", 20.0), ("abc", 1.0)]
    got = spark.createDataFrame(rows, "t string, w double").select(wrap("t", "w", F.lit(10.0)).alias("l")).collect()
    assert [r.l for r in got] == [["aaaa", "bbbb"], ["aaaa", " bbb", "b"], ["WW", "WW"], ["a", "", "b"], [""], ["a", "b", "c"]]


def test_references_of_the_table(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in text_queries.decoded_references(spark, SMALL).collect()} == {k: html.unescape(v) for k, v in pages.items()}


def test_wrapped_lines_of_the_table(spark):
    from foliograph.plans import bind, review_queries

    lines = {(r.doc_id, r.pos): r.source_text for r in bind.lines(spark, SMALL).collect()}
    for r in review_queries.wrapped_texts(spark, SMALL).collect():
        held, text = r.text.split("\n"), lines[r.doc_id, r.pos]
        assert len(held) == r.lines and "".join("".join(held).split()) == "".join(text.split())
        assert all(len(x) <= 40 for x in held)


def test_items_of_any_length_are_found(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, "")]
    items = [(i, " ".join(t.split()[2 : 2 + n])) for i, (t, n) in enumerate((texts[rng.randrange(60)][1], rng.choice([1, 2, 6, 7, 9, 20])) for _ in range(40))] + [(90, None), (91, "7 w3 w")]
    df, it = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    wanted = sorted((i, d) for i, x in items for d, y in texts if x is not None and y is not None and x in y)
    for most in (containment.MOST_SENT, 0):
        containment.MOST_SENT, before = most, containment.MOST_SENT
        assert sorted((r.item_id, r.doc_id) for r in containment.contained(df, it).collect()) == wanted
        containment.MOST_SENT = before


def test_memory_store_touches_only_its_buckets(spark, tmp_path):
    path, how = str(tmp_path / "memory"), ("en", "zh-CN", "p1", "m1", F.lit("job1"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    empty = translation.memory_upsert(spark.createDataFrame([], "source_hash string, source_text string, target_text string, source_language string, target_language string, policy_fingerprint string, model string, last_job_id string, occurrences bigint"), spark.createDataFrame([(f"s{i}", f"t{i}", 1) for i in range(40)], "source_text string, target_text string, occurrences bigint"), *how)
    empty.withColumn("bucket", translation.bucket_of(F.col("source_hash"), 8)).write.partitionBy("bucket").parquet(path)
    files = lambda: {p for p in (tmp_path / "memory").rglob("*.parquet")}
    before = files()
    pairs = spark.createDataFrame([("s3", "new", 2), ("fresh", "x", 1)], "source_text string, target_text string, occurrences bigint")
    translation.memory_store(path, pairs, 8, *how)
    after = {r.source_text: (r.target_text, r.occurrences) for r in spark.read.parquet(path).collect()}
    assert len(after) == 41 and after["s3"] == ("new", 3) and after["fresh"] == ("x", 1) and after["s4"] == ("t4", 1)
    assert len(before & files()) >= len(before) - 2


def test_a_review_that_finds_nothing_usable(spark):
    items = spark.createDataFrame([(1, "r", 0, "s", "t", [1.0]), (1, "r", 1, " ", "t", [0.0, 0.0, 9.0, 9.0]), (1, "ok", 0, "s", "t", [0.0, 0.0, 9.0, 9.0]), (2, "r", 0, "s", None, None)], "doc_id int, region_id string, position int, source_text string, target_text string, bbox array<double>")
    assert sorted((r.doc_id, r.region_id) for r in external.unreadable_regions(items).collect()) == [(1, "r"), (2, "r")]
    assert quality.evaluation_failures(spark.createDataFrame([(1, True, "e"), (2, False, "e"), (3, True, None)], "doc_id int, has_file boolean, error string")).count() == 1
