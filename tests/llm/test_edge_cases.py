"""Every operator and stage over the same awkward rows: nulls in any column, empty, blank and very long texts, ties,
repeated rows, an empty table, and extra columns whose names clash with the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import html_text, licenses, media, mixing, packing, quality, simhash, substrings, toxicity, urls
from foliograph.llm.queries import tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["_words", "_row", "_id", "_size", "size", "score", "target", "removed", "fp", "rep", "_gone", "_text", "_elsewhere", "first", "weight", "_copy", "kept", "component", "predicted", "media"]
LONG = " ".join(f"word{i % 977} of line {i}." for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "a", 10),
    (2, None, "en", "a", 0),
    (3, "", None, None, None),
    (4, " \t\n ", "de", None, 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (None, "a row without a number but with words enough to be looked at by all the rules there are here today", "en", "c", None),
    (7, "one", "en", "a", 3),
    (8, "😀 ß <|endoftext|> \x00 odd chars", "xx", "", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, None), (None, 0, 1), (99, 0, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_media(docs, none):
    rows = media.digests(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == 0 and by[2].payload_bytes == 64 and by[2].media_sha256 == by[3].media_sha256
    assert by[5].payload_sha256 == by[6].payload_sha256 and by[5].n_bytes == len(LONG)
    assert media.digests(none).count() == 0 and media.tensors(media.store(none)).count() == 0


def test_media_null_files(spark):
    files = spark.createDataFrame([(1, None)], "doc_id bigint, media binary")
    assert media.tensors(files).collect()[0].rgb is None


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[2].fingerprint == "0" * 16 and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert by[6].component_id == 5 and by[1].component_id == 1
    kept = simhash.keep_one(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 7, 8, None], key=str)
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and by[2].n_words == 0 and by[2].base_failed and not by[3].kept
    assert by[1].n_repeat_words == 45 and by[5].n_repeat_words == by[6].n_repeat_words
    assert quality.judge(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, tokenizer_file()).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    only = [r for r in rows if r.doc_id == 2]
    assert len(only) == 1 and only[0].length == 1 and list(only[0].ids) == [0]
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS) and all(r.n_base == 0 and r.labels == "" and r.first_word is None for r in rows)
    assert licenses.scan(none).count() == 0


def test_substrings(docs, none):
    out = substrings.dedup(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(out.columns) == set(docs.columns)
    texts = {r.doc_id: r.text for r in rows}
    assert texts[2] is None and texts[3] == "" and texts[4] == " \t\n " and texts[7] == "one"
    assert len(texts[6]) < len(LONG) / 100 < len(texts[5])
    assert substrings.dedup(none).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.fit(none, labels.limit(0))
    assert toxicity.score(none, empty).count() == 0 and toxicity.score(docs, empty).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(docs, empty).columns == docs.columns


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", None), (2, None, ""), (3, "no scheme", "<p>hi"), (4, "HTTP://A.com", "<article>" + "<p>x" * 50_000), (4, "HTTP://A.com", "&amp;")], "page_id bigint, url string, html string")
    for c in ("host", "path", "rule", "text", "component", "_node"):
        pages = pages.withColumn(c, F.lit("x"))
    got = {r.page_id: r for r in urls.decide(pages).collect()}
    assert got[2].host == got[3].host == "" and got[2].verdict == "allow" and got[4].host == "a.com" and got[4].path == ""
    assert urls.decide(pages.limit(0)).count() == 0
    texts = html_text.extract(pages.drop("text")).collect()
    assert len(texts) == 5 and [r.text for r in texts if r.page_id in (1, 2)] == ["", ""] and html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none, labels, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", "removed", "size")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (plain, plain.limit(0)):
        current = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, current, str(tmp_path))
            if name != "packing":
                assert out.columns == rows.columns, name
                current = out
            assert out.count() >= 0
