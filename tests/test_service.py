"""The surface and the main path, end to end."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators.external import dictionary_translator
from foliograph.plans.localize import gate, layout, localize
from foliograph.plans.service import Refused, Service
from foliograph.sources import scans

NOW, LATER = "2024-05-01 10:00:00", "2024-05-01 10:00:02"


def test_service(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1 text")
    (tmp_path / "in" / "b.pdf").write_bytes(b"no")
    s = Service(spark, str(tmp_path / "state"), "v3")
    assert s.jobs().count() == 0
    terms = lambda rows: spark.createDataFrame(rows, "ord int, id string, source_text string, target_text string, category string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    s.put_terms(terms([(0, "t1", "Term", "甲", " ", NOW), (1, "t2", "Longer term", "乙", "c", NOW)]))
    files = scans.files(spark, str(tmp_path / "in")).withColumns({"name": F.element_at(F.split("path", "/"), -1)}).withColumn("job_id", F.substring("name", 1, 1))
    assert [tuple(r) for r in s.create(files, NOW).collect()] == [("b", "not_pdf")]
    s.put_terms(terms([(0, "t9", "TERM", "丙", "", LATER)]))
    assert [(r.id, r.target_text, r.category) for r in s.glossary().collect()] == [("t1", "丙", "general"), ("t2", "乙", "c")]
    policy = F.struct(F.lit("en").alias("source_language"), F.lit("zh-CN").alias("target_language"), F.lit(True).alias("names"), F.array().cast("array<string>").alias("protected_terms"))
    assert s.instruction("a", policy, {"names": "Keep names."}) == "en -> zh-CN\nKeep names.\nLonger term => 乙\nTerm => 甲"
    with pytest.raises(Refused) as e:
        s.download("a")
    assert e.value.code == 409
    with pytest.raises(Refused):
        s.reprocess("a", NOW)
    s.update("a", {"status": F.lit("translating")})
    assert s.recover(spark.createDataFrame([(s.table("jobs").first().source_path, True)], "path string, exists boolean"), "old") == ["a"]
    issues = spark.createDataFrame([("a", 1, "v", "text_overflow", "error", "m", 0, "b1")], s.table("issues").schema)
    assert s.finish("a", issues, "out/a.pdf") == "needs_review" and s.download("a") == ("out/a.pdf", "review-recommended")
    d = s.details("a", LATER).first()
    assert [x.stage for x in d.logs] == ["queued"] and d.issues[0].code == "text_overflow" and d.duration_ms == 0 and d.shown_progress == 100
    s.reprocess("a", LATER)
    assert s.table("issues").count() == 0 and s.jobs().first().status == "queued" and s.table("logs").count() == 2
    assert s.finish("a", issues.limit(0), "out/a2.pdf") == "completed" and s.download("a")[1] == "passed"
    s.cancel("a")
    assert s.jobs().first().status == "completed"
    s.delete_term("t2")
    with pytest.raises(Refused) as e:
        s.delete_term("t2")
    assert e.value.code == 404 and s.glossary().count() == 1 and s.candidates().count() == 0
    with pytest.raises(Refused):
        s.details("zz", NOW)


def test_localize(spark):
    fields = "doc_id int, page_index int, id string, ord int, reading_order int, source_text string, source_type string, region_type string, preserve_reason string, fragment_confidence double, font_size double, x0 double, top double, x1 double, bottom double"
    rows = [(1, 0, "a", 0, 0, "Known", "native", "body", None, 1.0, 10.0, 0.0, 0.0, 200.0, 14.0), (1, 0, "b", 1, 1, "Price 12", "native", "body", None, 1.0, 10.0, 0.0, 20.0, 200.0, 34.0), (1, 0, "c", 2, 2, "ACME", "native", "body", "proper name", 1.0, 10.0, 0.0, 40.0, 200.0, 54.0), (2, 0, "a", 0, 0, "Price 12", "native", "body", None, 1.0, 10.0, 0.0, 0.0, 200.0, 14.0), (2, 0, "b", 1, 1, "Fine", "native", "body", None, 1.0, 10.0, 0.0, 20.0, 200.0, 34.0)]
    blocks = spark.createDataFrame(rows, fields).withColumns({"font_weight": F.lit(400), "alignment": F.lit("left")})
    memory = spark.createDataFrame([("h", "Known", "已知", "en", "zh-CN", "p", "m", "j", 1)], "source_hash string, source_text string, target_text string, source_language string, target_language string, policy_fingerprint string, model string, last_job_id string, occurrences bigint")
    words = {"Price 12": "价格 13", "Fine": "好", "Known": "never asked"}
    out = localize(blocks.where("doc_id = 1 or id <> 'x'"), memory, dictionary_translator(words), "p", ["price"])
    assert {(r.doc_id, r.id): r.target_text for r in out.translations.collect()} == {(1, "a"): "已知", (1, "b"): "价格 13", (1, "c"): "ACME", (2, "a"): "价格 13", (2, "b"): "好"}
    assert sorted((r.doc_id, r.code, r.block_id) for r in out.issues.collect()) == [(1, "number_mismatch", "b"), (2, "number_mismatch", "a")]
    assert {r.doc_id: r.status for r in out.status.collect()} == {1: "needs_review", 2: "needs_review"} and out.candidates.count() == 0
    good = localize(blocks.where("doc_id = 2"), memory, dictionary_translator(words | {"Price 12": "价格 12"}), "p", [])
    assert good.status.first().passed and sorted((r.source_text, r.confidence) for r in good.candidates.collect()) == [("Fine", 0.82), ("Price 12", 0.82)]
    assert {r.id: r.outcome for r in out.drawing.where("doc_id = 1").collect()} == {"a": "redact", "b": "redact", "c": "preserved"}


def test_layout_and_gate(spark):
    fields = "doc_id int, page_index int, id string, ord int, source_text string, source_type string, region_type string, preserve_reason string, x0 double, top double, x1 double, bottom double"
    native = spark.createDataFrame([(1, 0, "n", 0, "few", "native", "body", None, 0.0, 0.0, 100.0, 10.0)], fields)
    parsed = spark.createDataFrame([(1, 0, "t", 0, "a\nb\nc\nd", "mineru", "table", None, 0.0, 100.0, 100.0, 200.0)], fields)
    regions = spark.createDataFrame([(1, 0, 0.0, 100.0, 100.0, 200.0)], "doc_id int, page_index int, x0 double, top double, x1 double, bottom double")
    got = {r.id: r.preserve_reason is None for r in layout(native, parsed, regions).collect()}
    assert got == {"n": True, "t": False}
    wide = native.withColumns({"fragment_confidence": F.lit(1.0), "geometry_fill_ratio": F.lit(0.1), "page_width": F.lit(100.0), "page_height": F.lit(100.0), "pages": F.lit(1), "coverage": F.lit(1.0)})
    assert gate(wide).count() == 1
