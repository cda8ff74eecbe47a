"""Job state, reports, sources, sinks, pixels and streams on hand-made rows."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.operators import documents, pixels, quality, report, state, tables
from foliograph.sources import scans, sinks
from foliograph.streaming import jobs as stream


def test_flags(spark):
    rows = [("completed", "v3", True), ("completed", "v2", True), ("needs_review", "v2", True), ("needs_review", "legacy", True), ("needs_review", "v3", True), ("completed", "v3", False), ("queued", "v3", True)]
    df = spark.createDataFrame(rows, "status string, version string, has_file boolean")
    flags = state.availability(df.status, df.version, "v3", df.has_file, df.version == "legacy")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in flags.items())).collect()]
    assert got == [(True, True, False), (False, False, True), (False, True, False), (False, False, False), (True, True, False), (False, False, False), (False, False, False)]


def test_recover_and_reprocess(spark):
    jobs = spark.createDataFrame([(1, "translating", 40, "a", None, "v2"), (2, "failed", 10, "a", "legacy text", "v3"), (3, "failed", 10, "a", "other", "v2"), (4, "queued", 5, "gone", None, "v3"), (5, "completed", 100, "a", None, "v3")], "job_id int, status string, progress int, source_path string, error_message string, pipeline_version string")
    files = spark.createDataFrame([("a", True), ("gone", False)], "path string, exists boolean")
    got = {r.job_id: (r.status, r.progress) for r in state.recover(jobs, files, "legacy text").collect()}
    assert got == {1: ("queued", 0), 2: ("queued", 0), 4: ("failed", 5)}
    reset = state.reprocess(jobs, "v3")
    assert {r.job_id: (r.accepted, r.drop_batches) for r in reset.collect()} == {1: (False, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (True, False)}
    batches = spark.createDataFrame([(1, "x"), (3, "y"), (5, "z")], "job_id int, b string")
    assert sorted(r.b for r in state.batches_after_reprocess(batches, reset).collect()) == ["x", "z"]
    assert [r[0] for r in jobs.select(state.cancel(jobs.status)).collect()] == ["cancelled", "failed", "failed", "cancelled", "completed"]


def test_events(spark):
    ev = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", None), (2, 1, "c", None), (1, 2, "a", 7)], "job int, t int, s string, x int")
    got = {r.job: (r.s, r.x) for r in state.newest(ev, ["job"], ["t", "s"], ["s"], ["x"]).collect()}
    assert got == {1: ("b", 7), 2: ("c", None)}
    sums = state.accumulate(spark.createDataFrame([(1, 5, True), (1, -3, None), (2, None, None)], "job int, n int, f boolean"), "job", ("n",), "f")
    assert {r.job: (r.n, r.f) for r in sums.collect()} == {1: (5, True), 2: (0, False)}


def test_batches(spark):
    saves = spark.createDataFrame([(1, {"a": "1", "b": "2"}, 1, 10, True, "partial", " boom "), (2, {"b": "3"}, 1, 5, False, "completed", None)], "n int, translations map<string,string>, attempts int, input_tokens int, token_usage_available boolean, status string, error_message string")
    saves = saves.withColumns({"k": F.lit(1), "output_tokens": F.lit(0), "total_tokens": F.lit(0)})
    r = state.merge_batch_progress(saves, ["k"], ["n"]).first()
    assert r.translations == {"a": "1", "b": "3"} and (r.attempts, r.input_tokens, r.status, r.token_usage_available, r.error_message) == (2, 15, "completed", True, "")
    b = spark.createDataFrame([("completed", ["a"], {"a": "x"}), ("completed", ["a", "b"], {"a": "x"}), ("partial", ["a"], {"a": "x"}), ("completed", ["a"], None)], "status string, block_ids array<string>, translations map<string,string>")
    assert [r.complete for r in state.resumable(b).collect()] == [True, False, False, False]


def test_tables_change(spark):
    old = spark.createDataFrame([(1, None), (2, "x")], "job_id int, a string")
    assert [(r.a, r.b) for r in state.with_new_columns(old, {"a": F.lit("d"), "b": F.lit(0)}).collect()] == [("d", 0), ("x", 0)]
    assert state.insert_missing(old, spark.createDataFrame([(2, "n"), (3, "n")], "job_id int, a string"), "job_id").count() == 3
    assert sorted(r.a for r in state.replace_issues(old.fillna("o"), spark.createDataFrame([(1, "new")], "job_id int, a string"), old.where("job_id = 1")).collect()) == ["new", "x"]


def test_runs_and_details(spark):
    logs = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "reprocess", 2), (1, 3, "b", 3), (2, 4, "c", 1)], "job_id int, id int, stage string, created_at int")
    got = {r.id: r.is_current for r in state.current_run(logs, "job_id", ["created_at", "id"], F.col("stage") == "reprocess").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}
    assert {r.job_id: r.stage for r in state.latest(logs, "job_id", ["created_at", "id"], ["stage"]).collect()} == {1: "b", 2: "c"}
    jobs = spark.createDataFrame([(1,), (3,)], "job_id int")
    d = {r.job_id: r for r in state.details(jobs, logs, jobs.withColumn("m", F.lit(1)), spark.createDataFrame([(1, 9, "e")], "job_id int, id int, code string")).collect()}
    assert [x.stage for x in d[1].logs] == ["a", "reprocess", "b"] and d[1].issues[0].code == "e" and d[3].logs is None


def test_urls_of_services(spark):
    rows = spark.createDataFrame([("https://a.b/x",), ("http://localhost:80/",), ("http://svc.test",), ("http://a.b",), ("https://u:p@a.b",), ("ftp://a",), ("https://",)], "u string")
    assert [r[0] for r in rows.select(state.safe_service_url(rows.u)).collect()] == [True, True, True, False, False, False, False]


def test_reports(spark):
    issues = spark.createDataFrame([(i, "error", "c", "m", i % 3, f"b{i % 7}") for i in range(9)] + [(99, "warning", "d", "m", None, None)], "id int, severity string, code string, message string, page_index int, block_id string")
    got = {r.code: r for r in report.issue_rollup(issues, []).collect()}
    assert got["c"].pages == [1, 2, 3] and got["c"].blocks == ["b0", "b1", "b2", "b3", "b4"] and got["c"]["count"] == 9 and got["d"].blocks == [] and got["d"].pages == []
    df = spark.createDataFrame([("Ab", None), ("x", "cAb"), ("y", "z")], "a string, b string")
    assert report.search(df, " aB ", ["a", "b"]).count() == 2 and report.search(df, " ", ["a"]).count() == 3
    files = spark.createDataFrame([(1, i, n, s, 0) for i, (n, s) in enumerate([("a.pdf", 1), ("b.txt", 1), ("A.PDF", 1), ("c.pdf", 300 << 20), ("a.pdf", 1), ("d.pdf", 2), ("e.pdf", 2)])], "selection int, ord int, name string, size bigint, mtime int")
    assert [r.reason for r in report.intake(files, most_files=3).orderBy("ord").collect()] == [None, "not_pdf", None, "too_large", "duplicate", None, "too_many"]


def test_quality_status(spark):
    issues = spark.createDataFrame([(1, "error"), (1, "warning"), (2, "warning")], "doc_id int, severity string")
    got = {r.doc_id: (r.passed, r.status) for r in quality.passed(issues, spark.range(1, 4).select(F.col("id").cast("int").alias("doc_id"))).collect()}
    assert got == {1: (False, "needs_review"), 2: (True, "completed"), 3: (True, "completed")}
    usage = spark.createDataFrame([("j", 100, 40, 140, True), ("j", 32, 10, 42, False)], "job string, input_tokens int, output_tokens int, total_tokens int, token_usage_available boolean")
    assert documents.sum_usage(usage, ["job"]).first()[1:] == (132, 50, 182, True)


# ------------------------------------------------------------------------------------------- sources, sinks


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "."), c)
    return out.getvalue()


def test_service_results():
    items = [{"type": "text", "bbox": [0, 0, 1, 1], "page_idx": 0}, {"type": "no place"}]
    z = archive(**{"deep/long__md": "no", "a__md": "# yes", "x_content_list__json": json.dumps(items), "x_content_list_v2__json": "[]"})
    assert scans.read_result(z) == ("# yes", items[:1])
    nested = json.dumps({"results": [{"deep": {"md_content": "text"}}, {"content_list": [{"bad": 1}]}, {"other": items}]}).encode()
    assert scans.read_result(nested) == ("text", items[:1])
    with pytest.raises(ValueError):
        scans.read_result(b"{}")


def test_items_to_blocks(spark):
    items = [{"type": "table_caption", "text": "", "table_body": "<table><tr><td>a</td></tr></table>", "bbox": [0, 0, 500, 500], "page_idx": 0}, {"type": "title", "text": " <b>T</b> ", "bbox": [0, 500, 1000, 520], "page_idx": 0}, {"type": "text", "text": "lost", "bbox": [0, 0, 1, 1], "page_idx": 9}, {"type": "text", "text": "x", "bbox": [1, 2], "page_idx": 0}, {"type": "image", "image_caption": ["c1", "c2"], "bbox": [0, 0, 10, 10], "page_idx": 0}]
    docs = spark.createDataFrame([(1, json.dumps(items))], "doc_id int, items string")
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id int, page_index int, width double, height double")
    got = {r.id: r for r in scans.layout_from_items(docs, pages).collect()}
    assert {k: (r.source_text, r.region_type, r.x1, r.bottom) for k, r in got.items()} == {"p0001-m0001": ("a", "table", 300.0, 400.0), "p0001-m0002": ("T", "heading", 600.0, 416.0), "p0001-m0005": ("c1\nc2", "chart", 6.0, 8.0)}
    assert got["p0001-m0001"].table_html.startswith("<table") and got["p0001-m0002"].font_size == 16.0


def test_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"plain"}.items():
        (tmp_path / name).write_bytes(data)
    found = scans.files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.reject for r in scans.uploads(found).collect()} == {"a.pdf": None, "b.pdf": "not_pdf"}

    def parse(data):
        if not data.startswith(b"%PDF"):
            raise ValueError
        return [{"page_index": 0, "id": "p0001-b0001", "source_text": "x", "x0": 0.0, "top": 0.0, "x1": 1.0, "bottom": 1.0, "font_size": 9.0, "source_type": "native"}]

    got = scans.native_blocks(found, parse, lambda d: [{"page_index": 0, "x1": 600.0, "bottom": 800.0}])
    assert sorted((r.path[-5:], r.source_type) for r in got.collect()) == [("a.pdf", "native"), ("b.pdf", "page")]
    replies = scans.parsed_documents(found, lambda data, how: json.dumps({"markdown": how}).encode(), "txt")
    assert {r.markdown for r in scans.result_items(replies).collect()} == {"txt"}
    regions = found.select("path", F.lit("r").alias("id"), F.lit(0).alias("page_index"), *(F.lit(0.0).alias(c) for c in ("x0", "top", "x1", "bottom")))
    assert scans.rendered_regions(found, regions, lambda d, r, n: [b"png"] * len(r)).count() == 2
    drawn = sinks.render(found.where("length > 0"), regions, lambda data, plan: data + b"!" * len(plan))
    assert {bytes(r.result) for r in drawn.collect()} == {b"%PDF-1.7 x!", b"plain!"}


def test_written_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "job_id int, x string"), p)
    sinks.write_partitions(spark.createDataFrame([(2, "c")], "job_id int, x string"), p)
    assert sorted((r.job_id, r.x) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c")]
    q = str(tmp_path / "q")
    for _ in range(2):
        sinks.write_new(spark.range(2), q)
    assert spark.read.parquet(q).count() == 4
    assert sinks.move_file(spark, q, str(tmp_path / "sub" / "q2")) and spark.read.parquet(str(tmp_path / "sub" / "q2")).count() == 4


def test_drawing(spark):
    rows = [(1, "a", 0, "x", "native", None), (1, "b", 0, "x", "vision", None), (1, "c", 0, "x y", "native", None), (1, "d", 0, "x", "native", None), (1, "e", 0, "x", "native", "keep")]
    df = spark.createDataFrame(rows, "doc_id int, id string, page_index int, source_text string, source_type string, preserve_reason string")
    df = df.withColumns({"fragment_confidence": F.lit(1.0), "region_type": F.lit("body"), "font_size": F.lit(10.0), "font_weight": F.lit(700), "alignment": F.lit("left"), "x0": F.lit(-5.0), "top": F.lit(10.0), "x1": F.lit(100.0), "bottom": F.lit(24.0), "mask_bbox": F.lit(None).cast("struct<x0:double,top:double,x1:double,bottom:double>")})
    said = spark.createDataFrame([(1, "a", "new"), (1, "b", "new"), (1, "c", " <i>x</i> y"), (1, "d", " ")], "doc_id int, id string, target_text string").withColumn("target_text", F.when(F.col("id") == "c", "x  y").otherwise(F.col("target_text")))
    out = sinks.drawing_outcome(df, said)
    assert {r.id: r.outcome for r in out.collect()} == {"a": "redact", "b": "mask", "c": "unchanged", "d": "missing", "e": "preserved"}
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id int, page_index int, width double, height double")
    assert sinks.redactions(out, pages).first().box.x0 == 0.0 and round(sinks.masks(out, pages, attempt=1).first().mask.width, 2) == 145.0
    assert out.first().plan.bold is True


# --------------------------------------------------------------------------------------------------- pixels


def lines_image(columns, rows, width, height, shade=0, ground=255):
    im = np.full((height, width, 3), ground, np.uint8)
    for c in columns:
        im[:, c] = shade
    for r in rows:
        im[r] = shade
    return im


def test_axis_boundaries():
    im = lines_image([0, 200, 300, 399], [0, 60, 119], 400, 120)
    xs, score = pixels.axis_boundaries(im, True, 3)
    assert abs(xs[1] - 200) <= 2 and abs(xs[2] - 300) <= 2 and score >= 0.4
    assert pixels.axis_boundaries(np.full((120, 400, 3), 255, np.uint8), True, 3) == ([], 0.0)
    light = lines_image([0, 100, 199], [0, 50, 99], 200, 100, shade=255, ground=225)
    assert len(pixels.axis_boundaries(light, True, 2)[0]) == 3
    broken = np.full((100, 200, 3), 255, np.uint8)
    broken[::5, 100] = 0
    assert pixels.axis_boundaries(broken, True, 2)[0] == []


def test_recovered_table():
    cells, rows, columns = tables.grid("<table><tr><th>A</th><th>B</th></tr><tr><td>c</td><td>d 1</td></tr></table>")
    im = lines_image([8, 100, 192], [6, 50, 94], 200, 100)
    im[6:50, 8:192] = np.where(im[6:50, 8:192] == 0, 0, (60, 60, 160))
    got, why = pixels.recover_table("t", 0, (0.0, 0.0, 200.0, 100.0), cells, rows, columns, im, (0.0, 0.0, 200.0, 100.0))
    assert why is None and [g["id"] for g in got] == [f"t-c{i:04d}" for i in range(1, 5)]
    assert got[0]["text_grey"] == 1.0 and got[3]["text_grey"] == 0.0 and abs(got[0]["x0"] - 8) <= 4 and got[3]["font_size"] <= 8
    assert pixels.recover_table("t", 0, (0.0, 0.0, 200.0, 100.0), cells, rows, columns, np.full((100, 200, 3), 255, np.uint8), (0.0, 0.0, 200.0, 100.0))[1]
    assert pixels.recover_table("t", 0, (300.0, 0.0, 500.0, 100.0), cells, rows, columns, im, (0.0, 0.0, 200.0, 100.0))[1]


def test_losses_and_grounds(spark):
    before = np.full((60, 80, 3), 255, np.uint8)
    before[10:50, 10:70] = (200, 30, 30)
    after = np.full_like(before, 255)
    color, dark = pixels.graphic_loss(before, after)
    assert color > 0.2 and dark > 0.05 and pixels.graphic_loss(before, before) == (0.0, 0.0)
    assert pixels.change_outside(before, after, (80, 60), [(10, 10, 70, 50, "native")]) == 0.0 < pixels.change_outside(before, after, (80, 60), [])
    assert pixels.change_outside(before, after[:10], (80, 60), []) == 1.0
    assert pixels.text_ground(np.full((50, 50, 3), (224, 240, 240), np.uint8), (10, 10, 40, 20)) == (224 / 255, 240 / 255, 240 / 255)
    assert pixels.rim_ground(np.full((50, 50, 3), (250, 250, 250), np.uint8), (0, 0, 1000, 1000)) == (250 / 255,) * 3
    flat = [(1, *map(int, a), *map(int, b)) for a, b in zip(before.reshape(-1, 3), after.reshape(-1, 3), strict=True)]
    r = pixels.exploded_loss(spark.createDataFrame(flat, "k int, r0 int, g0 int, b0 int, r1 int, g1 int, b1 int"), ["k"]).first()
    assert (r.color_loss, r.dark_loss) == (color, dark)


@pytest.mark.parametrize("kind,step", [(0, 1), (2, 3), (6, 4)])
def test_png(kind, step):
    rng = np.random.default_rng(kind)
    im = rng.integers(0, 256, (7, 5, step), dtype=np.uint8)
    raw = b""
    before = np.zeros(5 * step, np.int64)
    for y in range(7):
        how = y % 5
        line = im[y].ravel().astype(np.int64)
        left = np.concatenate([np.zeros(step, np.int64), line[:-step]])
        corner = np.concatenate([np.zeros(step, np.int64), before[:-step]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        raw += bytes([how]) + bytes(((line - [0 * line, left, before, (left + before) // 2, paeth][how]) % 256).tolist())
        before = line
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (pixels.read_png(data) == (im[:, :, :3] if step > 1 else im.repeat(3, 2))).all()


def test_html_grid():
    cells, rows, columns = tables.grid("<table><tr><th rowspan=2>a</th><th colspan='2'>b</th></tr><tr><td>c</td><td>d<br>e</td></tr><tr><td>f</td><td>g</td><td>h</td></table>")
    assert (rows, columns) == (3, 3) and [(c["row"], c["column"]) for c in cells] == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert cells[3]["source_text"] == "d\ne" and tables.grid("no table") == ([], 0, 0) and tables.has_table("<Table></TABLE>") and not tables.has_table("<table>")


# --------------------------------------------------------------------------------------------------- streams


def test_stream(spark, tmp_path):
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id as event_id", "timestamp_seconds(id * 600) as ts", "id % 3 as user_id", "case when id % 10 = 9 then 'error' when id % 10 = 4 then 'completed' else 'view' end as event_type", "1.0D as value", "'{}' as props")
    src = str(tmp_path / "in")
    rows(0, 40).coalesce(1).write.parquet(src)
    for first in (True, False):
        if not first:
            rows(40, 60).coalesce(1).write.mode("append").parquet(src)
        stream.keep_newest(stream.event_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"], ["ts", "event_id"]).awaitTermination()
    got = {r.user_id: r.event_id for r in stream.read_newest(spark, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"]).collect()}
    assert got == {0: 57, 1: 58, 2: 59}
    q = stream.windowed_counts(stream.deduplicated(stream.event_stream(spark, src)), late=None).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(events) from counts").first()[0] > 0
    q = stream.status_machine(stream.event_stream(spark, src)).writeStream.format("memory").queryName("status").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.user_id: r for r in spark.sql("select * from status where events = 20").collect()}
    assert set(last) == {0, 1, 2} and all(r.restarts == 2 for r in last.values())
    spark.sparkContext.setCheckpointDir(str(tmp_path / "settled"))
    rows(60, 70).coalesce(1).write.mode("append").parquet(src)
    stream.keep_newest(stream.event_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"], ["ts", "event_id"]).awaitTermination()
    before = sorted(map(tuple, stream.read_newest(spark, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"]).collect()))
    stream.settle_newest(spark, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"])
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert sorted(map(tuple, stream.read_newest(spark, str(tmp_path / "out"), ["user_id"], ["ts", "event_id"]).collect())) == before
