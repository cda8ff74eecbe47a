"""Text rules, quality rules, translation memory and replies on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as t
from foliograph.functions import values as v
from foliograph.operators import quality, translation
from foliograph.operators.external import Busy, dictionary_translator, passthrough, residual_blocks, seen_blocks, translate_batches, translate_halving, usage, with_retries


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_problems_of_a_translation(spark):
    rows = spark.createDataFrame([(1, "12.1%", "12.7%"), (2, "テスト Type-C", "测试 Type-C カ"), (3, "R-F775 of 3", "R-F775 的 3"), (4, "the Volume", "the 容量"), (5, "1,000 and 2", "2 と 1000")], "k int, source_text string, target_text string")
    got = {r.k: (r.residue, r.english, r.numbers) for r in quality.translation_problems(rows, ["the", "volume"]).collect()}
    assert got == {1: (False, "", True), 2: (True, "", False), 3: (False, "", False), 4: (False, "the", False), 5: (True, "", False)}
    codes = sorted((r.k, r.code) for r in quality.translation_issues(quality.translation_problems(rows, ["the"]), ["k"]).collect())
    assert codes == [(1, "number_mismatch"), (2, "script_residue"), (4, "generic_english"), (5, "script_residue")]


def test_protected_terms_do_not_count_as_residue(spark):
    rows = spark.createDataFrame([("x", "メイ 公司")], "source_text string, target_text string")
    assert not quality.translation_problems(rows, [], F.array(F.lit("メイ"))).first().residue


def test_residuals(spark):
    texts = ["Coverlay", "coverlay", " ", "R&D", "FR-4", "UL94", "IPC 6013", "Low Dk", "Cu", "5 mil", "10 µm", "カバーレイ", "fuzzy text", "Volume", "Panasonic", "Du Pont", "Acme®", "term part", "12%", "Tg C", "T"]
    res = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc_id int, ord int, text string")
    terms = spark.createDataFrame([(1, "a Term part of it")], "doc_id int, term string")
    ctx = spark.createDataFrame([(1, "Du Pont Co., Ltd."), (1, "plain")], "doc_id int, source_text string")
    kept = quality.kept_residuals(res, terms, ctx, ["coverlay", "volume"], ["fuzzy"])
    assert sorted(r.text for r in kept.collect()) == sorted(["Coverlay", "カバーレイ", "Volume", "12%", "10 µm"])
    assert quality.surviving(res, kept).count() == 6


@pytest.mark.parametrize("text,keep", [("R&D", True), ("Low Dk FPC", True), ("High Price", False), ("ABC-1.2/X", True), ("Type-C PD", True), ("well-known", False), ("see ISO 9001", True), ("ISO 漢字", False), ("[Tg ppm", True), ("Df value", False), ("Sn", True), ("3 mm/5 mil", True), ("mm", False), ("5 apples", False), ("A", False)])
def test_models_and_standards(spark, text, keep):
    assert one(spark, F.coalesce(t.model_or_standard(F.lit(text)), F.lit(False)))[0] is keep


@pytest.mark.parametrize("text,proper", [("Acme Corp.", True), ("Total", False), ("market size forecast X", False), ("DUPONT", True), ("漢字 Acme", False), ("lower words", False), ("with Name inside", True), ("12 34", False)])
def test_chart_names(spark, text, proper):
    assert one(spark, t.chart_proper_name(F.lit(text), ["total"], ["market size forecast"]))[0] is proper


def test_joined_lines(spark):
    lines = F.array(*map(F.lit, ["First line.", "Next starts", "and goes on", "漢字", "続き", "• item", "  ", "- dash"]))
    assert one(spark, t.join_lines(lines))[0] == "First line.\nNext starts and goes on漢字続き\n• item\n- dash"


def test_markup_and_lines(spark):
    assert one(spark, t.strip_markup(F.lit("<td>a &amp;lt; b</td><td>  c\t d </td>")), t.normalize_cell(F.lit(" a 　 b \n\n c ")))[:] == ("a &lt; b\nc d", "a b\nc")
    assert one(spark, t.decode_all_references(F.lit("&eacute;&#8364;")))[0] == "é€"


def test_file_names(spark):
    name = lambda stem, lang: t.result_file_name(F.lit(stem), F.lit(lang), t.utf8_cut(240))
    got = one(spark, name("`Plan:A.PDF`", "zh-CN"), name("说明书 中文版", "zh-CN"), name("x_EN", "en"), name("..", "en"), name("図" * 200, "ja"), name("a  b", "xx"))
    assert got[:4] == ("Plan_A_cn.pdf", "说明书_cn.pdf", "x_en.pdf", None) and len(got[4].encode()) <= 255 and got[5] == "a b_localized.pdf"
    kept = lambda a, b, terms: t.kept_name_tokens(F.lit(a), F.lit(b), F.array(*map(F.lit, terms)))
    assert one(spark, kept("Report 2024 ABC rev-2 small Key", "报告 2024", ["key"]))[0] == "报告 2024 ABC rev-2 key"
    same = lambda s, lang: t.name_in_language(F.lit(s), F.lit(lang), "说书")
    assert one(spark, same("说明", "zh-CN"), same("說明", "zh-CN"), same("カ", "ja"), same("Plan", "en"), same("Plan 図", "en"), same("x", "fr"))[:] == (True, False, True, True, False, False)
    safe = lambda a, b: t.name_or_original(F.lit(a), F.lit(b), F.lit("zh-CN"))
    assert one(spark, safe("说明书", "Manual"), safe("说明 A1", "说明 B"), safe("Plan", "计划"))[:] == ("说明书", "说明 B", "计划")
    assert one(spark, t.nfkc(F.lit("ＡＢ１")))[0] == "AB1"


def test_candidates(spark):
    ask = lambda s, n: t.glossary_candidate(F.lit(s), F.lit(n))
    assert one(spark, ask("term", 2), ask("term", 1), ask("Term", 1), ask("a1", 1), ask("x", 9), ask("A. sentence", 5), ask("y" * 61, 5), ask("好。", 5))[:] == (True, False, True, True, False, False, False, False)


def test_json_and_terms(spark):
    body = t.json_body(F.lit('Here: {"a": {"b": 1}} done'))
    assert one(spark, body, t.json_body(F.lit('```json\n{"a":1}\n```')))[:] == ('{"a": {"b": 1}}', '{"a":1}')
    assert one(spark, t.protected_terms(F.lit("a，b, ,c\nd")))[0] == ["a", "b", "c", "d"]
    assert one(spark, t.safe_error(F.lit("  "), F.lit("TypeError")), F.length(t.safe_error(F.lit("x" * 900), F.lit("E"))))[:] == ("TypeError", 500)


def test_instruction(spark):
    policy = F.struct(F.lit("auto").alias("source_language"), F.lit("zh-CN").alias("target_language"), F.lit(True).alias("names"), F.lit(False).alias("models"), F.array(F.lit("X1")).alias("protected_terms"))
    glossary = F.array(F.struct(F.lit("long term").alias("source"), F.lit("T").alias("target")))
    assert one(spark, t.instruction(policy, glossary, {"names": "Keep names.", "models": "Keep models."}))[0] == "auto -> zh-CN\nKeep names.\nkeep: X1\nlong term => T"


def test_keys_and_formats(spark):
    import hashlib

    key = v.memory_key(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))
    assert one(spark, key)[0] == hashlib.sha256(b"a\0b\0c\0d").hexdigest()
    got = one(spark, v.human_bytes(F.lit(1023)), v.human_bytes(F.lit(1536)), v.human_bytes(F.lit(5 << 20)), v.human_ms(F.lit(999)), v.human_ms(F.lit(1500)), v.human_ms(F.lit(125000)), v.labelled(F.lit("b"), {"a": "A"}))
    assert got[:] == ("1023 B", "1.5 KB", "5.0 MB", "999 ms", "1.50 s", "2 min 5 s", "b")
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, v.elapsed_ms(ts("2024-01-01 00:00:00.5"), ts("2024-01-02 00:00:01")), v.elapsed_ms(ts("2024-01-02"), ts("2024-01-01")), v.elapsed_ms(F.lit(None).cast("timestamp"), ts("2024-01-01")), v.archive_name(F.lit("j"), ts("2024-01-02 03:04:05")))[:] == (86400500, 0, 0, "legacy/j-20240102T030405Z.pdf")
    policy = F.struct(F.lit(2).alias("b"), F.lit("x").alias("a"))
    assert one(spark, v.policy_fingerprint(policy, ["b", "a"]))[0] == hashlib.sha256(b'{"a":"x","b":2}').hexdigest()


def memory(spark, rows):
    return spark.createDataFrame(rows, "source_hash string, source_text string, target_text string, source_language string, target_language string, policy_fingerprint string, model string, last_job_id string, occurrences bigint")


def test_memory(spark):
    m = memory(spark, [("h", "seen", "T", "en", "zh", "p1", "m", "j", 3), ("g", "other policy", "T", "en", "zh", "p2", "m", "j", 1), ("f", "blank", " ", "en", "zh", "p1", "m", "j", 1)])
    b = spark.createDataFrame([(1, " seen "), (2, "other policy"), (3, "blank"), (4, "new")], "id int, source_text string")
    got = translation.memory_lookup(b, m, "en", "zh", "p1")
    assert {r.id: r.memory_target for r in got.collect()} == {1: "T", 2: None, 3: None, 4: None}
    assert sorted(r.id for r in translation.memory_misses(got).collect()) == [2, 3, 4]


def test_learning(spark):
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate([("Term", "甲"), ("Term", "乙"), ("Term", "甲"), ("same", "same"), (" ", "x"), ("y", " "), ("long enough", "长")])], "ord int, source_text string, target_text string")
    counted = translation.pair_occurrences(pairs)
    assert {(r.source_text, r.target_text): r.occurrences for r in counted.collect()} == {("Term", "甲"): 2, ("Term", "乙"): 1, ("long enough", "长"): 1}
    settled = translation.settled_pairs(counted)
    assert {r.source_text: (r.target_text, r.occurrences) for r in settled.collect()} == {"Term": ("乙", 3), "long enough": ("长", 1)}
    found = translation.glossary_candidates(settled, "auto").collect()
    assert [(r.source_text, r.confidence, r.status) for r in found] == [("Term", 0.92, "approved")]
    assert translation.glossary_candidates(settled, "off").count() == 0
    old = memory(spark, [(None, "keep", "K", "en", "zh", "p", "m", "j", 2)]).withColumn("source_hash", v.memory_key(F.lit("en"), F.lit("zh"), F.lit("p"), F.col("source_text")))
    again = translation.memory_upsert(translation.memory_upsert(old, settled, "en", "zh", "p", "m2", F.lit("j2")), settled, "en", "zh", "p", "m3", F.lit("j3"))
    assert {r.source_text: (r.target_text, r.occurrences, r.model) for r in again.collect()} == {"keep": ("K", 2, "m"), "Term": ("乙", 6, "m3"), "long enough": ("长", 2, "m3")}


def test_glossary(spark):
    g = spark.createDataFrame([(1, "Term", "old", "c", 1, 1), (2, "Éa", "x", "c", 1, 1)], "id int, source_text string, target_text string, category string, updated_at int, created_at int")
    new = spark.createDataFrame([(0, 7, "TERM", "mid", "k", 5), (1, 8, "term", "new", " ", 6), (2, 9, "éa", "y", "k", 7)], "ord int, id int, source_text string, target_text string, category string, updated_at int")
    got = {r.id: r[1:] for r in translation.glossary_upsert(g, new).select("id", "source_text", "target_text", "category", "created_at").collect()}
    assert got == {1: ("Term", "new", "general", 1), 2: ("Éa", "x", "c", 1), 9: ("éa", "y", "k", 7)}
    snap = translation.glossary_snapshot(spark.createDataFrame([(5,), (5,)], "job_id int"), g).orderBy("rank").collect()
    assert [(r.job_id, r.source_text) for r in snap] == [(5, "Term"), (5, "Éa")]
    ids = spark.createDataFrame([(1,), (77,)], "id int")
    assert [r.id for r in translation.glossary_delete(g, ids).collect()] == [2] and [r.id for r in translation.unknown_ids(g, ids).collect()] == [77]


def test_replies(spark):
    asked = spark.createDataFrame([(b, i, f"id{i}", f"s{i}") for b in range(6) for i in range(2)], "batch int, position int, id string, source_text string")
    back = {0: [("id0", "A"), ("id1", " ")], 1: [("x", "A"), ("y", "")], 2: [("id0", "A")], 3: [("id0", "A"), ("id0", "B")], 4: [("id0", "A"), ("id1", "B"), ("z", "C")], 5: []}
    reply = spark.createDataFrame([(b, i, k, x) for b, items in back.items() for i, (k, x) in enumerate(items)], "batch int, position int, id string, text string")
    got = {(r.batch, r.id): (r.status, r.target_text) for r in translation.resolve_reply(asked, reply, ["batch"]).collect()}
    assert [got[b, "id0"] for b in range(6)] == [("ok", "A"), ("positional", "A"), ("missing", None), ("duplicate", None), ("unknown", None), ("missing", None)]
    assert got[0, "id1"] == ("ok", "s1") and got[1, "id1"] == ("positional", "s1")


def test_repairs(spark):
    rows = spark.createDataFrame([(1, "Volume", "volume", True), (2, "Volume", "Volume", False), (3, "Sales volume", "sales Volume", True), (4, "odd", "odd", True)], "k int, source_text string, target_text string, flagged boolean")
    d = lambda pairs: spark.createDataFrame(pairs, "key string, value string")
    got = {r.k: r.target_text for r in translation.dictionary_repair(rows, d([("sales volume", "销量")]), d([("volume", "量"), ("sales volume", "no")]), F.col("flagged")).collect()}
    assert got == {1: "量", 2: "Volume", 3: "销量", 4: "odd"}
    fixed = {r.k: (r.target_text, r.repaired) for r in translation.table_term_repair(rows, d([("Volume", "量"), ("ODD", "奇")])).collect()}
    assert fixed == {1: ("量", True), 2: ("量", True), 3: ("sales Volume", False), 4: ("奇", True)}
    assert {r.k: r.target_text for r in translation.override(rows.where("k < 3"), d([("x", "y")]).selectExpr("2 as k", "'new' as target_text"), "k", "target_text").collect()} == {1: "volume", 2: "new"}


def test_repair_rounds_stop_when_there_is_nothing_left(spark):
    calls = []
    find = lambda rows: rows.where("n > 0")

    def lower(rows, problems):
        calls.append(problems.count())
        return rows.withColumn("n", F.greatest(F.lit(0), F.col("n") - 1))

    rows = spark.createDataFrame([(1,), (3,)], "n int")
    assert sorted(r.n for r in quality.repair_rounds(rows, find, [lower, lower]).collect()) == [0, 0] and calls == [2, 1, 1]


def test_external_calls(spark):
    b = spark.createDataFrame([(1, 0, f"b{i}", i, f"text {i}") for i in range(5)], "doc_id int, page_index int, id string, reading_order int, source_text string")
    done = spark.createDataFrame([(1, 0, "b0", "kept")], "doc_id int, page_index int, id string, target_text string")
    got = {r.id: r.target_text for r in translate_batches(b, ["doc_id", "page_index"], dictionary_translator({"text 1": "T1", "text 2": " "}), done).collect()}
    assert got == {"b0": "kept", "b1": "T1", "b2": "text 2", "b3": "text 3", "b4": "text 4"}
    payload = translation.payload(b.where("reading_order < 2"), ["doc_id"]).first().payload
    assert payload == '[{"id":"b0","text":"text 0"},{"id":"b1","text":"text 1"}]'
    held = b.withColumns({"preserve_reason": F.when(F.col("id") == "b1", "x"), "fragment_confidence": F.lit(1.0)})
    assert [r.id for r in passthrough(held).collect()] == ["b1"]


def test_batches_are_halved_and_calls_repeated():
    seen, waits = [], []

    def weak(items):
        seen.append(len(items))
        if len(items) > 1 or items[0]["id"] == "3" and seen.count(1) < 3:
            raise Busy(500)
        return {items[0]["id"]: "ok"}, {"input_tokens": 1}

    texts, used, calls = translate_halving(weak, [{"id": str(i), "text": "x"} for i in range(3)])
    assert texts == {"0": "ok", "1": "ok", "2": "ok"} and used == {"input_tokens": 3} and calls == 5

    state = {"n": 0}

    def flaky():
        state["n"] += 1
        if state["n"] < 3:
            raise Busy(503)
        return "done"

    assert with_retries(flaky, sleep=waits.append)() == "done" and waits == [0.5, 1.0]
    with pytest.raises(Busy):
        with_retries(lambda: (_ for _ in ()).throw(Busy(400)), sleep=waits.append)()


def test_usage_and_seen_blocks(spark):
    u = lambda s: usage(F.lit(s))
    rows = one(spark, u('{"usage":{"prompt_tokens":3,"completion_tokens":4}}'), u('{"usage":{"input_tokens":3,"total_tokens":9}}'), u('{"usage":{"prompt_tokens":true}}'), u("{}"))
    assert [tuple(r) for r in rows] == [(3, 4, 7, True), (3, 0, 9, True), (0, 0, 0, False), (0, 0, 0, False)]
    regions = spark.createDataFrame([(1, "r", 0, 10.0, 20.0, 110.0, 120.0), (1, "q", 0, 0.0, 0.0, 9.0, 9.0)], "doc_id int, id string, page_index int, x0 double, top double, x1 double, bottom double")
    items = [(1, "r", 0, "s", "t", [100.0, 200.0, 600.0, 400.0]), (1, "r", 1, "s", "t", [1.0, 1.0, 2.0, 9.0]), (1, "r", 2, "s", " ", [0.0, 0.0, 9.0, 9.0]), (1, "r", 3, "s", "t", [0.0])] + [(1, "q", i, "s", "t", [0.0, 0.0, 500.0, 500.0]) for i in range(25)]
    df = spark.createDataFrame(items, "doc_id int, region_id string, position int, source_text string, target_text string, bbox array<double>")
    got = seen_blocks(df, regions).collect()
    assert [(r.id, r.x0, r.top, r.x1, r.bottom) for r in got] == [("r-v0001", 20.0, 40.0, 70.0, 60.0)]
    assert residual_blocks(df.where("region_id = 'r'"), regions, 2).first().id == "r-q02-v0001"
