"""Blocks, places and groups on hand-made pages."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import geometry as g
from foliograph.functions.geometry import Box
from foliograph.operators import blocks as b
from foliograph.operators import documents, grouping, quality, spatial

BOX = "x0 double, top double, x1 double, bottom double"


def edges(spark, rows):
    return spark.createDataFrame([(1, 0, *map(float, r)) for r in rows], f"doc_id int, page_index int, {BOX}")


def block(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id int, page_index int, id string, ord int, source_text string, source_type string, region_type string, {BOX}{extra}")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cell_from_edges_that_are_labelled_wrongly(spark):
    e = edges(spark, [(100, 8, 100.5, 42), (140, 8, 140.5, 42), (98, 10, 142, 10.4), (98, 40, 142, 40.4)])
    t = spark.createDataFrame([(1, 0, "a", 112.0, 20.0, 124.0, 29.0), (1, 0, "b", 300.0, 20.0, 310.0, 29.0)], f"doc_id int, page_index int, id string, {BOX}")
    got = {r.id: r.cell for r in spatial.infer_cells(t, e).collect()}
    assert [round(v) for v in got["a"]] == [100, 10, 140, 40] and got["b"] is None


def test_chart_frames_are_no_grid(spark):
    frame = [(0, 0, 100, 0.5), (0, 80, 100, 80.5), (0, 0, 0.5, 80), (100, 0, 100.5, 80)]
    assert not spatial.credible_grids(edges(spark, frame + [(10, 30, 40, 30.2)])).first().credible
    assert not spatial.credible_grids(edges(spark, frame * 3)).first().credible


def test_repeated_boundaries_are_a_grid(spark):
    rows = [(60 * c, 40 * r, 60 * c + 60, 40 * r + 0.4) for r in range(3) for c in range(3)] + [(60 * c, 40 * r, 60 * c + 0.4, 40 * r + 40) for r in range(3) for c in range(3)]
    got = spatial.credible_grids(edges(spark, rows)).first()
    assert got.credible and (got.vertical, got.horizontal) == (3, 3)


def test_detected_tables(spark):
    stacked = [(1, 1, 0.0, 20.0 * i, 50.0, 20.0 * i + 20) for i in range(4)]
    square = [(1, 2, 50.0 * c, 20.0 * r, 50.0 * c + 50, 20.0 * r + 20) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(stacked + square, f"doc_id int, t int, {BOX}")
    assert {r.t: r.credible for r in spatial.credible_tables(df, ["doc_id", "t"]).collect()} == {1: False, 2: True}


@pytest.mark.parametrize("stroke,fill,line,ground,seen", [(False, True, None, [1.0, 1.0, 1.0], False), (False, True, None, [0.0], True), (False, True, None, [0.8, 0.95, 0.8], False), (True, False, [1.0], None, False), (True, False, [0.5], None, True), (None, None, None, None, True), (True, None, [0.0, 0.0, 0.0, 0.02], None, False), (False, True, None, [0.0, 0.0, 0.0, 0.9], True)])
def test_visible_edges(spark, stroke, fill, line, ground, seen):
    df = spark.createDataFrame([(stroke, fill, line, ground)], "s boolean, f boolean, a array<double>, b array<double>")
    assert df.select(g.visible_edge(df.s, df.f, df.a, df.b)).first()[0] is seen


def test_supported_cells(spark):
    e = edges(spark, [(0, 0, 40, 0.5), (0, 20, 40, 20.5), (0, 0, 0.5, 20), (40, 0, 40.5, 20), (60, 0, 80, 0.5)])
    c = spark.createDataFrame([(1, 0, "in", 0.0, 0.0, 40.0, 20.0), (1, 0, "out", 60.0, 0.0, 100.0, 20.0)], f"doc_id int, page_index int, id string, {BOX}")
    assert {r.id: r.supported for r in spatial.supported_cells(c, e).collect()} == {"in": True, "out": False}


def test_visual_lines_stay_apart(spark):
    rows = [(1, 0, f"l{i}", 50.0, 100.0 + 14 * i, 200.0, 110.0 + 14 * i) for i in range(3)] + [(1, 0, "l0b", 203.0, 101.0, 260.0, 110.5)]
    got = {r.id: r.line for r in grouping.visual_lines(spark.createDataFrame(rows, f"doc_id int, page_index int, id string, {BOX}")).collect()}
    assert got == {"l0": 1, "l0b": 1, "l1": 2, "l2": 3}


def test_orphan_joins_the_line_above(spark):
    rows = [(1, 0, 1, "テスト", 10.0, 10.0, 60.0, 20.0, 1), (1, 0, 2, "図。", 100.0, 10.0, 160.0, 20.0, 1), (1, 0, 3, "ル", 20.0, 23.0, 30.0, 33.0, 1), (1, 0, 4, "字", 120.0, 23.0, 130.0, 33.0, 1), (1, 0, 5, "目", 21.0, 35.0, 31.0, 45.0, 1)]
    df = spark.createDataFrame(rows, f"doc_id int, page_index int, line bigint, text string, {BOX}, boxes int")
    assert {r.line: r.into for r in grouping.merge_orphans(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1}


def test_cell_groups(spark):
    c1, c2 = (0.0, 0.0, 50.0, 20.0), (50.0, 0.0, 99.0, 20.0)
    rows = [(1, 0, "b", 20.0, 12.0, 30.0, 18.0, c1), (1, 0, "a", 20.0, 2.0, 30.0, 8.0, c1), (1, 0, "c", 60.0, 1.0, 70.0, 8.0, c2), (1, 0, "n", 1.0, 1.0, 2.0, 2.0, None)]
    got = grouping.cell_groups(spark.createDataFrame(rows, f"doc_id int, page_index int, id string, {BOX}, cell struct<x0:double,top:double,x1:double,bottom:double>")).orderBy("number").collect()
    assert [[m.id for m in r.members] for r in got] == [["c"], ["a", "b"]]


def test_batches_stay_on_their_page_and_in_their_bounds(spark):
    rows = [(1, p, f"p{p}-{i:03d}", i, "x" * (2500 if i == 3 else 90), 0.0, 0.0) for p in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, id string, reading_order int, source_text string, top double, x0 double")
    got = grouping.greedy_batches(df).collect()
    assert sorted(got) == sorted(grouping.greedy_batches_streamed(df).collect())
    sizes = {}
    for r in got:
        sizes.setdefault((r.page_index, r.batch), []).append(r.id)
    assert all(len(v) <= 24 for v in sizes.values()) and sizes[0, 1] == ["p0-003"] and {p for p, _ in sizes} == {0, 1}


def test_coarse_native_text(spark):
    text = F.lit("a\nb\nc\nd")
    box = Box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(90.0))
    ask = lambda region: quality.coarse_native(text, F.lit(region), F.lit("native"), box, F.lit(10.0))
    assert one(spark, ask("table"), ask("body"))[:] == (False, True)


def test_routes(spark):
    route = lambda s, usable: documents.parser_route(F.lit(s), F.lit(usable), F.lit(True))
    assert one(spark, route("structure-first", True), route("native-first", True), route("native-first", False), route("smart", True))[:] == (True, False, True, True)


def test_fusion_keeps_trusted_pages(spark):
    native = block(spark, [(1, 0, f"n{i}", i, "native text", "native", "body", 0.0, 20.0 * i, 100.0, 20.0 * i + 12) for i in range(3)])
    parsed = block(spark, [(1, 0, "m1", 0, "far away", "mineru", "chart", 300.0, 300.0, 400.0, 400.0), (1, 0, "m2", 1, "over", "mineru", "heading", 0.0, 0.0, 100.0, 12.0), (1, 0, "m3", 2, "cell", "image-table", "table", 300.0, 500.0, 400.0, 520.0), (1, 1, "m4", 3, "next page", "mineru", "body", 0.0, 0.0, 9.0, 9.0)])
    got = {r.id: r.region_type for r in spatial.fuse(native, parsed).collect()}
    assert got == {"n0": "heading", "n1": "body", "n2": "body", "m3": "table", "m4": "body"}


def test_coarse_tables_and_routing(spark):
    parsed = block(spark, [(1, 0, "t", 0, "a\nb\nc\nd", "mineru", "table", 0.0, 0.0, 100.0, 100.0), (1, 0, "s", 1, "a", "mineru", "table", 0.0, 0.0, 100.0, 100.0)]).withColumn("preserve_reason", F.lit(None).cast("string"))
    regions = spark.createDataFrame([(1, 0, "r", 0, 0.0, 0.0, 110.0, 110.0), (1, 1, "q", 0, 0.0, 0.0, 110.0, 110.0)], f"doc_id int, page_index int, id string, ord int, {BOX}")
    marked = spatial.mark_coarse_tables(parsed, regions)
    assert {r.id: r.preserve_reason is not None for r in marked.collect()} == {"t": True, "s": False}
    assert {r.id: r.route for r in spatial.route_regions(regions, marked).collect()} == {"r": "preserved", "q": "safe"}


def granular(spark, rows):
    df = spark.createDataFrame(rows, f"doc_id int, source_text string, {BOX}, geometry_fill_ratio double, pages int, coverage double")
    return documents.granularity(df.withColumns({"preserve_reason": F.lit(None).cast("string"), "fragment_confidence": F.lit(1.0), "page_width": F.lit(595.0), "page_height": F.lit(842.0)})).first()


def test_granularity(spark):
    sparse = granular(spark, [(1, "text", 0.0, 0.0, 460.0, 460.0, 0.08, 1, 1.0)])
    assert not sparse.passed and sparse.unsafe == 1
    assert not granular(spark, [(1, "y" * 360, 0.0, 0.0, 100.0, 20.0, 1.0, 7, 1.0)] * 54).passed
    assert granular(spark, [(1, "y" * 360, 0.0, 0.0, 100.0, 20.0, 1.0, 7, 0.5)] * 54).passed
    assert granular(spark, [(1, "short", 0.0, 0.0, 100.0, 20.0, 1.0, 1, 1.0)] * 5).passed


def test_masks(spark):
    lit = lambda *v: Box(*(F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v))
    none = lit(None, None, None, None)
    m = lambda box, limit, kind, region, h, pad=12.0: b.mask_box(box, limit, F.lit(kind), F.lit(region), F.lit(pad), F.lit(float(h)))
    rows = one(spark, m(lit(100, 20, 140, 32), none, "native", "table", 200), m(lit(100, 20, 140, 32), none, "vision", "body", 200), m(lit(131, 327, 160, 336), lit(85.1, 320.4, 547.1, 466.7), "vision", "body", 595))
    assert [round(v, 2) for v in rows[0]] == [99.55, 167.8, 40.9, 12.4]
    assert [round(v, 2) for v in rows[1]] == [88, 156, 64, 36]
    assert [round(v, 2) for v in rows[2]] == [119, 247, 53, 27.6]


def test_capacity_grows_with_the_box(spark):
    cap = lambda w, h: b.capacity(Box(F.lit(0.0), F.lit(0.0), F.lit(w), F.lit(h)), F.lit("body"))
    small, large, least = one(spark, cap(100.0, 20.0), cap(200.0, 80.0), cap(1.0, 1.0))
    assert 4 <= small < large and least == 4


def test_page_box_from_thousandths(spark):
    box = g.from_thousandths(Box(*map(F.lit, (100.0, 200.0, 600.0, 400.0))), Box(*map(F.lit, (10.0, 20.0, 110.0, 120.0))))
    assert one(spark, *box)[:] == (20.0, 40.0, 70.0, 60.0)


def test_residual_block(spark):
    blocks_ = block(spark, [(1, 0, "b1", 0, "t", "native", "body", 10.0, 10.0, 40.0, 25.0), (1, 0, "b2", 1, "t", "native", "body", 100.0, 10.0, 140.0, 25.0)])
    res = spark.createDataFrame([(1, 0, "r1", 10.0, 10.0, 40.0, 25.0), (1, 0, "r2", 300.0, 10.0, 340.0, 25.0)], f"doc_id int, page_index int, id string, {BOX}")
    assert {r.id: r.block_id for r in spatial.residual_targets(res, blocks_).collect()} == {"r1": "b1", "r2": None}


def test_ordered_rules(spark):
    assert one(spark, b.parsed_region_type(F.lit("Table_Caption")), b.parsed_region_type(F.lit("image_caption")), b.parsed_region_type(F.lit("figure")), b.parsed_region_type(F.lit("caption")))[:] == ("table", "chart", "chart", "caption")
    box = Box(*map(F.lit, (100.0, 20.0, 200.0, 32.0)))
    kind = lambda top_cell: b.region_type(box, F.lit("words"), F.lit(9.0), F.lit(600.0), F.lit(800.0), F.lit(top_cell), F.lit("native"))
    assert one(spark, kind(True), kind(False))[:] == ("table", "header")
    tall = Box(*map(F.lit, (0.0, 0.0, 10.0, 60.0)))
    s = b.stability(tall, F.lit("turned"), F.lit(9.0), F.lit(90), F.lit(1))
    broken = b.stability(box, F.lit("a b c d"), F.lit(9.0), F.lit(0), F.lit(1))
    lone = b.stability(box, F.lit("字"), F.lit(9.0), F.lit(0), F.lit(1))
    assert one(spark, s["confidence"], broken["confidence"], lone["confidence"])[:] == (0.3, 0.4, 0.45)


def test_fit(spark):
    fit = lambda text, h: b.fit(F.lit(text), Box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(h)), F.lit(12.0), F.lit(7.0))
    roomy, tight, never, wide = one(spark, fit("short", 14.0), fit("a" * 40, 20.0), fit("a" * 400, 12.0), fit("漢" * 12, 30.0))
    assert (roomy.font_size, roomy.overflow) == (12.0, False) and 7.0 <= tight.font_size < 12.0 and not tight.overflow
    assert never.overflow and never.font_size == 7.0 and never.at_least and wide.lines == 2


def test_strongest_of_neighbours(spark):
    df = spark.createDataFrame([(1, 4, 0.3), (1, 5, 0.9), (1, 7, 0.9), (1, 12, 0.2)], "k int, position int, score double")
    assert sorted((r.position, r.score) for r in grouping.strongest_of_neighbours(df, ["k"]).collect()) == [(5, 0.9), (12, 0.2)]


def test_median_color_and_first_mode(spark):
    df = spark.createDataFrame([(1, 0, "a", (0.0, 0.5, 1.0)), (1, 1, "b", (1.0, 0.5, 0.0)), (1, 2, "b", None), (1, 3, "a", (0.2, 0.5, 0.9))], "k int, ord int, f string, rgb struct<r:double,g:double,b:double>")
    assert grouping.median_color(df, ["k"]).first()[1:] == (0.2, 0.5, 0.9) and grouping.first_mode(df, ["k"], "f").first().f == "a"
    grey = spark.createDataFrame([([0.5],), ([0.1, 2.0, -1.0, 0.3],), ([0.1, 0.2],)], "c array<double>").select(g.unit_rgb(F.col("c")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in grey] == [(0.5, 0.5, 0.5), (0.1, 1.0, 0.0), None]
