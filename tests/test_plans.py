"""What the plans must look like at any size: joins by key, narrow scans, filters at the scan, no Python where none is due."""

import os

import pytest

import __spark_entry__ as entry
from foliograph.operators import translation

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
SPATIAL = ["fusion_relabel", "fusion_append", "coarse_image_tables", "region_routing", "matching_regions", "containing_cell", "characters_in_box", "native_coverage", "uncovered_words", "inferred_cells", "supported_cells", "duplicate_overlay", "residual_best_block"]
#: What only Python can do: decode every HTML reference, NFKC, parse HTML, call services, renderers and parsers, read pixels, visit lines that change on the way.
PYTHON = {"decoded_references", "strip_markup", "drawing_outcomes", "layout_from_items", "nfkc_names", "html_table_cells", "translated_batches", "resumed_batches", "retranslated", "shortened", "translated_names", "service_replies", "scanned_files", "region_crops",
          "grid_boundaries", "page_differences", "most_change", "dominant_grounds", "recovered_tables", "wrapped_texts", "orphan_merges"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPATIAL)
def test_places_are_joined_by_page(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "NestedLoop" not in text and "Cartesian" not in text and "doc_id" in text


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline" and n not in PYTHON))
def test_the_core_stays_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
    if name != "glossary_snapshot":  # all pairs are its result
        assert "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "memory")
    spark.createDataFrame([("h", "s", "t", "en", "zh", "p", "m", "j", 1)], "source_hash string, source_text string, target_text string, source_language string, target_language string, policy_fingerprint string, model string, last_job_id string, occurrences bigint").write.parquet(path)
    blocks = spark.createDataFrame([("s",)], "source_text string")
    df = translation.memory_lookup(blocks, spark.read.parquet(path), "en", "zh", "p")
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    scan = text[text.index("/memory]") :]
    assert "EqualTo(policy_fingerprint,p)" in scan and "EqualTo(source_language,en)" in scan
    assert "occurrences" not in scan and "last_job_id" not in scan
    wide = plan(entry.queries()["batch_key_sha256"](spark, DATA))
    assert "n_chars" not in wide.split("ReadSchema")[-1]
