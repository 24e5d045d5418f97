"""Registered queries beside DuckDB at the smallest scale. ``SONDEO_ALL=1`` runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["s01_corpus_scan", "s05_replace_documents", "f01_document_include", "f12_known_errors", "c03_chunk_stats", "c05_neighbour_overlap", "c10_quote_coverage",
          "x04_stems", "x10_command_states", "r01_filtered_dense", "r02_sparse_top_k", "r03_lexical_top_k", "r05_convex_combination", "a9_evaluation_summary",
          "a12_list_metrics", "a28_reference_collections", "a33_latency_stats", "j02_expand_attribution", "j12_assignment_errors", "w04_line_coverage", "w08_pool_ids",
          "l05_rejudge_sample", "u04_overlap_ratio", "j09_hash_diff", "st2_streamed_attribution", "st3_daily_counts"]
NAMES = list(entry.queries()) if os.environ.get("SONDEO_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    _, rows, note = compare(spark, duck, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert note.startswith("ok") or note == "rows only", note


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
