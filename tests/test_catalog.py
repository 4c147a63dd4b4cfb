"""Catalogue queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["host_overview", "canonical_urls", "resolve_links", "page_text", "anchors", "link_filter", "media_labels", "media_tags", "risk_findings",
         "lexicon_scores", "robots_check", "legal_seeds", "bfs_levels", "next_chain", "assemble_book", "task_cascade", "near_pairs", "download_verdict",
         "hls_segments", "dash_segments", "rate_audit", "stream_new_urls", "upsert_items", "rule_matches", "media_frontier",
         "risk_scan_job", "download_audit_job", "merged_stats", "new_media", "decoded_bodies", "task_export", "paginate_rules", "dash_best",
         "hit_batches", "near_groups", "crawl_audit_job", "book_job", "sitemap_addresses", "report_table", "filter_file", "queue_file", "heading_lines", "download_records"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    problem, _ = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
    assert not problem


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(NAMES) <= set(sql)
