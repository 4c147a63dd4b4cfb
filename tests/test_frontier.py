"""Walks move no links for a small frontier."""

from pyspark.sql import functions as F

from siftweb.operators import graph


def _walks(spark, monkeypatch):
    """Results of both walks and the plans they checkpoint."""
    plans = []
    keep = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    links = spark.createDataFrame([("a", "b", False), ("a", "b", False), ("b", "c0", True), ("c0", "d", False), ("d", "e", False), ("e", "c0", True), ("x", "y", True), (None, "z", True)],
                                  "src string, dst string, paging boolean")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    found = graph.media_frontier(links.filter(~F.col("paging")), links.filter("paging"), seeds, 2)
    levels = graph.bfs_crawl(links, seeds, 2)
    return {(r.url, r.depth) for r in found.collect()}, {(r.url, r.depth) for r in levels.collect()}, plans


def test_links_stay_where_they_are(spark, monkeypatch):
    found, levels, plans = _walks(spark, monkeypatch)
    assert found == {("a", 0), ("b", 1), ("c0", 1), ("d", 2)} and levels == {("a", 0), ("b", 1), ("c0", 2)}
    read = [p for p in plans if "src" in p]
    assert read and not any("hashpartitioning(src" in p for p in read)


def test_a_large_frontier_is_not_broadcast(spark, monkeypatch):
    small = _walks(spark, monkeypatch)
    monkeypatch.setattr(graph, "FRONTIER_BYTES", 0)
    large = _walks(spark, monkeypatch)
    assert large[:2] == small[:2] and any("hashpartitioning(src" in p for p in large[2])
