"""Playlists are read once, by columns over batches of texts."""

from pyspark.sql import functions as F

from siftweb.functions import html
from siftweb.operators import playlists
from siftweb.plans import jobs

ROWS = [
    (1, "http://v/a/i.m3u8", "#EXTM3U\r\n#ext-x-media-sequence: 7\n#EXTINF:2.5,t\n#EXT-X-BYTERANGE:10@5\n s1.ts \n#EXTINF:x,\n#EXT-X-BYTERANGE: 20\ns2.ts s3.ts\n"
                             "#EXT-X-BYTERANGE:9z\ns4.ts\n#EXT-X-BYTERANGE:3 @ 1\n#EXTINF:1e1\ns5.ts\n#EXT-X-ENDLIST"),
    (2, "http://v/b/i.m3u8", '#EXT-X-KEY:METHOD=AES-128,URI="k"\n#EXT-X-MAP:URI="i.mp4"\n#EXT-X-BYTERANGE:4\n../s.ts'),
    (3, "http://v/c/i.m3u8", '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k"\ns.ts'), (4, "http://v/d", " \n"), (5, "http://v/e", None), (6, "http://v/f", "#EXT-X-STREAM-INF:BANDWIDTH=1")]
KINDS = "k long, url string, text string"


def test_segments_of_odd_playlists(spark):
    summary, segments = playlists.parse_hls(spark.createDataFrame(ROWS, KINDS).repartition(1), "k")
    assert sorted(tuple(r) for r in segments.collect()) == sorted([
        (1, "http://v/a/s1.ts", 2.5, 7, 5, 10), (1, "http://v/a/s2.ts", 0.0, 8, 15, 20), (1, "http://v/a/s3.ts", 0.0, 9, None, None),
        (1, "http://v/a/s4.ts", 0.0, 10, None, None), (1, "http://v/a/s5.ts", 10.0, 11, 1, 3), (2, "http://v/s.ts", 0.0, 0, 0, 4)])
    got = {r.k: (r.key_uri, r.live, r.is_master, r.error == "", r.init_uri) for r in summary.collect()}
    assert got == {1: ("", False, False, True, ""), 2: ("http://v/b/k", True, False, True, "i.mp4"), 3: ("http://v/c/k", True, False, False, ""), 6: ("", True, True, True, "")}


def test_lines_are_read_in_one_pass(spark):
    """No expression walks along the lines of a text: one columnar reader gives all."""
    for df in (playlists.parse_hls(spark.createDataFrame(ROWS, KINDS), "k")[1], playlists.hls_segments(spark.createDataFrame(ROWS, KINDS), "k")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and html.LINE_BREAKS not in plan


def test_totals_are_counted_in_the_row(spark):
    totals = playlists.hls_totals(spark.createDataFrame(ROWS, KINDS), "k")
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (r.segments, r.total_duration) for r in totals.collect()} == {1: (5, 12.5), 2: (1, 0.0), 3: (None, None), 6: (None, None)}


def test_inventory_makes_each_text_once(spark):
    texts = spark.createDataFrame(ROWS + [(7, "http://v/g", "<MPD><Period/></MPD>")], KINDS).withColumn("text", F.regexp_replace("text", "seen once", "")).withColumnRenamed("k", "doc")
    out = jobs.playlist_inventory(texts, "doc")
    assert out["hls_segments"]._jdf.queryExecution().optimizedPlan().toString().count("seen once") == 1
    assert {r.doc for r in out["hls"].collect()} == {1, 2, 3, 6} and out["hls_segments"].count() == 6


def test_ranges_beyond_64_bits_are_unreadable(spark):
    most = (1 << 63) - 1
    text = "".join(f"#EXT-X-BYTERANGE:{r}\ns{i}.ts\n" for i, r in enumerate(["5", most, "7", "3@2", "4", f"1@{most}", "9999999999999999999", "6"]))
    rows = playlists.hls_segments(spark.createDataFrame([(1, "http://v/a", text), (2, "http://v/b", text)], KINDS).coalesce(1), "k")
    got = {(r.k, r.sequence): (r.range_offset, r.range_length) for r in rows.collect()}
    none = (None, None)
    assert [got[k, i] for k in (1, 2) for i in range(8)] == [(0, 5), none, none, (2, 3), (5, 4), none, none, (0, 6)] * 2
