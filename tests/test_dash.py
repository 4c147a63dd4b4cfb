"""Representations and segments of a manifest come out of its row: one parse, no join."""

from siftweb.operators import playlists

MANIFEST = """<MPD mediaPresentationDuration="PT6S"><Period><AdaptationSet mimeType="video/mp4">
  <Representation id="t" bandwidth="5"><SegmentTemplate media="$RepresentationID$-$Time$.m4s" duration="2000" timescale="1000"/></Representation>
  <Representation id="e"><SegmentTemplate media="x$Number$"><SegmentTimeline><S d="0"/></SegmentTimeline></SegmentTemplate></Representation>
  <Representation id="l"><SegmentList><SegmentURL media=""/><SegmentURL media="two.ts"/></SegmentList></Representation>
  <Representation id="s"><BaseURL>one.mp4</BaseURL></Representation><Representation id="n"/></AdaptationSet></Period></MPD>"""


def test_one_row_says_it_all(spark):
    rows = spark.createDataFrame([(1, "http://h/a/m.mpd", MANIFEST), (2, "http://h/b.mpd", "junk")], "doc long, url string, text string")
    reps, segments = playlists.parse_dash(rows, "doc")
    for table in (reps, segments):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Union" not in plan and plan.count("from_xml") + plan.count("xmltostructs") <= 1
    assert sorted(r.id for r in reps.collect()) == ["l", "s", "t"]
    got = sorted((r.rep.ri, r.sequence, r.segment_url, r.duration) for r in segments.collect())
    assert got == [(0, 1, "http://h/a/t-0.m4s", 2.0), (0, 2, "http://h/a/t-2000.m4s", 2.0), (0, 3, "http://h/a/t-4000.m4s", 2.0),
                   (2, 2, "http://h/a/two.ts", 0.0), (3, 1, "http://h/a/one.mp4", 0.0)]
