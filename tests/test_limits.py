"""Inputs beyond the sizes at which operators once stopped."""

from pyspark.sql import functions as F

from siftweb.operators import graph, media, rules
from siftweb.functions.arrow import find_all
from siftweb.sources.pages import read_sitemaps


def test_jpeg_with_long_padding(spark):
    frame = b"\xff\xc0\x00\x11\x08\x01\x40\x02\x80" + b"\x00" * 16
    for padding in (0, 1, 600, 5000):
        data = b"\xff\xd8" + b"\x00" * padding + b"\xff\xe0\x00\x04\x01\x02" + frame
        got = spark.createDataFrame([(bytearray(data),)], "data binary").select(media.image_dimensions(F.col("data")).alias("d")).first()["d"]
        assert (got["width"], got["height"]) == (640, 320)


def test_paging_chain_of_300_steps(spark):
    links = spark.range(300).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    starts = spark.createDataFrame([(0,), (250,)], "node long")
    chain = graph.next_chain(links, starts)
    assert {r["start"]: r["n"] for r in chain.groupBy("start").agg(F.count("*").alias("n")).collect()} == {0: 301, 250: 51}
    assert graph.next_chain(links, starts, 12).count() == 24
    assert {r["stop_reason"] for r in graph.chain_stop_reason(chain, links).collect()} == {"end"}


def test_cycle_ends(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "node long, next long")
    chain = graph.next_chain(links, spark.createDataFrame([(0,)], "node long"))
    assert sorted((r["node"], r["dist"]) for r in chain.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert graph.chain_stop_reason(chain, links).first()["stop_reason"] == "loop"


def test_task_chain(spark):
    tasks = spark.createDataFrame([(i, "failed" if i == 0 else "pending", 0, 0, [i - 1] if i else []) for i in range(12)],
                                  "id long, status string, retry_count int, max_retries int, depends_on array<long>")
    assert graph.fail_cascade(tasks).filter("status = 'failed'").count() == 12


def test_sitemap_with_many_entries(spark):
    text = "".join(f"<loc>https://h/{i}</loc>" for i in range(3500))
    files = spark.createDataFrame([("h", "https://h/sitemap.xml", text)], "site string, url string, text string")
    roots = files.select("site", "url")
    assert read_sitemaps(files, roots).count() == 3500
    assert read_sitemaps(files, roots, most=3000).count() == 3000


def test_text_of_an_element_that_is_never_closed():
    page = "<p class=a>" + "x" * 5000
    assert find_all(page, [("p.a", "text"), ("p", "class")]) == [["x" * 5000], ["a"]]
    assert len(find_all(page, [("p", "text")], unclosed=2000)[0][0]) == 2000


def test_broken_plugin_is_named(spark):
    def broken(pages):
        raise ValueError("no such column")

    rules.register_extractor("broken", 5, broken)
    try:
        assert rules.plugin_sources(spark.range(1)) == [] and rules.PLUGIN_PROBLEMS == {"broken": "no such column"}
    finally:
        rules._PLUGINS.pop("broken")


def test_first_in_order(spark):
    frame = spark.range(2000).select(F.concat(F.lit("https://www.example.com/"), F.format_string("%05d", (F.col("id") * 7) % 2000)).alias("url")).repartition(5)
    got = sorted(r["url"] for r in graph.first_in_order(frame, "url", 150).collect())
    assert got == [f"https://www.example.com/{i:05d}" for i in range(150)]


def test_small_files_of_wide_rows_are_not_broadcast(spark, tmp_path):
    from siftweb.session import apply_defaults

    spark.range(2000).write.parquet(str(tmp_path / "t"))
    small = apply_defaults(spark).read.parquet(str(tmp_path / "t"))
    wide = small.select("id", F.repeat(F.lit("<p>x</p>"), 1000).alias("html"))
    joined = small.join(wide, "id")
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
