"""Plans whose cost a row must not multiply."""

from pyspark.sql import functions as F

from siftweb.functions import urls
from siftweb.functions.multimatch import WordIndex
from siftweb.operators import extract, policy
from siftweb.session import apply_defaults


def test_json_addresses_are_resolved_once(spark):
    text = '{"title": " T ", "items": [{"file": "/a.mp4", "note": "plain", "deep": [{"original": "../b"}]}], "n": 5, "cover": "https://h/c.jpg"}'
    pages = spark.createDataFrame([(1, "https://h/x/y/list", text), (2, "https://h/x", None), (3, "https://h/x", "[")], "page_id long, base_url string, json_text string")
    found = extract.extract_media_json(pages)
    assert {(r["url"], r["kind"], r["title"], r["origin"]) for r in found.collect()} == {
        ("https://h/a.mp4", "video", "T", "json"), ("https://h/x/b", "image", "T", "json:hint"), ("https://h/c.jpg", "image", "T", "json")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("javascript:") == 1


def test_usual_references_are_not_split(spark):
    rows = [("http://h/a/b?q", "c/d.ts?x#f", "http://h/a/c/d.ts?x#f"), ("http://h", "c", "http://h/c"), ("http://h/./b", "c", "http://h/c"), ("http://h/a/b", "/c?", "http://h/c"),
            ("http://h/a/b", "/c/..", "http://h/"), ("http://h/a/b", "//i/c", "http://i/c"), ("http://h/a/b", "https://i/c?", "https://i/c?"), ("http://h/a/b", "http://i/c?", "http://i/c"),
            ("http://h/a/b", "c//d", "http://h/a/c/d"), ("http://h/a/b", "", "http://h/a/b"), (None, "http://i/c", None)]
    df = spark.createDataFrame([(b, r, w) for b, r, w in rows], "base string, ref string, want string")
    for r in df.withColumn("got", urls.join_url(F.col("base"), F.col("ref"))).collect():
        assert r["got"] == r["want"], r


def test_stages_beyond_the_compiler_are_not_fused(spark):
    assert int(apply_defaults(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_words_are_found_by_batches(spark):
    words = {"a": [0], "bc": [1], "bcd": [2], "abcdef": [3], "abcdefg": [4], "中文": [5], "cdefgh": [6]}
    texts = ["abcdefgh", "xbc", "bcd", "b", "c", "abcde", "f", "中", "文中文", None, "", "abcdxyz"]
    found = spark.createDataFrame([(t,) for t in texts], "low string").repartition(2).select("low", WordIndex(words).proposed(F.col("low")).alias("found"))
    for r in found.collect():
        assert r["found"] == sorted(n for w, ns in words.items() for n in ns if w in (r["low"] or ""))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_overlay_is_computed_once(spark):
    hits = spark.createDataFrame([("1:0", "rate_limit", "no more than five", 0.5, "m", "n")], "uid string, category string, text string, confidence double, matched_terms string, context_note string")
    answers = spark.createDataFrame([("1:0", "automation", "l", "n", True, "five", 0)], "uid string, category string, label string, note string, relevant boolean, quote string, intercepted int")
    out = policy.apply_refinements(hits, answers)
    assert {(r["category"], r["confidence"], r["added"], r["quote_dropped"]) for r in out.collect()} == {("rate_limit", 0.5, False, False), ("automation", 0.4, True, False)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
