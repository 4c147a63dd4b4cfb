"""Seeds of policy pages are moved once, by start."""

from pyspark.sql import functions as F

from siftweb.functions import lexicon, urls
from siftweb.operators import policy
from siftweb.plans import jobs
from siftweb.session import apply_defaults
from siftweb.sources.pages import as_pages


def test_ranked_with_one_shuffle(spark):
    start = "https://a.example.com/"
    rows = [("a.example.com", start, start + "terms/", "路径词典", "", 7, ""), ("a.example.com", start, start + "terms#x", "页脚链接", "Terms", 1, ""),
            ("a.example.com", start, start + "privacy", "sitemap", "", 3, ""), ("a.example.com", start, start + "x.pdf", "sitemap", "", 2, "no")]
    seeds = spark.createDataFrame(rows, "site string, start_url string, url string, source string, anchor string, pos long, reason string")
    ranked = policy.rank_legal_seeds(seeds, 1)
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    full = ranked._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 1, plan
    got = {r.url: (r.source, r.anchor, r.position, r.picked) for r in ranked.collect()}
    assert got == {start + "terms": ("页脚链接", "Terms", 1, True), start + "privacy": ("sitemap", "", 2, False)}


def test_keys_of_odd_addresses(spark):
    cases = {None: "", " ": "", "HTTP://A.b/x;p=1/?q#f": "http://a.b/x;p=1?q", "https://a.b": "https://a.b/", "//A/b;c": "//a/b", "/x//": "/x", "https://a.b//": "https://a.b"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "url string, want string").withColumn("key", urls.legal_url_key(F.col("url")))
    assert [(r.url, r.key) for r in df.collect()] == [(r.url, r.want) for r in df.collect()]


def test_starts_are_dealt_to_all_cores(spark, monkeypatch):
    apply_defaults(spark)
    line = "You must not use any crawler or spider on this site, which is a line of more than eighty characters."
    rows = [(2 * i + j, f"https://d{i}.example.com/" + path, html) for i in range(60) for j, (path, html) in enumerate(
        [("", '<a href="/terms">Terms of use</a>'), ("terms", f"<body><p>{line}</p></body>")])]
    kept = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df, cut=jobs.cut_lineage: kept.append(cut(df)) or kept[-1])
    out = jobs.policy_screen(as_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "2024-01-01 00:00:00")
    assert kept[0].count() == 60 and kept[0].select(F.spark_partition_id()).distinct().count() > 1
    assert out["seeds"].count() == 60 * len(lexicon.LEGAL_PATHS)
    reports = out["reports"].select("site", "start_url", F.size("pages").alias("pages"), F.size("findings").alias("found"), F.size("skipped").alias("skipped")).collect()
    assert {(r.pages, r.found, r.skipped) for r in reports} == {(1, 1, len(lexicon.LEGAL_PATHS) - 12)}
    assert {(r.site, r.start_url) for r in reports} == {(f"d{i}.example.com", f"https://d{i}.example.com/") for i in range(60)}


def test_usual_paths_are_put_behind_the_root(spark):
    bases = ["https://a.b/", "https://a.b", "http://A.b:80/x/y?q#f", "HTTPS://a.b/", "a.b/x", "", None]
    starts = spark.createDataFrame([("s", b) for b in bases], "site string, start_url string")
    rows = policy.path_seeds(starts).withColumn("path", F.element_at(F.array(*map(F.lit, lexicon.LEGAL_PATHS)), (F.col("pos") - (1 << 41) + 1).cast("int")))
    got = rows.withColumn("want", urls.join_url(F.col("start_url"), F.col("path"))).collect()
    assert len(got) == len(bases) * len(lexicon.LEGAL_PATHS)
    assert all(r.url == r.want for r in got)


def test_blanks_of_every_kind(spark):
    texts = [a + "x \u3000y" + b for a in ["", *urls.BLANKS, urls.BLANKS] for b in ("", " \n", "\u2028\x85\x1c", "\ufeff")] + [" ", "", urls.BLANKS, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("got", urls.trimmed(F.col("t")))
    assert all(r.got == (r.t and r.t.strip()) for r in df.collect())
