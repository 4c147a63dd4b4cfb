"""Column functions against the standard library."""

import html as stdhtml
import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from siftweb.functions import arrow, fixed, html, media, urls
from siftweb.operators import media as ops

HOSTS = ["Ex.com", "a.b.Ex.org:80", "h:443", "u:p@h.com:8080", "x@h", "192.168.0.1:81", "ex.com:"]
PATHS = ["", "/", "/a", "/a/b/", "/a/../b", "/a/./b", "/a/b/../../c", "/a//b/c.TAR.Gz", "/.hid", "/x/..", "/p;q=1"]
QUERIES = ["", "?", "?b=2&a=1", "?utm_source=x&a=%20b", "?a&b=", "?gclid=1", "?a=1+2&a=%E4%B8%AD&z=~*", "?a=%zz", "?&&x=1=2"]
REFS = ["", "a", "./a", "../a", "../../a", "../../../a", "/a", "/a/../b", "//o.com/x", "?q=1", "#f", "a?x=1#y", "http://z.com/../a",
        "a/./b/../c", "..", ".", "./", "a//b", "ftp://x/y", "https://q", "/p?#", "b;c", "a/.."]


def sample_urls(n=300):
    rnd = random.Random(1)
    return [f"{rnd.choice(['http', 'https', 'HTTP'])}://{rnd.choice(HOSTS)}{rnd.choice(PATHS)}{rnd.choice(QUERIES)}{rnd.choice(['', '#', '#top', '#a?b'])}"
            for _ in range(n)]


def expected_canonical(url):
    raw = url.strip()
    p = urlparse(raw)
    host = (p.hostname or "").lower()
    if not host:
        return raw
    place = host if not p.port or (p.scheme, p.port) in (("http", 80), ("https", 443)) else f"{host}:{p.port}"
    if p.username:
        place = p.username + (f":{p.password}" if p.password else "") + "@" + place
    kept = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True)
                  if k.lower() not in fixed.STRONG_AD_PARAMS and not k.lower().startswith("utm_"))
    return urlunparse((p.scheme, place, p.path, p.params, urlencode(kept), ""))


def test_canonical_url(spark):
    rows = spark.createDataFrame([(u,) for u in sample_urls() + ["", "abc", "mailto:a@b"]], "u string")
    once = urls.canonical_url(F.col("u"))
    for r in rows.select("u", once.alias("c"), urls.canonical_url(once).alias("twice")).collect():
        assert r.c == (expected_canonical(r.u) if "//" in r.u else r.u)
        assert r.twice == r.c


def test_join_url(spark):
    rnd = random.Random(2)
    bases = sample_urls()
    rows = spark.createDataFrame([(rnd.choice(bases), rnd.choice(REFS)) for _ in range(800)], "b string, r string")
    for r in rows.select("b", "r", urls.join_url(F.col("b"), F.col("r")).alias("j")).collect():
        assert r.j == urljoin(r.b, r.r), (r.b, r.r)


def test_unescape(spark):
    rnd = random.Random(3)
    bits = ["&amp;", "&copy;", "&copy", "&notit;", "&#65;", "&#x4e2d;", "&#128;", "&#0;", "&bogus;", "&", "a", "&lt;b&gt;", "&amp;lt;", "&nbsp",
            "&#xD800;", "&hearts;", "&ampx", "&#1114112;", "&#9;", "&#150;", "&#38;amp;", "; ", "&#"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.unescape(F.col("t")).alias("u"))
    for r in rows.collect():
        assert r.u == stdhtml.unescape(r.t)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_small_functions(spark):
    lit = F.lit
    assert one(spark, urls.format_size(lit(1536))) == "1.5 KB"
    assert one(spark, urls.format_size(lit(32000))) == "31.2 KB"
    assert one(spark, urls.fmt_duration(lit(360000.9))) == "100:00:00"
    assert one(spark, urls.upgrade_thumbnail(lit("http://a/x/thumb/1.jpg"))) == "http://a/x/original/1.jpg"
    assert one(spark, urls.upgrade_thumbnail(lit("http://a/x/Thumb/1.jpg"))) == ""
    assert one(spark, urls.with_param(lit("http://a/b?page=2&z"), lit("page"), lit(3))) == "http://a/b?page=3&z="
    assert one(spark, urls.domain_family(lit("a.b.c.d"))) == ["a.b.c.d", "b.c.d", "c.d"]
    assert one(spark, urls.media_filename(lit("al/b"), lit("t?"), lit(3), lit("image"), lit(".jpg"), lit("http://x/1"))) == "al_b/003_t.jpg"
    assert one(spark, media.kind_of(lit("http://a/x.mp4"), lit("text/html"))) == "video"
    assert one(spark, html.best_srcset(lit("a.jpg 1x, b.jpg 2x, c.jpg 100w"))) == "b.jpg"
    assert one(spark, html.best_srcset(lit("a.jpg, b.jpg"))) == "b.jpg"
    assert one(spark, html.clean_text(lit(" a  b&nbsp;\r\n\r\n\r\n\r\nc "))) == "a b\n\nc"
    assert one(spark, ops.hamming(lit(5), lit(6))) == 2


def test_selectors():
    page = '<div class="list big"><a class="item" href="/1" data-x>One <b>1</b></a></div><a href="/2">Two</a><img src="a.png" id="k">'
    assert arrow.find_values(page, "div.list a.item", "href") == ["/1"]
    assert arrow.find_values(page, "a[href^='/']", "href") == ["/1", "/2"]
    assert [t.split() for t in arrow.find_values(page, "a.item", "text")] == [["One", "1"]]
    assert arrow.find_values(page, "#k", "src") == ["a.png"]
    assert arrow.find_values(page, "a[title]", "href") == []
    assert arrow.find_values(page, "a > b", "href") == []


def test_decode_and_regex(spark):
    rows = spark.createDataFrame([("中文".encode("gb18030"), ""), ("é".encode("latin-1"), "latin-1"), ("é".encode(), None)], "b binary, c string")
    assert [r.t for r in rows.select(arrow.decode_bytes("b", "c").alias("t")).collect()] == ["中文", "é", "é"]
    bad = spark.createDataFrame([("(",), ("a+",), (None,)], "p string").select(arrow.regex_problem("p").alias("m")).collect()
    assert bad[0].m and not bad[1].m and not bad[2].m
