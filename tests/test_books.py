"""A small site: chapters, a loop, a numbered guess, noise blocks."""

from pyspark.sql import functions as F

from siftweb.plans import jobs
from siftweb.sources.pages import as_pages

SITE = {
    "/book/1.html": """<html><head><title>第一章 开始_某书_站</title></head><body><nav class="nav">导航</nav><div class="ad">广告</div>
      <div id="content"><p>山风吹过。</p><p>少年上路。</p></div><a id="next" href="2.html">下一页</a></body></html>""",
    "/book/2.html": """<html><head><title>第二章 入城_某书_站</title></head><body><div id="content"><p>城门很高。</p></div><a href="/book/3.html">下一章</a></body></html>""",
    "/book/3.html": """<html><head><title>第三章 收徒</title></head><body><div class="content">他收了徒弟。</div></body></html>""",
    "/loop/1.html": """<html><body><div id="content">循环一</div><a href="/loop/2.html">下一页</a></body></html>""",
    "/loop/2.html": """<html><body><div id="content">循环二</div><a href="/loop/1.html">下一页</a></body></html>""",
    "/guess/1.html": """<html><body><div id="content">甲</div><div class="chapterlist"><a href="/guess/2.html">二</a></div></body></html>""",
    "/guess/2.html": """<html><body><div id="content">乙</div></body></html>""",
}


def test_books(spark):
    base = "http://b.example.com"
    rows = [(i, base + path, html) for i, (path, html) in enumerate(SITE.items())]
    pages = as_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    starts = spark.createDataFrame([(base + p,) for p in ("/book/1.html", "/loop/1.html", "/guess/1.html")], "node string")
    out = jobs.assemble_books(pages, starts)
    texts = {r.book.replace(base, ""): r.text for r in out["texts"].collect()}
    assert texts["/book/1.html"] == "第一章 开始\n\n山风吹过。\n少年上路。\n\n第二章 入城\n\n城门很高。\n\n第三章 收徒\n\n他收了徒弟。\n"
    assert texts["/loop/1.html"] == "循环一\n\n循环二\n"
    assert texts["/guess/1.html"] == "甲\n\n乙\n"
    stops = {r.start.replace(base, ""): (r.pages, r.stop_reason) for r in out["stops"].collect()}
    assert stops == {"/book/1.html": (3, "end"), "/loop/1.html": (2, "loop"), "/guess/1.html": (2, "end")}
    meta = {r.book.replace(base, ""): (r.page_count, r.success_pages, [c.title for c in r.chapters]) for r in out["metadata"].collect()}
    assert meta["/book/1.html"] == (3, 3, ["第一章 开始", "第二章 入城", "第三章 收徒"])
