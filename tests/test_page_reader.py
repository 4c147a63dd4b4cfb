"""A page is read once for titles and next links, by selectors that are found under their rarest part."""

import re

from siftweb.functions import arrow
from siftweb.operators import books
from siftweb.sources.pages import as_pages


def test_one_python_pass_over_a_page(spark):
    page = ('<html><head><title>第三章 t_站</title></head><body><div class="x title"><h1> 第一章 </h1></div><nav>n</nav>'
            '<div id="content">甲</div><a class="next" href="2.html">on</a><a href="3.html">下一章</a></body></html>')
    pages = as_pages(spark.createDataFrame([(1, "http://b.example.com/1.html", page)], "page_id long, url string, html string"))
    read = books.read_book_pages(pages)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    calls = re.findall(r"\b((?:select_)?lists\(.*)", "\n".join(line for line in plan.splitlines() if "EvalPython" in line))
    assert len(calls) == 1 and calls[0].count("lists(") == 1, plan[:2000]
    row = read.first()
    assert (row.title, row.body, row.linked) == ("第一章", "甲", "http://b.example.com/2.html")


def test_hooks_and_earlier_steps():
    page = '<h1>a</h1><div class="p q" id="i"><h1 >b<br/></h1><br x=1><img data-srcset="s" srcset=""></div>'
    wanted = [("h1", "text"), (".q h1", "text"), ("div.p#i", "id"), ("div#i.p", "id"), ("[data-srcset]", "srcset"), ("", "text"), ("br", "x"), (".q .q", "id")]
    assert arrow.find_all(page, wanted) == [["a", "b"], ["b"], [], ["i"], ["s"], [], ["1"], []]
