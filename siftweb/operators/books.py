"""Paged books: content, titles, next links, ordered assembly."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.functions import arrow, fixed, html, urls
from siftweb.functions.urls import bind

# --- fixed values: where a chapter's text stands, what is noise, how chapters are called
CONTENT_SELECTORS = [
    "#content", "#chaptercontent", "#booktext", "#htmlContent", "#BookText",
    "#nr1", "#txtContent", "#chapterContent", "#read-content", "#book-content",
    ".content", ".chapter-content", ".read-content", ".reader-content",
    ".txtnav", ".book-content", ".article-content", ".entry-content",
    "article", "main",
]
NOISE_SELECTORS = [
    "script", "style", "noscript", "iframe", "ins",
    "nav", "header", "footer", "aside",
    ".nav", ".navbar", ".navigation", ".menu", ".breadcrumb", ".breadcrumbs",
    ".ad", ".ads", ".advert", ".advertisement", ".gg", ".google-ad",
    ".footer", ".header", ".sidebar", ".side", ".toolbar", ".tools",
    ".comment", ".comments", ".share", ".social", ".recommend", ".related",
    ".bottem", ".booklist", ".chapterlist", ".listmain",
    ".notice", ".tips", ".banner", ".copyright",
]
TITLE_SELECTORS = ["h1", ".chapter-title", ".chapterTitle", "#chapter-title", "#chapterTitle", ".bookname h1", ".title h1", "h2.chapter", "h2", "h3"]
NEXT_SELECTORS = ["a#next", "a#nextPage", "a.next", "a.nextpage", "a.next-page", "#next", "#nextPage", "#pb_next", "a[rel='next']",
                  "a:contains('下一页')", "a:contains('下一章')", "a:contains('下一节')", "a:contains('下页')", "a:contains('Next')"]
NEXT_LABEL = r"(?i)^\s*(下一页|下页|下一章|下一节|下一张|后一页|next(\s*page)?|›|»|→|>>)\s*$"
CHAPTER_TEXT = (r"(?i)^\s*(?:正文\s*)?(第[0-9零一二三四五六七八九十百千万两]+[章节回卷篇部集]"
                r"[^\n]{0,40}|chapter\s*\d+[^\n]{0,40})\s*$")


def _block(selector: str, inner: bool) -> tuple[str, int]:
    """Pattern of one simple selector and the group that holds its inside."""
    name = re.escape(selector[1:])
    body = "(.*?)" if inner else ".*?"
    if selector.startswith("."):
        return rf"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*\b{name}\b[^"']*["'][^>]*>{body}</\1\s*>""", 2
    if selector.startswith("#"):
        return rf"""(?is)<(\w+)\b[^>]*\bid\s*=\s*["']{name}["'][^>]*>{body}</\1\s*>""", 2
    tag = re.escape(selector)
    return rf"(?is)<{tag}\b[^>]*>{body}</{tag}\s*>", 1


def _blocks(selectors: Sequence[str], inner: bool) -> Column:
    rows = [(selector.lstrip(".#").lower(), *_block(selector, inner)) for selector in selectors]
    return F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(p).alias("pattern"), F.lit(g).alias("group")) for m, p, g in rows])


def _occurring(markup: Column, blocks: Column) -> Column:
    return bind(F.lower(markup), lambda low: F.filter(blocks, lambda b: F.contains(low, b["marker"])))


def strip_noise(markup: Column, selectors: Sequence[str] = tuple(NOISE_SELECTORS)) -> Column:
    """Noise blocks out, one selector after the other.

    A fold over the selectors whose words occur in the page; the cheap substring test spares most pages most patterns. A removed block
    leaves a blank, so no word comes up that was not there before.
    """
    def strip(raw: Column) -> Column:
        return F.aggregate(_occurring(raw, _blocks(selectors, False)), raw, lambda t, b: F.call_function("regexp_replace", t, b["pattern"], F.lit(" ")))

    return bind(markup, strip)


def book_content(markup: Column, selectors: Sequence[str] = tuple(CONTENT_SELECTORS),
                 noise: Sequence[str] = tuple(NOISE_SELECTORS), min_chars: int = 1) -> Column:
    """Text of the first content block with enough characters, else of the whole page."""
    floor = max(1, min_chars)

    def pick(t: Column) -> Column:
        found = F.aggregate(_occurring(t, _blocks(selectors, True)), F.lit(""), lambda best, b: F.when(
            F.length(best) >= floor, best).otherwise(
            html.prose(F.call_function("regexp_extract", t, b["pattern"], b["group"]))))
        return bind(found, lambda x: F.when(F.length(x) >= floor, x).otherwise(html.prose(t)))

    return bind(strip_noise(markup, noise), pick)


def _wanted(selectors: Sequence[str], attr: str) -> tuple[tuple[str, str], ...]:
    return tuple((s, attr) for s in selectors)


def _plain(selectors: Sequence[str]) -> list[str]:
    return [s for s in selectors if ":contains(" not in s]


def chapter_title(markup: Column, selectors: Sequence[str] = tuple(TITLE_SELECTORS), selected: Column | None = None) -> Column:
    """The first short heading by the selectors in order, else the chapter part of the document title, else that title.

    ``selected``: the elements' texts by selector, if they are known already.
    """
    selected = arrow.lists_of(_wanted(selectors, "text"))(markup) if selected is None else selected
    line = lambda t: urls.trimmed(F.substring_index(urls.trimmed(html.unescape(t)), "\n", 1))
    firsts = F.transform(F.filter(F.transform(selected, lambda found: F.get(found, F.lit(0))), lambda t: t != ""), line)
    heading = F.coalesce(F.get(F.filter(firsts, lambda t: (t != "") & (F.length(t) <= 60)), F.lit(0)), F.lit(""))

    def from_title(title: Column) -> Column:
        out = F.left(title, F.lit(80))
        for mark in reversed(["_", "|", " - ", "—"]):
            part = urls.trimmed(F.substring_index(title, mark, 1))
            out = F.when(part.rlike(CHAPTER_TEXT), part).otherwise(out)
        return out

    fallback = bind(html.prose(F.regexp_extract(markup, html.TITLE, 1)), from_title)
    return bind(heading, lambda h: F.when((h != "") & (F.length(h) <= 60), h).otherwise(fallback))


def next_link(markup: Column, base: Column, selectors: Sequence[str] = tuple(NEXT_SELECTORS), selected: Column | None = None) -> Column:
    """Absolute address of the page's own next link, '' when it has none.

    In this order: the head's link, the selectors (``:contains('…')`` tests an anchor's text), anchors with the usual labels.
    Anchors' texts are read only where the selectors before the first ``:contains`` give nothing.
    ``selected``: the addresses of the elements by the other selectors, if they are known already.
    """
    href = lambda t: F.regexp_extract(t, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)
    plain = _plain(selectors)
    selected = arrow.lists_of(_wanted(plain, "href"))(markup) if selected is None and plain else selected
    sure = next((i for i, s in enumerate(selectors) if s not in plain), len(selectors))
    head = F.transform(F.regexp_extract_all(markup, F.lit(r"""(?i)<link\b[^>]*\brel\s*=\s*["']?next["']?[^>]*>"""), F.lit(0)), href)

    def first(listed: Column) -> Column:
        found = F.filter(F.transform(listed, lambda h: urls.resolve_url(base, h, keep_fragment=False)), lambda u: u != "")
        return F.get(found, F.lit(0))

    def by_selector(anchors: Column, selector: str) -> Column:
        if selector in plain:
            return F.get(selected, F.lit(plain.index(selector)))
        word = selector.split(":contains(", 1)[1].rstrip(")").strip("'\"").lower()
        return F.filter(anchors, lambda a: F.contains(F.lower(a["text"]), F.lit(word)))["href"]

    def by_text(anchors: Column) -> Column:
        return F.concat(*[by_selector(anchors, s) for s in selectors[sure:]], F.filter(anchors, lambda a: a["text"].rlike(NEXT_LABEL))["href"])

    anchors = F.transform(F.regexp_extract_all(markup, F.lit(html.ANCHOR), F.lit(0)), lambda t: F.struct(
        href(t).alias("href"), html.prose(F.regexp_extract(t, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)).alias("text")))
    return F.coalesce(first(F.concat(head, *[by_selector(head, s) for s in selectors[:sure]])), first(bind(anchors, by_text)), F.lit(""))


def bump_url(url: Column) -> Column:
    """The address with its page number raised by one, '' when it carries none."""
    number = urls.split_trailing_number(urls.path_of(url))
    query = F.when(urls.query_of(url) != "", F.concat(F.lit("?"), urls.query_of(url))).otherwise("")
    path = F.concat(urls.part(url, 1), F.lit("://"), urls.url_domain(url), number["prefix"],
                    (number["number"] + 1).cast("string"), number["suffix"], query)
    own = urls.query_param(url, tuple(p for p in fixed.PAGE_PARAMS if p not in ("pageid", "paged")))
    return F.coalesce(F.when(own["name"].isNotNull(), urls.with_param(url, own["name"], own["value"] + 1)), path, F.lit(""))


def read_book_pages(pages: DataFrame, min_chars: int = 1, titles: Sequence[str] = tuple(TITLE_SELECTORS), contents: Sequence[str] = tuple(CONTENT_SELECTORS),
                    nexts: Sequence[str] = tuple(NEXT_SELECTORS)) -> DataFrame:
    """page_id, base_url, title, body, linked next page and the numbered guess, by the caller's selectors or the usual ones."""
    html_, found, n = F.col("html"), F.col("_found"), len(titles)
    once = arrow.lists_of(_wanted(titles, "text") + _wanted(_plain(nexts), "href"))  # a page is read once for both
    read = pages.select("page_id", "base_url", "html", once(html_).alias("_found"))
    return read.select("page_id", "base_url", chapter_title(html_, titles, F.slice(found, 1, n)).alias("title"),
                       book_content(html_, contents, min_chars=min_chars).alias("body"),
                       next_link(html_, F.col("base_url"), nexts, F.slice(found, n + 1, max(len(_plain(nexts)), 1))).alias("linked"),
                       bump_url(F.col("base_url")).alias("guess"))


def next_pointers(book_pages: DataFrame, site_links: DataFrame) -> DataFrame:
    """Next page per page: its own link, else the numbered guess when the page itself lists it."""
    seen = site_links.select("page_id", F.col("link").alias("guess")).distinct()
    confirmed = book_pages.filter(F.col("linked") == "").join(seen, ["page_id", "guess"], "left_semi").select("page_id", F.col("guess").alias("_g"))
    joined = book_pages.join(confirmed, "page_id", "left")
    return joined.select(F.col("base_url").alias("node"), F.coalesce(F.nullif("linked", F.lit("")), "_g").alias("next"))


def chapter_breaks(pages: DataFrame, book: str = "book", order: str = "dist") -> DataFrame:
    """Add ``heading``: shown only where it changes and the body does not begin with it.

    A book's pages are bounded by its page limit, so its window is small.
    """
    title = urls.trimmed(F.substring_index(html.clean_text(F.col("title")), "\n", 1))
    cand = pages.withColumn("_t", title).withColumn("_c", (F.col("_t") != "") & ~F.startswith("body", F.col("_t")))
    before = F.last(F.when(F.col("_c"), F.col("_t")), ignorenulls=True).over(
        Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cand.withColumn("heading", F.when(F.col("_c") & ~F.col("_t").eqNullSafe(before), F.col("_t")).otherwise("")).drop("_t", "_c")


def assemble_book(pages: DataFrame, book: str = "book", order: str = "dist", title: str | None = None, separator: str = "\n\n") -> DataFrame:
    """One text per book: title, headings, bodies in order."""
    marked = chapter_breaks(pages.filter(F.col("body") != ""), book, order)
    part = F.struct(F.col(order), F.array("heading", "body").alias("blocks"))
    grouped = marked.groupBy(book, *([title] if title else [])).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    blocks = F.filter(F.flatten(F.transform("parts", lambda p: p["blocks"])), lambda b: b != "")
    name = F.when(F.col(title) != "", F.concat(F.lit("《"), F.regexp_replace(title, "^[《》]+|[《》]+$", ""), F.lit("》"), F.lit(separator))).otherwise("") if title else F.lit("")
    return grouped.select(book, F.concat(urls.trimmed(F.concat(name, F.array_join(blocks, separator))), F.lit("\n")).alias("text"))


def book_metadata(pages: DataFrame, book: str = "book", order: str = "dist") -> DataFrame:
    """Pages, successes, failures, characters and the ordered chapter list of each book."""
    good = (F.col("error") == "") & (F.col("body") != "")
    chapters = F.array_sort(F.collect_list(F.when(good, F.struct(F.col(order).alias("index"), F.col("title")))))
    return pages.groupBy(book).agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(good).alias("success_pages"), F.count_if(~good).alias("failed_pages"),
        F.sum(F.when(good, F.length("body")).otherwise(0)).cast("long").alias("total_chars"), chapters.alias("chapters"))
