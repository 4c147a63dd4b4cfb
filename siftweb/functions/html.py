"""Markup functions on a page column, native regular expressions and array functions only."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftweb.functions import fixed
from siftweb.functions.urls import bind, trimmed

# --- fixed values: tags without readable text, and tags that end a line
NOISE_TAGS = ["script", "style", "noscript", "nav", "header", "footer",
              "aside", "form", "iframe", "svg", "button", "template"]
BLOCK_TAGS = ["p", "div", "br", "li", "tr", "td", "th", "section", "article",
              "blockquote", "dd", "dt", "pre", "table", "ul", "ol",
              "h1", "h2", "h3", "h4", "h5", "h6", "hr"]
# --- fixed values: link texts that announce a policy page, Chinese list first
ANCHOR_HINTS = [
    "服务条款", "使用条款", "用户协议", "用户服务协议", "服务协议", "服务规则",
    "隐私政策", "隐私权政策", "隐私声明", "隐私保护", "个人信息保护",
    "法律声明", "法律信息", "免责声明", "版权声明", "版权政策", "知识产权",
    "条款与条件", "条款和条件", "使用规则", "社区规范", "用户须知",
    "开发者协议", "开放平台协议", "数据使用", "机器人协议", "网站声明",
    "terms", "terms of service", "terms of use", "terms & conditions",
    "user agreement", "eula", "privacy", "privacy policy",
    "privacy statement", "legal", "legal notice", "disclaimer", "copyright",
    "cookie policy", "acceptable use", "fair use", "data policy",
    "developer terms", "api terms", "robots", "dpa",
]

LINE_BREAKS = "[\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029]+"
HREF = r"""(?i)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
ATTRIBUTE = r"""([\w\-:.]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""

_CLOSED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
_OPEN = {name: value for name, value in html5.items() if not name.endswith(";")}
_OPEN_NAMES = "|".join(sorted(_OPEN, key=lambda n: (-len(n), n)))
# numeric references 128-159 mean Windows-1252 characters
_WINDOWS = {str(code): bytes([code]).decode("cp1252") for code in range(128, 160)
            if code not in (129, 141, 143, 144, 157)}


def _table(values: dict) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _code_point(code: Column) -> Column:
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
            .when(code.between(128, 159), F.coalesce(F.element_at(_table(_WINDOWS), code.cast("string")), text))
            .when(code.between(1, 8) | code.between(14, 31) | code.between(127, 159) | (code == 11), "")
            .otherwise(text))


def _reference(piece: Column) -> Column:
    """One stretch of text that followed an ampersand."""
    number = F.regexp_extract(piece, "^#([0-9]+);?", 1)
    hexa = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
    name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]{0,31});", 1)
    legacy = F.regexp_extract(piece, f"^({_OPEN_NAMES})", 1)
    rest = lambda pattern: F.regexp_replace(piece, pattern, "")
    named = F.element_at(_table(_CLOSED), name)
    return (F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substr(piece, F.lit(5))))
            .when(piece.startswith("lt;"), F.concat(F.lit("<"), F.substr(piece, F.lit(4))))
            .when(piece.startswith("gt;"), F.concat(F.lit(">"), F.substr(piece, F.lit(4))))
            .when(piece.startswith("quot;"), F.concat(F.lit('"'), F.substr(piece, F.lit(6))))
            .when(number != "", F.concat(_code_point(F.left(F.ltrim(number, F.lit("0")), F.lit(9)).try_cast("int")), rest("^#[0-9]+;?")))
            .when(hexa != "", F.concat(_code_point(F.conv(F.left(F.ltrim(hexa, F.lit("0")), F.lit(7)), 16, 10).try_cast("int")),
                                       rest("^#[xX][0-9a-fA-F]+;?")))
            .when((name != "") & named.isNotNull(), F.concat(named, rest("^[A-Za-z][A-Za-z0-9]*;")))
            .when(legacy != "", F.concat(F.element_at(_table(_OPEN), legacy), rest(f"^(?:{_OPEN_NAMES})")))
            .otherwise(F.concat(F.lit("&"), piece)))


def unescape(text: Column) -> Column:
    """Character references to characters, once, for every name of HTML 5."""
    def decode(raw: Column) -> Column:
        pieces = F.split(raw, "&", -1)
        tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: _reference(p))
        return F.when(F.contains(raw, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))).otherwise(raw)

    return bind(text, decode)


def lines_of(text: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAKS), lambda s: trimmed(s)), lambda s: s != "")


def page_text(html: Column) -> Column:
    """Readable text, one line per stretch between tags."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, "(?is)<style[^>]*>.*?</style>", " ")
    return F.array_join(lines_of(unescape(F.regexp_replace(bare, "<[^>]+>", "\n"))), "\n")


def squeeze(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def page_title(html: Column, cap: int = 200) -> Column:
    inner = F.regexp_replace(F.regexp_extract(html, TITLE, 1), "<[^>]+>", " ")
    return F.left(squeeze(unescape(inner)), F.lit(cap))


_OG_TITLE = r"""(?i)<meta\b[^>]*\b(?:property|name)\s*=\s*["'](?:og:title|twitter:title)["'][^>]*>"""
_CONTENT = r"""(?i)content\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def meta_content(tag: Column) -> Column:
    return trimmed(F.concat(F.regexp_extract(tag, _CONTENT, 1), F.regexp_extract(tag, _CONTENT, 2)))


def page_album(html: Column) -> Column:
    """Social title, else the document title, 60 characters at most."""
    tags = F.regexp_extract_all(html, F.lit(_OG_TITLE), F.lit(0))
    social = F.get(F.filter(F.transform(tags, lambda t: meta_content(t)), lambda t: t != ""), F.lit(0))
    plain = squeeze(unescape(F.regexp_extract(html, TITLE, 1)))
    return F.left(F.coalesce(unescape(social), plain), F.lit(60))


def normalize_text(text: Column) -> Column:
    """Lines without outer blanks, single blanks between words, no empty lines. What a text doesn't hold isn't looked for character by character."""
    wide = lambda t: F.contains(t, F.lit("\u3000")) | F.contains(t, F.lit("\xa0"))
    plain = bind(text, lambda t: F.when(wide(t), F.translate(t, "\u3000\xa0", "  ")).otherwise(t))
    clean = bind(plain, lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    runs = lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\f")) | F.contains(t, F.lit("\x0b"))
    single = bind(clean, lambda t: F.when(runs(t), F.regexp_replace(t, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")).otherwise(t))
    lines = F.filter(F.transform(F.split(single, "\n"), lambda s: trimmed(s)), lambda s: s != "")
    return F.array_join(lines, "\n")


def main_text(html: Column) -> Column:
    """Body text without navigation, scripts and other noise; block tags end a line."""
    noise = "|".join(NOISE_TAGS)
    bare = F.regexp_replace(html, rf"(?is)<(?:{noise})\b[^>]*>.*?</(?:{noise})\s*>", " ")
    # found once, its own tags cut off
    inside = lambda t, whole: F.when(whole == "", t).otherwise(F.regexp_replace(F.left(whole, F.length(whole) - len("</body>")), "(?i)^<body[^>]*>", ""))
    body = bind(bare, lambda t: bind(F.regexp_extract(t, "(?is)<body[^>]*>.*?</body>", 0), lambda whole: inside(t, whole)))
    broken = F.regexp_replace(body, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    fallback = normalize_text(unescape(F.regexp_replace(html, "<[^>]+>", "\n")))
    return bind(normalize_text(unescape(F.regexp_replace(broken, "<[^>]+>", " "))),
                lambda first: F.when(first == "", fallback).otherwise(first))


def href_values(html: Column) -> Column:
    """Quoted ``href`` values of anchors, in document order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def anchors(html: Column) -> Column:
    """Array of struct(href, text), tags inside the text removed."""
    def one(tag: Column) -> Column:
        head = F.regexp_extract(tag, r"(?i)^<a\b([^>]*)>", 1)
        href = F.concat(*[F.regexp_extract(head, HREF, i) for i in (1, 2, 3)])
        inner = F.regexp_extract(tag, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)
        return F.struct(href.alias("href"), squeeze(unescape(F.regexp_replace(inner, "<[^>]+>", " "))).alias("text"))

    found = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda t: one(t))
    return F.filter(found, lambda a: a["href"] != "")


def anchor_hint(text: Column) -> Column:
    low = F.lower(trimmed(F.coalesce(text, F.lit(""))))
    hits = F.filter(F.array(*[F.lit(h) for h in ANCHOR_HINTS]), lambda h: F.contains(low, h))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def parse_attrs(tag: Column) -> Column:
    """Attribute map of one tag: lower-case names, first occurrence wins."""
    pieces = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    pairs = F.transform(pieces, lambda p: F.struct(
        F.lower(F.regexp_extract(p, r"^([\w\-:.]+)", 1)).alias("k"),
        F.regexp_replace(F.regexp_replace(p, r"^[\w\-:.]+\s*=\s*", ""), "^[\"']|[\"']$", "").alias("v")))
    # the last write wins in a map built with LAST_WIN, so feed it backwards
    return F.map_from_entries(F.reverse(pairs))


def best_srcset(value: Column) -> Column:
    """Sharpest candidate; without any descriptor the last one."""
    pieces = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: squeeze(p)), lambda p: p != "")

    def scored(piece: Column, pos: Column) -> Column:
        mark = F.lower(F.coalesce(F.get(F.split(piece, " "), F.lit(1)), F.lit("")))
        number = F.regexp_extract(mark, r"^([0-9.]+)[wx]$", 1).try_cast("double")
        score = F.when(mark.endswith("x"), number * 1000).otherwise(number)
        return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), (-pos).alias("back"),
                        F.substring_index(piece, " ", 1).alias("url"))

    def pick(ranked: Column) -> Column:
        return bind(F.array_max(ranked), lambda top: F.when(F.size(ranked) == 0, "")
                    .when(top["score"] <= 0, F.element_at(ranked, -1)["url"]).otherwise(top["url"]))

    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(bind(F.transform(pieces, scored), pick))


def best_src(attrs: Column) -> Column:
    """Struct(attr, value) of the first address attribute that is filled."""
    filled = F.filter(F.array(*[F.lit(a) for a in fixed.SRC_ATTRS]),
                      lambda a: trimmed(F.coalesce(F.try_element_at(attrs, a), F.lit(""))) != "")
    return bind(F.coalesce(F.get(filled, F.lit(0)), F.lit("")), lambda a: F.struct(
        a.alias("attr"), trimmed(F.coalesce(F.try_element_at(attrs, a), F.lit(""))).alias("value")))


INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\ufeff\xa0]"


def clean_text(text: Column, collapse_blank: bool = True) -> Column:
    """Readable prose: references decoded, blanks squeezed, one empty line at most between paragraphs."""
    plain = F.regexp_replace(unescape(text), INVISIBLE, " ")
    plain = F.regexp_replace(plain, r"\r\n?", "\n")
    lines = F.transform(F.split(plain, "\n"), lambda s: trimmed(F.regexp_replace(s, r"[ \t\u3000]{2,}", " ")))
    joined = trimmed(F.array_join(lines, "\n"))
    return F.regexp_replace(joined, r"\n{3,}", "\n\n") if collapse_blank else joined


def prose(html: Column) -> Column:
    """Text of a markup fragment: closing block tags end a line, other tags vanish."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?i)<br\s*/?>", "\n")
    bare = F.regexp_replace(bare, r"(?i)</(p|div|li|tr|h[1-6])\s*>", "\n")
    return clean_text(unescape(F.regexp_replace(bare, "<[^>]+>", "")))
