"""Table access and the SQL snippets that the counterparts share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftweb.functions import fixed
from siftweb.scale import spread
from siftweb.sources.pages import as_pages


#: tables whose rows carry heavy expressions
HEAVY = {"documents", "pages", "conversations", "lineitem", "events", "part"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table) if name in HEAVY else table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return as_pages(load(spark, folder, "pages"))


URL_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{URL_SPLIT}', {group})"


def sql_host(url: str) -> str:
    netloc = sql_part(url, 2)
    return f"lower(split_part(split_part({netloc}, '@', -1), ':', 1))"


def sql_decode(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


def sql_encode(text: str) -> str:
    return f"replace(url_encode({text}), '%20', '+')"


def sql_canonical(url: str) -> str:
    """For http(s) addresses without user info and with valid ports."""
    query = sql_part(url, 4)
    pieces = f"list_filter(string_split({query}, '&'), lambda p: p <> '')"
    pairs = (f"list_transform({pieces}, lambda p: [{sql_decode(chr(112) + '_key')}, {sql_decode(chr(112) + '_val')}])")
    pairs = pairs.replace("p_key", "split_part(p, '=', 1)").replace(
        "p_val", "CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END")
    kept = (f"list_sort(list_filter({pairs}, lambda q: lower(q[1]) NOT IN ({quoted(fixed.STRONG_AD_PARAMS)}) "
            f"AND NOT starts_with(lower(q[1]), 'utm_')))")
    encoded = f"array_to_string(list_transform({kept}, lambda q: {sql_encode('q[1]')} || '=' || {sql_encode('q[2]')}), '&')"
    scheme = f"lower({sql_part(url, 1)})"
    port = f"regexp_extract({sql_part(url, 2)}, ':([0-9]+)$', 1)"
    port_text = (f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') "
                 f"THEN '' ELSE ':' || {port} END")
    return (f"({scheme} || '://' || {sql_host(url)} || {port_text} || {sql_part(url, 3)} || "
            f"CASE WHEN {encoded} <> '' THEN '?' || {encoded} ELSE '' END)")


def sql_unescape(text: str) -> str:
    """The references that occur in the tables; the ampersand last."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


STRIP = r"'^\s+|\s+$'"


def sql_lines(text: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({text}, '[\\n\\r]+'), "
            f"lambda s: regexp_replace(s, {STRIP}, '', 'g')), lambda s: s <> '')")


def sql_page_text(html: str = "html") -> str:
    bare = f"regexp_replace({html}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    bare = f"regexp_replace({bare}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    tagless = f"regexp_replace({bare}, '<[^>]+>', chr(10), 'g')"
    return f"array_to_string({sql_lines(sql_unescape(tagless))}, chr(10))"


def sql_rooted_links(html: str = "html", url: str = "url") -> str:
    """Absolute addresses of rooted and absolute anchors (the only kinds in the table)."""
    found = f"""regexp_extract_all({html}, '(?i)<a[^>]+href\\s*=\\s*["'']([^"'']+)["'']', 1)"""
    root = f"({sql_part(url, 1)} || '://' || {sql_part(url, 2)})"
    return (f"list_filter(list_transform({found}, lambda h: CASE WHEN starts_with(h, '/') THEN {root} || h ELSE h END), "
            f"lambda u: regexp_matches(u, '^https?://'))")
