"""Queries over the page table: addresses, links, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftweb.catalog.inputs import (STRIP, load, pages, quoted, sql_canonical, sql_host, sql_page_text, sql_part,
                                    sql_rooted_links, sql_unescape)
from siftweb.functions import fixed, html, urls
from siftweb.operators import extract, filters
from siftweb.scale import unnest

TRACKED = r"[?&](?:utm_[a-z0-9_]*|gclid|fbclid|spm)="


def host_overview(spark, folder):
    p = pages(spark, folder)
    links = F.array_distinct(html.href_values(F.col("html")))
    return (p.select(urls.host_of(F.col("url")).alias("host"), urls.canonical_url(F.col("url")).alias("canonical"),
                     F.size(links).alias("links"), F.length(html.page_text(F.col("html"))).alias("chars"),
                     F.col("url").rlike(TRACKED).alias("tracked"))
            .groupBy("host").agg(
                F.count(F.lit(1)).alias("pages"), F.count_distinct("canonical").alias("distinct_urls"),
                F.sum("links").cast("long").alias("out_links"), F.sum("chars").cast("long").alias("text_chars"),
                F.round(F.count_if("tracked") / F.count(F.lit(1)), 4).alias("tracked_share")))


def canonical_urls(spark, folder):
    url = F.col("url")
    return pages(spark, folder).select(
        "page_id", urls.canonical_url(url).alias("canonical"), urls.legal_url_key(url).alias("legal_key"),
        urls.url_key(url).alias("url_key"), urls.url_hash_raw(url).alias("raw_hash"))


def url_parts(spark, folder):
    url = F.col("url")
    number = urls.split_trailing_number(urls.path_of(url))
    return pages(spark, folder).select(
        "page_id", urls.is_http_url(url).alias("is_http"), urls.url_problem(url).alias("problem"),
        urls.url_domain(url).alias("domain"), urls.normalize_domain(url).alias("bare_domain"),
        urls.registered_domain(urls.host_of(url)).alias("registered"), urls.ext_of(url).alias("ext"),
        F.array_join(urls.domain_family(urls.host_of(url)), " ").alias("family"),
        number["prefix"].alias("prefix"), number["number"].alias("number"), number["suffix"].alias("suffix"),
        urls.format_size(F.col("page_id") * 1000).alias("size_text"),
        urls.fmt_duration(F.col("page_id") * 61).alias("duration_text"),
        urls.report_filename(url, F.lit("20240101_000000")).alias("report_file"))


def resolve_links(spark, folder):
    p = pages(spark, folder)
    return (unnest(p, ["page_id", "base_url"], F.array_distinct(html.href_values(F.col("html"))), "href")
            .select("page_id", "href", urls.resolve_url(F.col("base_url"), F.col("href")).alias("link"),
                    urls.join_url(F.col("base_url"), F.concat(F.lit("../x/./y"), F.lit("?q=1"))).alias("relative")))


def page_links(spark, folder):
    return extract.extract_links(pages(spark, folder)).select("page_id", "link")


def page_text(spark, folder):
    p = pages(spark, folder)
    return p.select("page_id", html.page_title(F.col("html")).alias("title"), html.page_album(F.col("html")).alias("album"),
                    html.page_text(F.col("html")).alias("text"))


def anchors(spark, folder):
    return extract.extract_anchors(pages(spark, folder)).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "href", "text", "hint")


def main_text(spark, folder):
    return pages(spark, folder).select("page_id", html.main_text(F.col("html")).alias("main_text"))


BLOCK = ["/(?:de|the)$", r"[?&]ref=", "("]


def link_filter(spark, folder):
    links = extract.extract_links(pages(spark, folder)).withColumnRenamed("link", "url")
    return filters.url_filter(links, BLOCK, ["http://Example.org:80/x", "example.com"]).select("page_id", "url", "allowed", "reason")


def link_filter_stats(spark, folder):
    p = filters.url_filter(pages(spark, folder).select("page_id", "url"), BLOCK, ["example.org"])
    return filters.url_filter_stats(p, "page_id").select(
        "checked", "filtered_count", F.array_join("recent_filtered", " ").alias("recent_filtered"))


def frontier(spark, folder):
    p = pages(spark, folder)
    seen = p.select(F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.url_domain(F.col("url")), F.lit("/de")).alias("url"))
    return filters.frontier_links(extract.extract_links(p), seen.distinct(), keyword="e").select("page_id", "link")


def crawl_stats(spark, folder):
    p = pages(spark, folder)
    return p.select("page_id", F.length(html.page_text(F.col("html"))).cast("long").alias("chars"),
                    F.size(F.array_distinct(html.href_values(F.col("html")))).cast("long").alias("links"),
                    F.size(extract.media_link_array()).cast("long").alias("media"))


def detail_links(spark, folder):
    return filters.detail_links(pages(spark, folder), most=20).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def needs_render(spark, folder):
    p = pages(spark, folder).withColumn("media_count", F.size(extract.media_link_array()))
    p = p.withColumn("error", F.when(F.length("html") > 20000, "timeout").otherwise("")).withColumn(
        "ok", F.col("error") == "")
    return filters.needs_render(p).select("page_id", "needs_render")


def capped_pages(spark, folder):
    from siftweb.sources.pages import cap_page_text

    return cap_page_text(pages(spark, folder), 2000).select("page_id", "truncated", F.length("html").cast("long").alias("kept"))


def title_by_document(spark, folder):
    """Readable prose of the documents wrapped in a small page."""
    d = load(spark, folder, "documents")
    page = F.concat(F.lit("<html><head><title>"), F.col("source"), F.lit(" &amp; "), F.col("lang"),
                    F.lit("</title></head><body><nav>x</nav><p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p></body></html>"))
    return d.select("doc_id", html.page_title(page).alias("title"), F.md5(html.main_text(page).cast("binary")).alias("text_md5"))


QUERIES = {
    "host_overview": host_overview, "canonical_urls": canonical_urls, "url_parts": url_parts,
    "resolve_links": resolve_links, "page_links": page_links, "page_text": page_text, "anchors": anchors,
    "main_text": main_text, "link_filter": link_filter, "link_filter_stats": link_filter_stats, "frontier": frontier,
    "crawl_stats": crawl_stats, "detail_links": detail_links, "needs_render": needs_render,
    "capped_pages": capped_pages, "document_text": title_by_document,
}

_LEN = f"length({sql_page_text()})"
_HREFS = """list_distinct(regexp_extract_all(html, '(?i)<a[^>]+href\\s*=\\s*["'']([^"'']+)["'']', 1))"""
_ROOT = f"({sql_part('url', 1)} || '://' || {sql_part('url', 2)})"
_TITLE = (f"regexp_replace(regexp_replace({sql_unescape('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, "
          f"'\\s+', ' ', 'g'), {STRIP}, '', 'g')")
_ANCHOR_TEXT = (f"regexp_replace(regexp_replace({sql_unescape('''regexp_replace(regexp_extract(tag, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g')''')}, "
                f"'\\s+', ' ', 'g'), {STRIP}, '', 'g')")


def _sql_noise(text: str) -> str:
    for tag in html.NOISE_TAGS:
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return text


def _sql_main(page: str) -> str:
    bare = _sql_noise(page)
    found = f"regexp_extract({bare}, '(?is)<body[^>]*>(.*?)</body>', 1)"
    body = f"CASE WHEN regexp_matches({bare}, '(?is)<body[^>]*>.*?</body>') THEN {found} ELSE {bare} END"
    blocks = "|".join(html.BLOCK_TAGS)
    plain = f"regexp_replace(regexp_replace({body}, '(?i)</?(?:{blocks})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    squeezed = f"regexp_replace(replace({sql_unescape(plain)}, chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({squeezed}, chr(10)), "
            f"lambda s: regexp_replace(s, {STRIP}, '', 'g')), lambda s: s <> ''), chr(10))")


_HINT_CASE = "coalesce(list_filter([" + quoted(html.ANCHOR_HINTS) + "], lambda h: contains(lower(text), h))[1], '')"
_LINKS = f"SELECT page_id, url AS base_url, unnest(list_distinct({sql_rooted_links()})) AS link FROM pages"
_SIZE = "page_id * 1000.0"

SQL = {
    "host_overview": f"""
        SELECT {sql_host('url')} AS host, count(*) AS pages, count(DISTINCT {sql_canonical('url')}) AS distinct_urls,
               sum(len({_HREFS}))::BIGINT AS out_links, sum({_LEN})::BIGINT AS text_chars,
               round(count(*) FILTER (regexp_matches(url, '{TRACKED}')) / count(*), 4) AS tracked_share
        FROM pages GROUP BY 1""",
    "canonical_urls": f"""
        SELECT page_id, {sql_canonical('url')} AS canonical,
               lower({sql_part('url', 1)}) || '://' || lower({sql_part('url', 2)}) ||
               CASE WHEN {sql_part('url', 3)} IN ('', '/') THEN '/' ELSE regexp_replace({sql_part('url', 3)}, '/+$', '') END ||
               CASE WHEN {sql_part('url', 4)} <> '' THEN '?' || {sql_part('url', 4)} ELSE '' END AS legal_key,
               sha256({sql_canonical('url')}) AS url_key, sha256(url) AS raw_hash
        FROM pages""",
    "url_parts": f"""
        WITH p AS (SELECT page_id, url, {sql_part('url', 2)} AS domain, {sql_part('url', 3)} AS path,
                          string_split({sql_host('url')}, '.') AS labels FROM pages)
        SELECT page_id, regexp_matches(url, '^https?://[^/?#]') AS is_http, '' AS problem, domain,
               split_part(lower(domain), ':', 1) AS bare_domain, labels[-2] || '.' || labels[-1] AS registered,
               lower(regexp_extract(path, '[^/.](\\.[^./]*)$', 1)) AS ext,
               array_to_string(list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')), ' ') AS family,
               CASE WHEN regexp_matches(path, '\\d') THEN regexp_extract(path, '^(.*?)(\\d+)([^\\d]*)$', 1) END AS prefix,
               try_cast(regexp_extract(path, '^(.*?)(\\d+)([^\\d]*)$', 2) AS BIGINT) AS number,
               CASE WHEN regexp_matches(path, '\\d') THEN regexp_extract(path, '^(.*?)(\\d+)([^\\d]*)$', 3) END AS suffix,
               CASE WHEN {_SIZE} < 1024 THEN printf('%.1f B', {_SIZE}::DOUBLE)
                    WHEN {_SIZE} < 1048576 THEN printf('%.1f KB', {_SIZE}::DOUBLE / 1024)
                    ELSE printf('%.1f MB', {_SIZE}::DOUBLE / 1048576) END AS size_text,
               printf('%02d:%02d:%02d', page_id * 61 // 3600, page_id * 61 % 3600 // 60, page_id * 61 % 60) AS duration_text,
               regexp_replace(domain, '[^0-9A-Za-z._-]+', '_', 'g') || '_20240101_000000.json' AS report_file
        FROM p""",
    "resolve_links": f"""
        WITH h AS (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages)
        SELECT page_id, href, {_ROOT} || href AS link,
               {_ROOT} || regexp_replace(regexp_replace(regexp_replace({sql_part('url', 3)}, '[^/]*$', ''), '/[^/]*/$', '/'), '^$', '/')
               || 'x/y?q=1' AS relative
        FROM h""",
    "page_links": f"SELECT page_id, link FROM ({_LINKS})",
    "page_text": f"SELECT page_id, left({_TITLE}, 200) AS title, left({_TITLE}, 60) AS album, {sql_page_text()} AS text FROM pages",
    "anchors": f"""
        WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) AS tag,
                          generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages),
             a AS (SELECT page_id, pos, regexp_extract(tag, '(?i)href\\s*=\\s*"([^"]*)"', 1) AS href, {_ANCHOR_TEXT} AS text FROM t)
        SELECT page_id, pos, href, text, {_HINT_CASE} AS hint FROM a WHERE href <> ''""",
    "main_text": f"SELECT page_id, {_sql_main('html')} AS main_text FROM pages",
    "link_filter": f"""
        WITH l AS (SELECT page_id, link AS url, {sql_host('link')} AS host FROM ({_LINKS})),
             r AS (SELECT *, NOT (host IN ('example.org', 'example.com') OR host LIKE '%.example.org' OR host LIKE '%.example.com') AS outside,
                          CASE WHEN regexp_matches(url, '/(?:de|the)$') THEN '/(?:de|the)$'
                               WHEN regexp_matches(url, '[?&]ref=') THEN '[?&]ref=' END AS hit FROM l)
        SELECT page_id, url, NOT outside AND hit IS NULL AS allowed,
               CASE WHEN outside THEN '域名 ' || host || ' 不在白名单内' WHEN hit IS NOT NULL THEN '命中屏蔽正则：' || hit
                    ELSE '命中白名单域名 ' || host END AS reason FROM r""",
    "link_filter_stats": f"""
        WITH r AS (SELECT page_id, url, NOT ({sql_host('url')} LIKE '%.example.org' OR {sql_host('url')} = 'example.org')
                          OR regexp_matches(url, '/(?:de|the)$|[?&]ref=') AS blocked FROM pages),
             s AS (SELECT * FROM r WHERE blocked ORDER BY page_id DESC LIMIT 100)
        SELECT count(*) AS checked, count(*) FILTER (blocked) AS filtered_count,
               (SELECT string_agg(url, ' ' ORDER BY page_id) FROM s) AS recent_filtered FROM r""",
    "frontier": f"""
        WITH l AS ({_LINKS})
        SELECT page_id, link FROM l WHERE contains(link, 'e') AND {sql_part('link', 2)} = {sql_part('base_url', 2)}
        AND link NOT IN (SELECT {_ROOT} || '/de' FROM pages)""",
    "crawl_stats": f"""
        SELECT page_id, {_LEN} AS chars, len({_HREFS})::BIGINT AS links,
               len(list_filter({_HREFS}, lambda h: regexp_matches(h, '(?i){fixed.LINKED_MEDIA_EXT}(?:[?#]|$)')))::BIGINT AS media
        FROM pages""",
    "detail_links": f"""
        WITH h AS (SELECT page_id, {_ROOT} AS root, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href,
                          generate_subscripts(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1), 1) AS n FROM pages),
             d AS (SELECT page_id, root || href AS link, min(n) AS n FROM h
                   WHERE NOT regexp_matches(root || href, '{filters.DETAIL_EXCLUDE}') GROUP BY ALL),
             o AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM d)
        SELECT page_id, pos, link FROM o WHERE pos < 20""",
    "needs_render": f"""
        SELECT page_id, CASE WHEN length(html) > 20000 THEN true
               ELSE length(html) >= 800 AND regexp_matches(html, '{filters.JS_SIGNAL}') END AS needs_render FROM pages""",
    "capped_pages": "SELECT page_id, length(html) > 2000 AS truncated, least(length(html), 2000) AS kept FROM pages",
    "document_text": f"""
        SELECT doc_id, source || ' & ' || lang AS title,
               md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(regexp_replace(text, '[<>&]', ' ', 'g'),
                   chr(13), chr(10)), chr(12288), ' '), chr(160), ' '), '[ \\t]+', ' ', 'g'), chr(10)),
                   lambda s: regexp_replace(s, {STRIP}, '', 'g')), lambda s: s <> ''), chr(10))) AS text_md5
        FROM documents""",
}
