"""Configuration and record files written and read back, sitemaps, direct media, headings, site links."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftweb.catalog import streams
from siftweb.catalog.inputs import load, pages, sql_host, sql_part
from siftweb.catalog.streams import _events, _scratch
from siftweb.functions import fixed
from siftweb.operators import extract, filters, media, policy
from siftweb.scale import unnest
from siftweb.sources import rules as rule_files
from siftweb.sources import tables
from siftweb.sources.pages import read_sitemaps
from siftweb.streaming import jobs as streaming

KINDS = ["image/png", "video/mp4", "audio/mpeg", "application/x-mpegurl", "text/html"]


def sitemap_addresses(spark, folder):
    """Every host's root map names three maps, which list its pages."""
    p = pages(spark, folder).select(F.lower(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1)).alias("site"), "url", "page_id")
    tag = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    name = F.concat(F.lit("https://"), "site", F.lit("/map"), (F.col("page_id") % 3).cast("string"), F.lit(".xml"))
    below = p.withColumn("map", name).groupBy("site", "map").agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), tag), "\n").alias("text"))
    root = F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml"))
    top = below.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list("map")), tag), "").alias("text")).select("site", root.alias("url"), "text")
    files = top.unionByName(below.select("site", F.col("map").alias("url"), "text"))
    return read_sitemaps(files, top.select("site", "url")).select("site", "map_url", "loc", F.col("seen").cast("long").alias("seen"))


def direct_media(spark, folder):
    """Events as addresses without a suffix that the server calls media."""
    e = load(spark, folder, "events")
    kinds = F.array(*map(F.lit, KINDS))
    rows = e.select(F.col("event_id").alias("page_id"), F.concat(F.lit("http://m.example.com/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("url"),
                    F.get(kinds, (F.col("event_id") % len(KINDS)).cast("int")).alias("content_type"), (F.col("event_id") % 2 == 0).alias("media_direct"))
    out = filters.media_direct(rows, "http://m.example.com/view/4")
    return out.select("page_seq", "url", "kind", "source_page", "origin", F.col("extra")["content_type"].alias("content_type"))


def download_records(spark, folder):
    """Downloads of two runs, the first of them written twice, counted per event type."""
    at = _scratch(spark)
    e = load(spark, folder, "events").select(F.concat(F.lit("http://d.example.com/"), F.col("event_id").cast("string")).alias("url"), "event_type", "event_id")
    for run in (0, 0, 1):
        tables.record_downloads(e.filter(F.col("event_id") % 2 == run), f"{at}/downloads", run + 1)
    rows = spark.read.parquet(f"{at}/downloads")
    return rows.groupBy("write_seq", "event_type").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("url_hash").alias("addresses"))


def report_table(spark, folder):
    """Reports of every host in two scans: the newest first, without their bodies."""
    at = _scratch(spark)
    site = F.lower(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1))
    r = pages(spark, folder).groupBy(site.alias("site")).agg(F.min("url").alias("start_url"), F.array_sort(F.collect_list("page_id")).alias("pages"))
    r = r.select("site", "start_url", F.lit("2024-01-01").alias("scan_time"), F.lit("rules").alias("engine"), "pages", F.filter("pages", lambda i: i % 3 == 0).alias("findings"))
    for scan in (1, 2):
        tables.append_reports(r.filter((F.size("pages") > 3) | F.lit(scan == 1)), f"{at}/reports", scan)
    return tables.list_reports(spark, f"{at}/reports", limit=1_000_000).select("write_seq", "site", "start_url", "engine", "pages", "hits")


def filter_file(spark, folder):
    """Suppliers' names as block patterns, some unusable or repeated, and their hosts as allowed ones: written and read back."""
    at = _scratch(spark)
    s = load(spark, folder, "supplier")
    k = F.col("s_suppkey")
    value = F.when(k % 5 == 0, "(").when(k % 5 == 1, F.concat(F.lit(" ads"), (k % 40).cast("string"), F.lit(" "))).when(k % 5 == 2, "").otherwise(F.concat(F.lit("p"), k.cast("string")))
    block = s.select(F.lit("block").alias("kind"), k.cast("int").alias("pos"), value.alias("value"))
    allow = s.select(F.lit("allow").alias("kind"), k.cast("int").alias("pos"), F.concat(F.lit("https://WWW.S"), (k % 30).cast("string"), F.lit(".example.com/x")).alias("value"))
    rule_files.write_filter_config(block.unionByName(allow), f"{at}/filter")
    return rule_files.read_filter_config(spark, f"{at}/filter").select("kind", "value")


def queue_file(spark, folder):
    """Suppliers as saved tasks: finished ones are left out, running ones wait again, those without an address are dropped."""
    at = _scratch(spark)
    k = F.col("s_suppkey")
    s = load(spark, folder, "supplier").select(
        k.alias("pos"), F.when(k % 3 == 0, F.col("s_name")).otherwise("").alias("task_name"),
        F.when(k % 7 == 0, "ftp://x").otherwise(F.concat(F.lit("https://q.example.com:81/"), k.cast("string"))).alias("start_url"), (k % 4).cast("int").alias("max_depth"),
        F.get(F.array(*map(F.lit, ["pending", "running", "completed", "paused", "failed"])), (k % 5).cast("int")).alias("status"), (k % 2).cast("int").alias("retry_count"), F.lit("").alias("error"))
    rule_files.write_task_queue(s, f"{at}/queue", "2024-01-01")
    return rule_files.read_task_queue(spark, f"{at}/queue").select("name", "start_url", "max_depth", "max_retries", "request_delay", "status", "retry_count")


def download_order(spark, folder):
    """Events by kind of media and arrival."""
    e = load(spark, folder, "events").select("event_id", F.get(F.array(*map(F.lit, ["image", "hls", "audio", "other", "document"])), (F.col("event_id") % 5).cast("int")).alias("kind"))
    return media.download_order(e, "event_id").select("event_id", "kind", F.col("priority").cast("long").alias("priority"))


def heading_lines(spark, folder):
    """Every line of the documents with its offset and the heading that holds for it."""
    d = load(spark, folder, "documents")
    rows = unnest(d, ["doc_id"], policy.heading_carry(F.col("text")), "x", "n")
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.col("x.state.offset").cast("long").alias("start"), F.col("x.item.alone").alias("alone"),
                       F.md5(F.coalesce("x.item.own", "x.state.heading").cast("binary")).alias("heading_md5"))


def same_site_links(spark, folder):
    return extract.site_links(pages(spark, folder)).select("page_id", "link")


def compacted_items(spark, folder):
    """Three writes with a snapshot after the second: one task's items, of which the last write takes some away."""
    at = _scratch(spark)
    e = load(spark, folder, "events").select((F.col("user_id") % 3).alias("task_id"), F.concat(F.lit("http://h/"), F.col("event_id").cast("string")).alias("url"),
                                             F.col("event_type").alias("kind"), F.col("event_id").alias("index"), "event_id", F.lit("a").alias("album"))
    tables.upsert_media_items(e, at, 1)
    tables.upsert_media_items(e.filter(F.col("event_id") % 2 == 0).withColumn("album", F.lit("b")), at, 2)
    tables.compact_media_items(spark, at)
    moved = e.filter(F.col("event_id") % 5 == 0).withColumns({"album": F.lit("c"), "task_id": (F.col("task_id") + 1) % 3})
    tables.upsert_media_items(moved, at, 3)
    return tables.read_media_items(spark, at, 1).select("url", "kind", "album", "index")


def stream_first_seen(spark, folder):
    """Addresses of the event stream, each once, remembered in the table itself."""
    at = _scratch(spark)
    named = _events(spark, folder).select(F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit(".example.com/"), "event_type").alias("url"))
    streaming.run_first_seen(named, f"{at}/out", f"{at}/mark")
    return spark.read.parquet(f"{at}/out").select("url", "url_hash")


QUERIES = {"stream_first_seen": stream_first_seen, "compacted_items": compacted_items, "sitemap_addresses": sitemap_addresses, "direct_media": direct_media, "download_records": download_records, "report_table": report_table,
           "filter_file": filter_file, "queue_file": queue_file, "download_order": download_order, "heading_lines": heading_lines, "same_site_links": same_site_links}

_KIND_LIST = ", ".join(f"'{k}'" for k in KINDS)
_HEADING = policy.HEADING
_SITE = "lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1))"
_BLANK = r"'^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$'"
_CUT = "coalesce(" + ", ".join(f"CASE WHEN instr(line, '{m}') BETWEEN 2 AND {policy.PREFIX_MAX + 1} THEN instr(line, '{m}') END" for m in ("：", ":", "—", "-", "－")) + ", 0)"

SQL = {
    "stream_first_seen": streams.SQL["stream_new_urls"],
    "compacted_items": """SELECT 'http://h/' || event_id AS url, event_type AS kind, CASE WHEN event_id % 5 = 0 THEN 'c' WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS album, event_id AS "index"
        FROM events WHERE (user_id % 3 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % 3 = 1""",
    "sitemap_addresses": f"""
        WITH p AS (SELECT {_SITE} AS site, url, page_id % 3 AS k FROM pages),
             m AS (SELECT site, k, row_number() OVER (PARTITION BY site ORDER BY k) AS pos, count(*) OVER (PARTITION BY site) AS maps FROM (SELECT DISTINCT site, k FROM p))
        SELECT site, 'https://' || site || '/map' || k || '.xml' AS map_url, url AS loc, maps + row_number() OVER (PARTITION BY site ORDER BY pos, url) AS seen FROM p JOIN m USING (site, k)""",
    "direct_media": f"""SELECT event_id AS page_seq, 'http://m.example.com/' || event_type || '/' || event_id AS url, CASE event_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'hls' ELSE 'document' END AS kind,
        CASE WHEN event_type = 'view' AND event_id = 4 THEN '' ELSE 'http://m.example.com/view/4' END AS source_page, 'direct' AS origin, [{_KIND_LIST}][event_id % 5 + 1] AS content_type FROM events WHERE event_id % 2 = 0""",
    "download_records": "SELECT event_id % 2 + 1 AS write_seq, event_type, count(*) AS files, count(*) AS addresses FROM events GROUP BY ALL",
    "report_table": f"""WITH r AS (SELECT {_SITE} AS site, min(url) AS start_url, count(*) AS pages, count(*) FILTER (page_id % 3 = 0) AS hits FROM pages GROUP BY 1)
        SELECT s AS write_seq, site, start_url, 'rules' AS engine, pages, hits FROM r, (VALUES (1::BIGINT), (2::BIGINT)) v(s) WHERE s = 1 OR pages > 3""",
    "filter_file": """SELECT DISTINCT 'block' AS kind, CASE WHEN s_suppkey % 5 = 1 THEN 'ads' || s_suppkey % 40 ELSE 'p' || s_suppkey END AS value FROM supplier WHERE s_suppkey % 5 IN (1, 3, 4)
        UNION ALL SELECT DISTINCT 'allow', 'www.s' || s_suppkey % 30 || '.example.com' FROM supplier""",
    "queue_file": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'q.example.com:81' END AS name, 'https://q.example.com:81/' || s_suppkey AS start_url, (s_suppkey % 4)::INT AS max_depth, 2 AS max_retries,
        0.5::DOUBLE AS request_delay, 'pending' AS status, (s_suppkey % 2)::INT AS retry_count FROM supplier WHERE s_suppkey % 5 IN (0, 1, 3) AND s_suppkey % 7 <> 0""",
    "download_order": f"""WITH e AS (SELECT event_id, ['image', 'hls', 'audio', 'other', 'document'][event_id % 5 + 1] AS kind FROM events)
        SELECT event_id, kind, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TYPE_PRIORITY.items())} END::BIGINT AS priority FROM e""",
    "heading_lines": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
             m AS (SELECT *, line <> '' AND length(line) <= {policy.HEADING_MAX} AND NOT regexp_matches(line, '[。！？.!?]$') AND (regexp_matches(line, '{_HEADING}')
                     OR (NOT regexp_matches(line, '[，,、；;]$') AND length(line) <= {policy.SHORT_HEADING_MAX})) AS alone FROM l),
             o AS (SELECT *, CASE WHEN alone THEN left(line, {policy.HEADING_MAX}) WHEN regexp_matches(line, '{_HEADING}') THEN
                     nullif(regexp_replace(CASE WHEN {_CUT} > 0 THEN substr(line, 1, {_CUT} - 1) ELSE left(line, {policy.PREFIX_MAX}) END, {_BLANK}, '', 'g'), '') END AS own FROM m)
        SELECT doc_id, n, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, alone,
               md5(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS heading_md5 FROM o""",
    "same_site_links": rf"""
        WITH h AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1))) AS href FROM pages),
             a AS (SELECT DISTINCT page_id, url, regexp_replace(CASE WHEN starts_with(href, '/') THEN {sql_part('url', 1)} || '://' || {sql_part('url', 2)} || href ELSE href END, '#.*$', '') AS link FROM h)
        SELECT page_id, link FROM a WHERE regexp_matches(link, '^https?://') AND {sql_host('link')} = {sql_host('url')}""",
}
