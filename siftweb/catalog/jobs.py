"""Whole jobs and their parts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftweb.catalog import audit as audit_catalog
from siftweb.catalog import graphs as graphs_catalog
from siftweb.catalog import media as media_catalog
from siftweb.catalog import pages as pages_catalog
from siftweb.catalog import risk as risk_catalog
from siftweb.catalog.inputs import load, pages, sql_part
from siftweb.functions import urls
from siftweb.operators import graph, media
from siftweb.plans import jobs
from siftweb.sources import exports
from siftweb.sources.pages import as_pages, decode_bodies


def risk_scan_job(spark, folder):
    found = jobs.url_risk_scan(risk_catalog.crafted(spark, folder))["findings"]
    return found.select("url", "kind", "rule", "title", "detail", "severity", "regex", "auto_select")


def download_audit_job(spark, folder):
    items = load(spark, folder, "part").select(F.concat(F.lit("http://h/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_brand").alias("album"),
                                               F.col("p_size").cast("long").alias("width"), F.col("p_size").cast("long").alias("height"), F.lit(0.0).alias("duration"))
    return jobs.download_audit(audit_catalog._downloads(spark, folder), items, ["path"])["audited"].select("url", "path", "resource_type", "ok", "note")


def playlist_job(spark, folder):
    return jobs.playlist_inventory(audit_catalog._playlists(spark, folder), "l_orderkey")["hls_segments"]


def merged_stats(spark, folder):
    """Counters of the runs over even and odd events, added up."""
    labelled = media_catalog._labelled(spark, folder)
    parts = [media.media_stats(labelled.filter(F.col("arrival") % 2 == i)) for i in (0, 1)]
    return media.merge_stats(parts[0].unionByName(parts[1]))


def new_media(spark, folder):
    """Events as media rows; the addresses of the first user's events are known."""
    e = load(spark, folder, "events").select(F.concat(F.lit("http://h/"), (F.col("event_id") % 997).cast("string")).alias("url"), "event_id", "user_id", "event_type")
    e = e.withColumn("url", F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("url")))
    return media.new_media(e.drop("user_id"), e.filter(F.col("user_id") % 40 == 1)).select("url", "event_id", "event_type")


def decoded_bodies(spark, folder):
    """Documents as bodies in three charsets, one of them undeclared."""
    d = load(spark, folder, "documents")
    k = F.col("doc_id") % 3
    body = F.when(k == 0, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=UTF-16").when(k == 1, 'text/html;charset="utf-8"').otherwise("text/plain")
    out = decode_bodies(d.select("doc_id", body.alias("content"), kind.alias("content_type")))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def task_export(spark, folder):
    """The lines of the exported document, orders as task outputs."""
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("task "), "o_custkey").alias("task_name"),
                                             F.concat(F.lit("http://h/"), "o_custkey").alias("url"), F.col("o_orderpriority").alias("text"))
    return exports.task_lines(o, "2024-01-01 00:00:00").select("part", "value")


def paginate_rules(spark, folder):
    """Offsets and page numbers from templates, and links only, by the page's rule."""
    p = pages(spark, folder).withColumn("html", F.concat("html", F.lit('<a rel="next" href="/next/2?x=1">more</a>')))
    k, root = F.col("page_id") % 3, F.concat(urls.part(F.col("base_url"), 1), F.lit("://"), urls.url_domain(F.col("base_url")))
    rule = p.select("page_id", F.when(k == 0, "api_offset").when(k == 1, "page_param").otherwise("next_link").alias("strategy"),
                    F.when(k == 0, F.concat(root, F.lit("/list?o={n}"))).when(k == 1, F.concat(root, F.lit("/p{n}"))).alias("template"), F.lit("").alias("param"),
                    F.when(k == 0, 0).otherwise(1).alias("start"), F.when(k == 0, 20).otherwise(1).alias("step"))
    return graph.next_pages(p.withColumn("page_index", F.lit(3)), rule=rule).select("page_id", F.col("rank").cast("long").alias("rank"), "next_url")


def crawl_audit_job(spark, folder):
    """The link graph of all pages from every fortieth on, three steps deep, with the pages' figures."""
    p = pages(spark, folder)
    levels = jobs.crawl_audit(p, p.filter(F.col("page_id") % 40 == 0).select(F.col("base_url").alias("url")), 3)["levels"]
    return levels.select("url", F.col("depth").cast("long").alias("depth"), "chars", "links", "media")


def _book_site(spark, folder):
    """A page of markup per order; a customer's orders are a book, a quarter of the books lead back to their first page."""
    # few bytes a row become a page that is read with care: by order in many small tasks, which the window's few partitions would not give
    c = graphs_catalog._chain(spark, folder).repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    name = lambda n: F.concat(F.col(n).cast("string"), F.lit(".html"))
    body = F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderpriority", F.lit(" first line"))).otherwise(
        F.concat(F.lit("total "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    link = F.when(F.col("next").isNotNull(), F.concat(F.lit('<a id="next" href="'), name("next"), F.lit('">on</a>'))).otherwise("")
    html = F.concat(F.lit("<html><head><title>Shop</title></head><body><h1>"), "o_orderpriority", F.lit('</h1><nav><a href="/">home</a></nav><div id="content"><p>'),
                    body, F.lit("</p></div>"), link, F.lit("</body></html>"))
    site = c.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("http://b.example.com/"), name("o_orderkey")).alias("url"), html.alias("html"), "first")
    return as_pages(site.drop("first")), site.filter(F.col("page_id") == F.col("first")).select(F.col("url").alias("node"))


def book_job(spark, folder):
    """Whole books from raw pages: content, titles and next links read from the markup, pages followed and joined."""
    out = jobs.assemble_books(*_book_site(spark, folder))
    return out["texts"].join(out["stops"], F.col("book") == F.col("start")).select("book", "text", "pages", "stop_reason")


QUERIES = {"crawl_audit_job": crawl_audit_job, "book_job": book_job, "risk_scan_job": risk_scan_job, "download_audit_job": download_audit_job, "playlist_job": playlist_job, "merged_stats": merged_stats,
           "new_media": new_media, "decoded_bodies": decoded_bodies, "task_export": task_export, "paginate_rules": paginate_rules}

_ROOT = f"({sql_part('url', 1)} || '://' || {sql_part('url', 2)})"

_STEPS = ", ".join(f"""l{d} AS MATERIALIZED (SELECT DISTINCT dst AS url, {d} AS depth FROM e JOIN l{d - 1} ON src = url WHERE dst NOT IN (SELECT url FROM v{d - 1})),
    v{d} AS MATERIALIZED (FROM v{d - 1} UNION ALL FROM l{d})""" for d in (1, 2, 3))
_BOOKS = graphs_catalog._CHAIN.replace("CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN", "CASE WHEN")



def _book_sql() -> str:
    texts = graphs_catalog.SQL["assemble_book"].replace(graphs_catalog._CHAIN, _BOOKS)
    return f"""SELECT 'http://b.example.com/' || t.book || '.html' AS book, t.text, count(*) AS pages, CASE WHEN any_value(c.o_custkey) % 4 = 0 THEN 'loop' ELSE 'end' END AS stop_reason
        FROM ({texts}) t JOIN (SELECT o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS book FROM orders) c ON c.book = t.book GROUP BY t.book, t.text"""


SQL = {
    "crawl_audit_job": f"""WITH e AS (SELECT DISTINCT p.url AS src, l.link AS dst FROM ({pages_catalog._LINKS}) l JOIN pages p USING (page_id)),
        l0 AS MATERIALIZED (SELECT DISTINCT url, 0 AS depth FROM pages WHERE page_id % 40 = 0), v0 AS (FROM l0), {_STEPS}
        SELECT v.url, v.depth::BIGINT AS depth, s.chars, s.links, s.media FROM v3 v LEFT JOIN (
            SELECT url, chars, links, media FROM ({pages_catalog.SQL["crawl_stats"]}) JOIN pages USING (page_id)) s ON s.url = v.url""",
    "book_job": _book_sql(),
    "risk_scan_job": risk_catalog.SQL["risk_findings"],
    "download_audit_job": audit_catalog.SQL["download_verdict"],
    "playlist_job": audit_catalog.SQL["hls_segments"],
    "merged_stats": media_catalog.SQL["media_stats"],
    "new_media": """WITH e AS (SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE 'http://h/' || event_id % 997 END AS url, event_id, user_id, event_type FROM events)
        SELECT url, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM e
        WHERE url <> '' AND url NOT IN (SELECT url FROM e WHERE user_id % 40 = 1) GROUP BY url""",
    "decoded_bodies": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "task_export": """WITH l AS (SELECT o_orderkey AS task_id, 'http://h/' || o_custkey AS url, to_json({task_id: o_orderkey, task_name: 'task ' || o_custkey,
          url: 'http://h/' || o_custkey, text: o_orderpriority})::VARCHAR AS line FROM orders)
        SELECT 0 AS part, '{"exported_at":"2024-01-01 00:00:00","count":' || count(*) || ', "tasks": [' AS value FROM orders
        UNION ALL SELECT 1, CASE WHEN row_number() OVER (ORDER BY task_id, url) = 1 THEN '' ELSE ',' END || line FROM l UNION ALL SELECT 2, ']}'""",
    "paginate_rules": f"""SELECT page_id, 0::BIGINT AS rank, {_ROOT} || CASE page_id % 3 WHEN 0 THEN '/list?o=60' WHEN 1 THEN '/p4' ELSE '/next/2?x=1' END AS next_url FROM pages""",
}
