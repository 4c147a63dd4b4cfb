"""Graph, book and task queries. Links come from the order and line item tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftweb.catalog.inputs import load, pages, quoted, sql_host, sql_part
from siftweb.functions import urls
from siftweb.operators import books, graph
from siftweb.operators import media as ops

def _edges(spark, folder):
    """Every order links to the orders numbered like its parts; links repeat, the walks drop repeated pages themselves."""
    name = lambda c: F.concat(F.lit("http://s"), F.col(c).cast("string"), F.lit(".example.com/"))
    return load(spark, folder, "lineitem").select(name("l_orderkey").alias("src"), name("l_partkey").alias("dst"))


def _seeds(spark, folder):
    return load(spark, folder, "region").select(F.concat(F.lit("http://s"), "r_regionkey", F.lit(".example.com/")).alias("url"))


def bfs_levels(spark, folder):
    return graph.bfs_crawl(_edges(spark, folder), _seeds(spark, folder), 4, block=[r"//s\d*13\."]).select("url", F.col("depth").cast("long").alias("depth"))


def bfs_budget(spark, folder):
    return graph.bfs_crawl(_edges(spark, folder), _seeds(spark, folder), 3, max_pages=40).select("url", F.col("depth").cast("long").alias("depth"))


def media_frontier(spark, folder):
    e = _edges(spark, folder).withColumn("paging", F.endswith("dst", F.lit("0.example.com/")))
    out = graph.media_frontier(e.filter(~F.col("paging")), e.filter("paging"), _seeds(spark, folder), 2, hard_cap=0)
    return out.select("url", F.col("depth").cast("long").alias("depth"))


def _chain(spark, folder):
    """Orders of a customer as the pages of a book; every fourth customer's last page points back."""
    o = load(spark, folder, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = F.first("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return o.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", first.alias("first"),
                    F.coalesce(F.lead("o_orderkey").over(w), F.when(F.col("o_custkey") % 4 == 0, first)).alias("next"))


#: page limit of ``chain_stops``; the other queries read whole books
LIMIT = 12


def _reading_order(spark, folder, limit=0):
    c = _chain(spark, folder)
    links = c.select(F.col("o_orderkey").alias("node"), "next")
    starts = c.filter(F.col("o_orderkey") == F.col("first")).select(F.col("o_orderkey").alias("node"))
    return graph.next_chain(links, starts, limit), links, c


def next_chain(spark, folder):
    return _reading_order(spark, folder)[0]


def chain_stops(spark, folder):
    chain, links, _ = _reading_order(spark, folder, LIMIT)
    return graph.chain_stop_reason(chain, links, LIMIT).select("start", "pages", "stop_reason")


def _book_pages(spark, folder):
    chain, _, c = _reading_order(spark, folder)
    body = F.when(F.col("o_orderkey") % 9 == 0, "").when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderpriority", F.lit(" first line")))
    rows = c.select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("title"),
                    F.coalesce(body, F.concat(F.lit("total "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("body"),
                    F.when(F.col("o_orderkey") % 9 == 0, "empty").otherwise("").alias("error"))
    return chain.join(rows, "node").withColumnRenamed("start", "book")


def assemble_book(spark, folder):
    return books.assemble_book(_book_pages(spark, folder))


def book_meta(spark, folder):
    m = books.book_metadata(_book_pages(spark, folder))
    return m.select("book", "page_count", "success_pages", "failed_pages", "total_chars",
                    F.array_join(F.transform("chapters", lambda c: c["title"]), ";").alias("chapters"))


def paginate(spark, folder):
    p = pages(spark, folder).withColumn("html", F.concat("html", F.lit('<a href="/next/2?x=1#f">Next page</a><a rel="next" href="?page=9">x</a>')))
    plain = pages(spark, folder).withColumn("page_id", F.col("page_id") + 1_000_000)
    return graph.next_pages(p.unionByName(plain), most=2).select("page_id", F.col("rank").cast("long").alias("rank"), "next_url")


def book_pages(spark, folder):
    p = pages(spark, folder)
    return books.read_book_pages(p.withColumn("html", F.concat("html", F.lit('<a href="two.html">下一章</a>')))).select(
        "page_id", "title", F.md5(F.regexp_replace("body", r"\s+", "").cast("binary")).alias("body_md5"), "linked", "guess")


def _tasks(spark, folder):
    """Orders as tasks; each depends on the order with half its key. A third depend on one hot task."""
    o = load(spark, folder, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", F.when(key % 10 == 0, "failed").otherwise("completed")) \
        .otherwise("pending")
    half = F.floor(key / 2)
    deps = F.when(key % 3 == 0, F.array(half, F.lit(20).cast("long"))).when(key > 0, F.array(half)).otherwise(F.array().cast("array<bigint>"))
    return o.select(key.alias("id"), F.concat(F.lit("task "), "o_orderkey").alias("name"), status.alias("status"), deps.alias("depends_on"),
                    F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), (key % 4).alias("retry_count"), F.lit(2).cast("long").alias("max_retries"),
                    (key % 100).alias("pages"), (key % 7).alias("links"), (key % 5).alias("media"), (key % 13).cast("double").alias("elapsed"))


def task_ready(spark, folder):
    return graph.ready_tasks(_tasks(spark, folder)).select("id", "priority")


def pending_order(spark, folder):
    return graph.pending_order(_tasks(spark, folder), 25).select("id", "priority")


def task_cascade(spark, folder):
    return graph.fail_cascade(_tasks(spark, folder)).select("id", "status", "retry_count", "error")


def task_summary(spark, folder):
    return graph.task_summary(_tasks(spark, folder))


def task_compare(spark, folder):
    return graph.compare_tasks(_tasks(spark, folder)).select("id", "status_text", "priority_text", "pages")


def merged_results(spark, folder):
    r = load(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("task_id"), F.col("l_partkey").alias("part")).distinct()
    return graph.merged_results(r, _tasks(spark, folder), list(range(0, 50, 2))).select("task_id", "part", "task_name")


def _hashes(spark, folder):
    """Difference hash of each embedding read as a 9 x 7 grid, copies added by label."""
    e = load(spark, folder, "embeddings")
    return e.select("vec_id", ops.difference_hash(F.col("embedding"), 9, 7).alias("h"), "label")


def diff_hash(spark, folder):
    return _hashes(spark, folder).select("vec_id", F.col("h").alias("hash"))


COPY = 1_000_000


def _copied(spark, folder):
    """Whole hashes; a third are one hot value, and every row has a copy with up to two bits turned over."""
    own = _hashes(spark, folder).select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.lit(77).cast("long")).otherwise(F.col("h")).alias("h"))
    bit = lambda k: F.expr(f"shiftleft(1L, CAST(vec_id % {k} AS INT))")
    return own.unionByName(own.select((F.col("vec_id") + COPY).alias("vec_id"), F.col("h").bitwiseXOR(bit(53)).bitwiseXOR(bit(47)).alias("h")))


def near_pairs(spark, folder):
    return ops.near_duplicate_pairs(_copied(spark, folder), "vec_id", "h", 3).select("a_key", "b_key", "a_copies", "b_copies", "distance")


def near_groups(spark, folder):
    return ops.perceptual_groups(_copied(spark, folder).withColumn("at", F.col("vec_id")), "vec_id", "h", "at", 3).select("vec_id", "keeper_order")


QUERIES = {
    "bfs_levels": bfs_levels, "bfs_budget": bfs_budget, "media_frontier": media_frontier, "next_chain": next_chain, "chain_stops": chain_stops,
    "assemble_book": assemble_book, "book_meta": book_meta, "paginate": paginate, "book_pages": book_pages, "task_ready": task_ready,
    "pending_order": pending_order, "task_cascade": task_cascade, "task_summary": task_summary, "task_compare": task_compare,
    "merged_results": merged_results, "diff_hash": diff_hash, "near_pairs": near_pairs, "near_groups": near_groups,
}

_EDGE = """edge AS (SELECT DISTINCT 'http://s' || l_orderkey || '.example.com/' AS src, 'http://s' || l_partkey || '.example.com/' AS dst FROM lineitem), seed AS (SELECT 'http://s' || r_regionkey || '.example.com/' AS url FROM region)"""


def _levels(depth: int, ok: str) -> str:
    """Level tables one after the other, so that a level is known before the next starts."""
    parts = [_EDGE, f"l0 AS MATERIALIZED (SELECT DISTINCT url, 0 AS depth FROM seed WHERE {ok})", "v0 AS (FROM l0)"]
    for d in range(1, depth + 1):
        parts.append(f"l{d} AS MATERIALIZED (SELECT DISTINCT dst AS url, {d} AS depth FROM edge JOIN l{d - 1} ON src = url WHERE {ok.replace('url', 'dst')} AND dst NOT IN (SELECT url FROM v{d - 1}))")
        parts.append(f"v{d} AS MATERIALIZED (FROM v{d - 1} UNION ALL FROM l{d})")
    return ", ".join(parts)


_CHAIN = f"""c AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, row_number() OVER w - 1 AS dist, min(o_orderkey) OVER (PARTITION BY o_custkey) AS book,
      count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    page AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN o_orderpriority || ' first line'
      ELSE 'total ' || o_totalprice::DECIMAL(18,2) END AS body FROM c)"""
_TASK = """t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'completed' END
      ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey // 2, 20] WHEN o_orderkey > 0 THEN [o_orderkey // 2] ELSE [] END AS deps,
      substr(o_orderpriority, 1, 1)::BIGINT AS priority, o_orderkey % 4 AS rc, o_orderkey AS k FROM orders)"""
_READY = """w AS (SELECT DISTINCT p.id FROM (SELECT id, unnest(deps) AS dep FROM t WHERE status = 'pending') p JOIN t d ON d.id = p.dep AND d.status <> 'completed'),
      r AS (SELECT id, priority FROM t WHERE status = 'pending' AND id NOT IN (FROM w))"""
_BITS = [r * 9 + c for r in range(7) for c in range(8)]
_HASH = "(" + " + ".join(f"CASE WHEN embedding[{i + 1}] < embedding[{i + 2}] THEN {1 << (len(_BITS) - 1 - n)} ELSE 0 END" for n, i in enumerate(_BITS)) + ")::BIGINT"
_COPIED = f"o AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 77 ELSE {_HASH} END AS h FROM embeddings), " \
    f"k AS (SELECT vec_id, h FROM o UNION ALL SELECT vec_id + {COPY}, xor(xor(h, 1::BIGINT << (vec_id % 53)::INT), 1::BIGINT << (vec_id % 47)::INT) FROM o), g AS (SELECT h, min(vec_id) AS first, count(*) AS copies FROM k WHERE h <> 0 GROUP BY 1)"
_ROOT = f"({sql_part('url', 1)} || '://' || {sql_part('url', 2)})"
_PATHQ = f"({sql_part('url', 3)})"

SQL = {
    "bfs_levels": f"WITH {_levels(4, chr(78) + 'OT regexp_matches(url, ' + chr(39) + '//s[0-9]*13[.]' + chr(39) + ')')} SELECT url, depth::BIGINT AS depth FROM v4",
    "bfs_budget": f"""WITH {_levels(3, 'true')}, n AS (SELECT *, row_number() OVER (ORDER BY depth, url) AS rn FROM v3) SELECT url, depth::BIGINT AS depth FROM n WHERE rn <= 40""",
    "media_frontier": f"""WITH RECURSIVE {_EDGE}, walk(url, depth) AS (SELECT url, 0 FROM seed UNION
        SELECT dst, depth + CASE WHEN dst LIKE '%0.example.com/' THEN 0 ELSE 1 END FROM walk JOIN edge ON src = url WHERE depth < 2 OR dst LIKE '%0.example.com/')
        SELECT url, min(depth)::BIGINT AS depth FROM walk GROUP BY url""",
    "next_chain": f"WITH {_CHAIN} SELECT book AS start, o_orderkey AS node, dist FROM page",
    "chain_stops": f"""WITH {_CHAIN} SELECT book AS start, least(max(dist) + 1, {LIMIT}) AS pages,
        CASE WHEN max(n) > {LIMIT} THEN 'limit' WHEN o_custkey % 4 <> 0 THEN 'end' WHEN max(n) = {LIMIT} THEN 'limit' ELSE 'loop' END AS stop_reason
        FROM page GROUP BY book, o_custkey""",
    "assemble_book": f"""WITH {_CHAIN}, b AS (SELECT *, NOT starts_with(body, o_orderpriority) AS cand FROM page WHERE body <> ''),
        h AS (SELECT *, last_value(CASE WHEN cand THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY book ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b)
        SELECT book, string_agg(CASE WHEN cand AND o_orderpriority IS DISTINCT FROM prev THEN o_orderpriority || chr(10) || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY dist) || chr(10) AS text
        FROM h GROUP BY 1""",
    "book_meta": f"""WITH {_CHAIN} SELECT book, count(*) AS page_count, count(*) FILTER (body <> '') AS success_pages, count(*) FILTER (body = '') AS failed_pages,
        sum(length(body))::BIGINT AS total_chars, coalesce(string_agg(o_orderpriority, ';' ORDER BY dist) FILTER (body <> ''), '') AS chapters FROM page GROUP BY 1""",
    "task_ready": f"WITH {_TASK}, {_READY} SELECT id, priority FROM r",
    "pending_order": f"WITH {_TASK}, {_READY} SELECT id, priority FROM r ORDER BY priority, id LIMIT 25",
    "task_cascade": f"""WITH RECURSIVE {_TASK}, s AS (SELECT id, deps, CASE WHEN status = 'failed' AND rc < 2 THEN 'pending' ELSE status END AS status,
          CASE WHEN status = 'failed' AND rc < 2 THEN rc + 1 ELSE rc END AS retry_count FROM t),
        e AS (SELECT id, unnest(deps) AS dep FROM s WHERE status = 'pending'),
        f(id, lvl, cause) AS (SELECT id, 0, NULL::BIGINT FROM s WHERE status = 'failed' UNION ALL
          SELECT e.id, f.lvl + 1, e.dep FROM f JOIN e ON e.dep = f.id WHERE e.id <> e.dep),
        b AS (SELECT id, min(lvl) AS lvl FROM f GROUP BY 1),
        c AS (SELECT f.id, min(f.cause) AS cause FROM f JOIN b ON b.id = f.id AND b.lvl = f.lvl AND f.lvl > 0 GROUP BY 1)
        SELECT s.id, CASE WHEN c.id IS NOT NULL THEN 'failed' ELSE status END AS status, retry_count,
               CASE WHEN c.id IS NOT NULL THEN '依赖任务（任务' || cause || '）已失败' ELSE '' END AS error FROM s LEFT JOIN c USING (id)""",
    "task_summary": f"""WITH {_TASK} SELECT count(*) AS total, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in graph.TASK_STATES)},
        sum(k % 100)::BIGINT AS pages, sum(k % 7)::BIGINT AS links, sum(k % 5)::BIGINT AS media, sum(k % 13)::DOUBLE AS elapsed FROM t""",
    "task_compare": f"""WITH {_TASK} SELECT id, CASE status WHEN 'pending' THEN '待执行' WHEN 'completed' THEN '已完成' ELSE '失败' END AS status_text,
        CASE priority WHEN 1 THEN '中' WHEN 2 THEN '低' ELSE '-' END AS priority_text, k % 100 AS pages FROM t""",
    "merged_results": """SELECT DISTINCT l_orderkey % 50 AS task_id, l_partkey AS part, 'task ' || l_orderkey % 50 AS task_name FROM lineitem
        WHERE l_orderkey % 50 % 2 = 0""",
    "diff_hash": f"SELECT vec_id, {_HASH} AS hash FROM embeddings",
    "near_pairs": f"""WITH {_COPIED} SELECT a.first AS a_key, b.first AS b_key, a.copies AS a_copies, b.copies AS b_copies, bit_count(xor(a.h, b.h))::BIGINT AS distance
        FROM g a JOIN g b ON a.first < b.first AND bit_count(xor(a.h, b.h)) <= 3""",
    "near_groups": f"""WITH RECURSIVE {_COPIED}, d AS (SELECT h, first, row_number() OVER (ORDER BY first) AS n FROM g),
        walk(n, keepers, keeper) AS (
            SELECT 0::BIGINT, []::STRUCT(first BIGINT, h BIGINT)[], NULL::BIGINT
            UNION ALL SELECT n, CASE WHEN near IS NULL THEN list_append(keepers, {{'first': first, 'h': h}}) ELSE keepers END, coalesce(near, first) FROM (
                SELECT d.n, d.first, d.h, w.keepers, list_filter(w.keepers, lambda k: bit_count(xor(k.h, d.h)) <= 3)[1].first AS near FROM walk w JOIN d ON d.n = w.n + 1))
        SELECT k.vec_id, w.keeper AS keeper_order FROM k JOIN d USING (h) JOIN walk w ON w.n = d.n""",
    "paginate": f"""
        WITH p AS (SELECT page_id, url, {_ROOT} AS root, {sql_part('url', 3)} AS path, {sql_part('url', 4)} AS q, 0 AS plain FROM pages
                   UNION ALL SELECT page_id + 1000000, url, {_ROOT}, {sql_part('url', 3)}, {sql_part('url', 4)}, 1 FROM pages),
             own AS (SELECT *, regexp_extract(q, '(?:^|&)page=([0-9]+)', 1) AS pg, CASE WHEN path = '' THEN root ELSE root || path END AS base FROM p),
             c AS (SELECT page_id, 0 AS o, base || '?page=9' AS u, url FROM own WHERE plain = 0
                   UNION ALL SELECT page_id, 1, root || '/next/2?x=1', url FROM own WHERE plain = 0
                   UNION ALL SELECT page_id, 2, base || '?' || regexp_replace(q, '(^|&)page=[0-9]+', '\\1page=' || (pg::BIGINT + 1)), url FROM own WHERE pg <> ''
                   UNION ALL SELECT page_id, 2, base || '?page=9' || '', url FROM own WHERE false),
             d AS (SELECT page_id, u, min(o) AS o FROM c WHERE u <> url GROUP BY 1, 2),
             r AS (SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS rank FROM d)
        SELECT page_id, rank, u AS next_url FROM r WHERE rank < 2""",
}
