"""Queries of the media inventory. Candidates are derived from the event and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftweb.catalog.inputs import load, quoted, sql_canonical, sql_host, sql_part
from siftweb.functions import fixed, html, media, urls
from siftweb.operators import extract
from siftweb.operators import media as ops
from siftweb.session import cut_lineage
from siftweb.sources.pages import as_pages

CONFIG = ops.MediaConfig(kinds=("image", "video", "audio"), min_width=20, min_size=50, max_size=40_000, max_count=400,
                         block=(r"/e[0-9]*7\.",))
EVENT_BLOCK = 1 << 20

_EXT = {"view": ".jpg", "click": ".mp4", "signup": ".svg", "purchase": ".mp3", "error": ".html"}
_CT = {"view": "image/jpeg; q=1", "click": "application/x-mpegURL", "signup": "text/html", "purchase": "application/octet-stream",
       "error": ""}


def _by_type(values):
    out = F.lit("")
    for kind, value in values.items():
        out = F.when(F.col("event_type") == kind, value).otherwise(out)
    return out


def candidates(spark, folder):
    """One media candidate per event; a third of the rows name one of few addresses."""
    e = load(spark, folder, "events")
    number = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5).otherwise(F.col("event_id") % 1500)
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_id").alias("arrival"), "event_type",
        F.concat(F.lit("http://CDN"), (F.col("user_id") % 4).cast("string"), F.lit(".example.com/e"), number.cast("string"),
                 _by_type(_EXT), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("?utm_id="), F.col("user_id").cast("string"))).otherwise("")).alias("url"),
        F.concat(F.lit("https://site"), (F.col("user_id") % 3).cast("string"), F.lit(".example.org:8080/p")).alias("source_page"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("album "), (F.col("event_id") % 2).cast("string"))).otherwise("").alias("album"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t/"), F.col("event_id").cast("string"))).otherwise("").alias("title"),
        F.lit("").alias("ext"), (cents % 100).alias("width"), F.lit(0).cast("long").alias("height"), cents.alias("size"),
        F.lit("html").alias("origin")).withColumn("kind", media.kind_of(F.col("url")))


def _labelled(spark, folder):
    return ops.label_media(candidates(spark, folder), CONFIG)


def _items(spark, folder):
    return ops.kept_items(cut_lineage(_labelled(spark, folder)), block=F.floor(F.col("arrival") / EVENT_BLOCK))


def media_labels(spark, folder):
    return _labelled(spark, folder).select("arrival", "url_key", "label")


def media_pipeline(spark, folder):
    return _items(spark, folder).select("url", "kind", "source_page", "album", "title", "width", "size", "mentions", "index")


def media_stats(spark, folder):
    return ops.media_stats(_labelled(spark, folder))


def media_names(spark, folder):
    items = _items(spark, folder).withColumn("ext", urls.ext_of(F.col("url")))
    name = urls.media_filename(F.col("album"), F.col("title"), F.col("index"), F.col("kind"), F.col("ext"), F.col("url"))
    named = items.withColumn("file_name", name).withColumn("safe_title", urls.safe_name(F.col("title"), "untitled"))
    return ops.save_paths(named, ["arrival"]).select("url", "file_name", "safe_title", "save_path")


def media_kind(spark, folder):
    c = candidates(spark, folder).withColumn("ct", _by_type(_CT))
    res = F.when(F.col("arrival") % 5 == 0, "image").when(F.col("arrival") % 5 == 1, "media").when(F.col("arrival") % 5 == 2, "script").otherwise("xhr")
    return c.select("arrival", F.col("kind").alias("by_url"), media.kind_of(F.col("url"), F.col("ct")).alias("kind"),
                    media.guess_extension(F.col("ct")).alias("guessed"), media.has_media_ext(F.col("url")).alias("media_ext"),
                    media.event_kind(F.col("url"), F.col("ct"), res).alias("event_kind"))


def network_media(spark, folder):
    c = candidates(spark, folder).withColumn("ct", _by_type(_CT))
    noisy = F.when(F.col("arrival") % 11 == 0, F.concat(F.lit("https://x.doubleclick.net/"), F.col("arrival").cast("string"), F.lit(".gif"))) \
        .when(F.col("arrival") % 13 == 0, F.lit("https://h.example.com/track/p.png")).otherwise(F.col("url"))
    events = c.select((F.col("arrival") % 50).alias("page_id"), F.col("source_page").alias("base_url"), F.col("arrival").alias("pos"),
                      noisy.alias("url"), F.lit("xhr").alias("resource_type"),
                      F.when(F.col("arrival") % 17 == 0, 404).otherwise(200).alias("status"), F.col("ct").alias("content_type"),
                      F.create_map(F.lit("Cookie"), F.lit("a=1"), F.lit("X-Other"), F.lit("y")).alias("request_headers"))
    found = extract.extract_media_network(events)
    return found.select("page_seq", "pos", "url", "kind", F.try_element_at("headers", F.lit("Referer")).alias("referer"),
                        F.size("headers").cast("long").alias("headers"))


def thumb_upgrade(spark, folder):
    p = load(spark, folder, "part")
    return p.select("p_partkey", _part_url().alias("url")).select("p_partkey", "url", urls.upgrade_thumbnail(F.col("url")).alias("original"))


def _part_url():
    key = F.col("p_partkey").cast("string")
    n = F.col("p_size") % 6
    tail = (F.when(n == 0, F.concat(F.lit("/thumb/"), key, F.lit(".jpg"))).when(n == 1, F.concat(F.lit("/a/"), key, F.lit("_s.png")))
            .when(n == 2, F.concat(F.lit("/a/"), key, F.lit(".jpg?w=10&v=2"))).when(n == 3, F.concat(F.lit("/a/"), key, F.lit("?w=10")))
            .when(n == 4, F.concat(F.lit("/SMALL/"), key, F.lit(".gif"))).otherwise(F.concat(F.lit("/a/"), key, F.lit(".webp"))))
    return F.concat(F.lit("https://img.example.com"), tail)


def _part_pages(spark, folder):
    """A gallery page per part, markup built from its columns."""
    p = load(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    markup = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit(' &amp; co</title><meta property="og:image" content="/og/'), key, F.lit('.jpg"></head><body>'),
        F.lit('<img src="'), _part_url(), F.lit('" alt="'), F.col("p_brand"), F.lit(' &lt;x&gt;">'),
        F.lit('<img src="q'), key, F.lit('.gif" srcset="s1.png 100w, s'), key, F.lit('.png 200w">'),
        F.lit('<img data-original="o'), key, F.lit('.png" srcset="b.png 2x" src="z.gif">'),
        F.lit('<video poster="/p.jpg" src="../v'), key, F.lit('.mp4"></video>'),
        F.lit('<a href="/dl/f.mp3">f</a><a href="/terms">Terms</a><script>var u="//cdn.example.net/'), key,
        F.lit('.m3u8?k=1";</script><div style="background:url(/bg.png)"></div></body></html>'))
    return as_pages(p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/d/"), key).alias("url"), markup.alias("html")))


def media_tags(spark, folder):
    return extract.extract_media_html(_part_pages(spark, folder)).select(
        F.col("page_seq").alias("page_id"), "pos", "url", "kind", "album", "title", F.col("index").alias("doc_index"), "origin")


def media_links(spark, folder):
    return extract.extract_media_links(_part_pages(spark, folder)).select("page_id", "media_url")


def json_walk(spark, folder):
    """Interface answers built from the event columns, three levels deep."""
    e = load(spark, folder, "events").withColumn("n", F.col("event_id").cast("string"))
    doc = F.to_json(F.struct(
        F.col("event_type").alias("name"), F.concat(F.lit("/pic/"), "n", F.lit(".jpg")).alias("cover"),
        F.array(F.struct(F.concat(F.lit("T"), "n").alias("title"), F.concat(F.lit("//cdn.example.com/"), "n", F.lit(".mp4")).alias("file"),
                         F.struct(F.concat(F.lit("/raw/"), "n").alias("original"), F.lit("plain text").alias("note")).alias("more"))).alias("items"),
        F.col("props").alias("props")))
    pages = as_pages(e.select(F.col("event_id").alias("page_id"), F.lit("https://api.example.com/v1/list").alias("url"), F.lit("").alias("html"), doc.alias("json_text")))
    return extract.extract_media_json(pages).select(F.col("page_seq").alias("page_id"), "url", "kind", "title", "origin")


def merged_sources(spark, folder):
    """Two extractors naming the same addresses: fields complete each other."""
    c = candidates(spark, folder).select((F.col("arrival") % 300).alias("page_seq"), F.col("arrival").alias("pos"), "url", "kind",
                                         "source_page", "album", "title", "ext", "width", "size", "event_type")
    c = c.withColumn("origin", F.when(F.col("event_type") == "view", "network").otherwise("html")) \
        .withColumn("priority", F.when(F.col("event_type") == "view", 60).otherwise(80))
    c = c.withColumn("headers", F.when(F.col("origin") == "network", F.create_map(F.lit("Referer"), F.col("source_page")))
                     .otherwise(F.create_map().cast("map<string,string>")))
    return ops.union_sources(c.drop("event_type")).select(
        "page_seq", "url", "album", "title", "origin", "width", "mentions", F.try_element_at("headers", F.lit("Referer")).alias("referer"))


QUERIES = {
    "media_labels": media_labels, "media_pipeline": media_pipeline, "media_stats": media_stats, "media_names": media_names,
    "media_kind": media_kind, "network_media": network_media, "thumb_upgrade": thumb_upgrade, "media_tags": media_tags,
    "media_links": media_links, "json_walk": json_walk, "merged_sources": merged_sources,
}


def _sql_case(values):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_KINDS = {".jpg": "image", ".mp4": "video", ".svg": "image", ".mp3": "audio", ".html": "other"}
_CAND = f"""cand0 AS (
    SELECT event_id AS arrival, event_type, user_id,
           'http://CDN' || user_id % 4 || '.example.com/e' || CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE event_id % 1500 END
             || {_sql_case(_EXT)} || CASE WHEN event_id % 4 = 0 THEN '?utm_id=' || user_id ELSE '' END AS url,
           'https://site' || user_id % 3 || '.example.org:8080/p' AS source_page,
           CASE WHEN event_id % 7 = 0 THEN 'album ' || event_id % 2 ELSE '' END AS album,
           CASE WHEN event_id % 2 = 0 THEN 't/' || event_id ELSE '' END AS title,
           round(value * 100)::BIGINT % 100 AS width, round(value * 100)::BIGINT AS size,
           {_sql_case({t: _KINDS[x] for t, x in _EXT.items()})} AS kind FROM events),
  cand AS (SELECT *, sha256({sql_canonical('url')}) AS url_key,
           CASE WHEN kind NOT IN ('image', 'video', 'audio') THEN 'wrong_kind' WHEN event_type = 'signup' THEN 'svg'
                WHEN regexp_matches(url, '/e[0-9]*7\\.') THEN 'blocked' ELSE '' END AS early,
           CASE WHEN size > 0 AND size < 50 THEN 'too_small' WHEN size > 40000 THEN 'too_large'
                WHEN width > 0 AND width < 20 THEN 'too_small' ELSE '' END AS late FROM cand0),
  firsts AS (SELECT url_key, min(arrival) AS kept FROM cand WHERE early = '' AND late = '' GROUP BY 1),
  lim AS (SELECT CASE WHEN count(*) >= 400 THEN max(kept) END AS t FROM (SELECT kept FROM firsts ORDER BY kept LIMIT 400)),
  labelled AS (SELECT c.*, f.kept, CASE WHEN early <> '' THEN early
           WHEN t IS NOT NULL AND arrival > t AND (kept IS NULL OR kept > t) THEN 'truncated'
           WHEN arrival = kept THEN 'kept' WHEN arrival > kept THEN 'duplicate' ELSE late END AS label
           FROM cand c LEFT JOIN firsts f USING (url_key), lim),
  part_of AS (SELECT *, CASE WHEN label = 'kept' AND album = '' THEN replace({sql_part('source_page', 2)}, ':', '_') ELSE album END AS alb
           FROM labelled WHERE label IN ('kept', 'duplicate')),
  items AS (SELECT url_key, min(arrival) AS arrival, arg_min(url, arrival) AS url, arg_min(kind, arrival) AS kind,
           arg_min(source_page, arrival) AS source_page, arg_min(alb, arrival) AS album,
           coalesce(arg_min(title, arrival) FILTER (title <> ''), '') AS title,
           coalesce(arg_min(width, arrival) FILTER (width <> 0), 0) AS width, coalesce(arg_min(size, arrival) FILTER (size <> 0), 0) AS size,
           count(*) AS mentions FROM part_of GROUP BY 1),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY arrival) AS "index" FROM items)"""
_SAFE_TITLE = "regexp_replace(regexp_replace(title, '[\\\\/:*?\"<>|]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g')"
_PART_URL = """('https://img.example.com' || CASE p_size % 6 WHEN 0 THEN '/thumb/' || p_partkey || '.jpg' WHEN 1 THEN '/a/' || p_partkey || '_s.png'
    WHEN 2 THEN '/a/' || p_partkey || '.jpg?w=10&v=2' WHEN 3 THEN '/a/' || p_partkey || '?w=10'
    WHEN 4 THEN '/SMALL/' || p_partkey || '.gif' ELSE '/a/' || p_partkey || '.webp' END)"""
_ORIGINAL = """CASE p_size % 6 WHEN 0 THEN 'https://img.example.com/original/' || p_partkey || '.jpg' WHEN 1 THEN 'https://img.example.com/a/' || p_partkey || '.png'
    WHEN 2 THEN 'https://img.example.com/a/' || p_partkey || '.jpg?v=2' WHEN 4 THEN 'https://img.example.com/large/' || p_partkey || '.gif' ELSE '' END"""
_RES = "CASE arrival % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'media' WHEN 2 THEN 'script' ELSE 'xhr' END"
_MEDIA_EXTS = "(?i)\\.(?:jpg|mp4|svg|mp3)(?:[?#]|$)"

SQL = {
    "media_labels": f"WITH {_CAND} SELECT arrival, url_key, label FROM labelled",
    "media_pipeline": f"WITH {_CAND} SELECT url, kind, source_page, album, title, width, size, mentions, \"index\" FROM numbered",
    "media_stats": f"WITH {_CAND} SELECT count(*) AS total, " + ", ".join(
        f"count(*) FILTER (label = '{n}') AS {n}" for n in
        ["kept", "duplicate", "wrong_kind", "svg", "blocked", "too_small", "too_large", "truncated"]) + " FROM labelled",
    "media_names": f"""WITH {_CAND},
        n AS (SELECT *, {_SAFE_TITLE} AS st, regexp_extract(url, '(\\.[a-z0-9]+)(?:\\?|$)', 1) AS ext,
                     regexp_extract(url, '/(e[^/?]*)', 1) AS base FROM numbered),
        p AS (SELECT *, kind || '/' || {sql_part('url', 2)} || '/' || base AS plain FROM n),
        o AS (SELECT *, first_value(url) OVER (PARTITION BY plain ORDER BY arrival) AS owner FROM p)
        SELECT url, album || '/' || CASE WHEN "index" < 1000 THEN lpad("index"::VARCHAR, 3, '0') ELSE "index"::VARCHAR END || '_' || st || ext AS file_name,
               CASE WHEN st = '' THEN 'untitled' ELSE st END AS safe_title,
               CASE WHEN owner = url THEN plain ELSE regexp_replace(plain, '\\.[^.]*$', '') || '_' || left(sha256(url), 8) || ext END AS save_path
        FROM o""",
    "media_kind": f"""WITH {_CAND}
        SELECT arrival, kind AS by_url,
               CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'hls' WHEN 'signup' THEN 'image' WHEN 'purchase' THEN 'audio' ELSE 'other' END AS kind,
               CASE event_type WHEN 'view' THEN '.jpg' WHEN 'click' THEN '.m3u8' WHEN 'signup' THEN '.html' ELSE '.bin' END AS guessed,
               regexp_matches(url, '{_MEDIA_EXTS}') AS media_ext,
               CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'hls' WHEN 'signup' THEN 'image' WHEN 'purchase' THEN 'audio'
                    ELSE CASE {_RES} WHEN 'image' THEN 'image' WHEN 'media' THEN 'video' ELSE '' END END AS event_kind
        FROM cand0""".replace("WHEN 'purchase' THEN '.bin' ELSE '.bin'", "ELSE '.bin'"),
    "network_media": f"""WITH {_CAND},
        e AS (SELECT *, CASE WHEN arrival % 11 = 0 THEN 'https://x.doubleclick.net/' || arrival || '.gif' WHEN arrival % 13 = 0 THEN
                     'https://h.example.com/track/p.png' ELSE url END AS u FROM cand0)
        SELECT arrival % 50 AS page_seq, arrival AS pos, u AS url,
               CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'hls' WHEN 'signup' THEN 'image' ELSE 'audio' END AS kind,
               source_page AS referer, 2 AS headers
        FROM e WHERE arrival % 17 <> 0 AND arrival % 11 <> 0 AND arrival % 13 <> 0 AND event_type <> 'error'""",
    "thumb_upgrade": f"SELECT p_partkey, {_PART_URL} AS url, {_ORIGINAL} AS original FROM part",
    "media_tags": f"""
        WITH p AS (SELECT p_partkey AS k, p_name || ' & co' AS album, p_brand || ' <x>' AS alt, {_PART_URL} AS u, {_ORIGINAL} AS o, p_size % 6 AS n FROM part),
        c AS (SELECT k, album, 0 AS a, 0 AS b, u AS url, alt AS title, 'html:img' AS origin FROM p WHERE n <> 3
              UNION ALL SELECT k, album, 0, 1, o, alt, 'html:img+upgrade' FROM p WHERE n <> 3 AND o <> ''
              UNION ALL SELECT k, album, 1, 0, 'https://shop.example.com/d/s' || k || '.png', '', 'html:srcset' FROM p
              UNION ALL SELECT k, album, 2, 0, 'https://shop.example.com/d/o' || k || '.png', '', 'html:img' FROM p
              UNION ALL SELECT k, album, 3, 0, 'https://shop.example.com/d/b.png', '', 'html:srcset' FROM p
              UNION ALL SELECT k, album, 4, 0, 'https://shop.example.com/v' || k || '.mp4', '', 'html:video' FROM p
              UNION ALL SELECT k, album, 5, 0, 'https://shop.example.com/p.jpg', '', 'html:poster' FROM p
              UNION ALL SELECT k, album, 6, 0, 'https://shop.example.com/og/' || k || '.jpg', '', 'html:og:image' FROM p
              UNION ALL SELECT k, album, 7, 0, 'https://shop.example.com/bg.png', '', 'html:css' FROM p
              UNION ALL SELECT k, album, 8, 0, 'https://cdn.example.net/' || k || '.m3u8?k=1', '', 'html:js' FROM p
              UNION ALL SELECT k, album, 9, 0, 'https://shop.example.com/dl/f.mp3', '', 'html:a-href' FROM p)
        SELECT k AS page_id, row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS pos, url,
               CASE WHEN url LIKE '%.mp4' THEN 'video' WHEN url LIKE '%.m3u8%' THEN 'hls' WHEN url LIKE '%.mp3' THEN 'audio' ELSE 'image' END AS kind,
               album, title, sum(1 - b) OVER (PARTITION BY k ORDER BY a, b)::BIGINT AS doc_index, origin FROM c""",
    "media_links": f"""
        WITH p AS (SELECT p_partkey AS k, {_PART_URL} AS u FROM part)
        SELECT k AS page_id, unnest([u, 'https://shop.example.com/d/q' || k || '.gif', 'https://shop.example.com/d/z.gif',
            'https://shop.example.com/v' || k || '.mp4', 'https://shop.example.com/p.jpg', 'https://shop.example.com/d/s1.png',
            'https://shop.example.com/d/b.png', 'https://cdn.example.net/' || k || '.m3u8?k=1', 'https://shop.example.com/dl/f.mp3']) AS media_url FROM p""",
    "json_walk": """
        SELECT event_id AS page_id, 'https://api.example.com/pic/' || event_id || '.jpg' AS url, 'image' AS kind, event_type AS title, 'json' AS origin FROM events
        UNION ALL SELECT event_id, 'https://cdn.example.com/' || event_id || '.mp4', 'video', 'T' || event_id, 'json' FROM events
        UNION ALL SELECT event_id, 'https://api.example.com/raw/' || event_id, 'image', 'T' || event_id, 'json:hint' FROM events""",
    "merged_sources": f"""WITH {_CAND},
        c AS (SELECT *, arrival % 300 AS page_seq, event_type = 'view' AS net, CASE WHEN event_type = 'view' THEN 60 ELSE 80 END * 100000000000 + arrival AS ord FROM cand)
        SELECT page_seq, arg_min(url, ord) AS url, coalesce(arg_min(album, ord) FILTER (album <> ''), '') AS album,
               coalesce(arg_min(title, ord) FILTER (title <> ''), '') AS title, arg_min(CASE WHEN net THEN 'network' ELSE 'html' END, ord) AS origin,
               coalesce(arg_min(width, ord) FILTER (width <> 0), 0) AS width, count(*) AS mentions,
               arg_min(source_page, ord) FILTER (net) AS referer FROM c GROUP BY page_seq, url_key""",
}
