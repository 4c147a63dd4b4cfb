"""Audit queries: sessions, request logs, downloads, playlists, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftweb.catalog.inputs import load, quoted
from siftweb.functions import urls
from siftweb.operators import audit, playlists
from siftweb.operators import media as ops
from siftweb.scale import only


def last_write_wins(spark, folder):
    e = load(spark, folder, "events").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    return audit.last_write_wins(e.select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def _expiry(spark, folder):
    e = load(spark, folder, "events")
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 6
    value = (F.when(k == 0, sec.cast("string")).when(k == 1, (sec * 1000).cast("string")).when(k == 2, ((sec + 11644473600) * 1000000).cast("string"))
             .when(k == 3, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).when(k == 4, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
             .otherwise("soon"))
    return e.select("event_id", "user_id", value.alias("raw"), F.concat(F.lit(".Shop"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com")).alias("domain"),
                    "event_type", F.col("value").cast("string").alias("value"))


def epoch_clean(spark, folder):
    return _expiry(spark, folder).select("event_id", audit.normalize_epoch(F.col("raw")).alias("expiry"))


NOW = 1704200000


def expiry_rollup(spark, folder):
    rows = _expiry(spark, folder).withColumn("expiry", audit.normalize_epoch(F.col("raw"))).withColumn("domain", urls.normalize_cookie_domain(F.col("domain")))
    return audit.expiry_rollup(rows, NOW)


def cookie_fields(spark, folder):
    c = _expiry(spark, folder)
    site = F.when(F.col("event_type") == "view", "STRICT").when(F.col("event_type") == "click", "unspecified").when(F.col("event_type") == "error", "lax").otherwise("odd")
    return audit.domain_filter(c, "www.shop3.example.com", mode="same-site").select(
        "event_id", urls.normalize_cookie_domain(F.col("domain")).alias("domain"), audit.normalize_same_site(site).alias("same_site"))


def fingerprints(spark, folder):
    rows = _expiry(spark, folder).withColumn("name", F.col("event_id").cast("string"))
    a = audit.set_fingerprint(rows, "domain", ["name", "domain"], "value")
    b = audit.set_fingerprint(rows.repartition(3, "value"), "domain", ["name", "domain"], "value").withColumnRenamed("fingerprint", "again")
    changed = audit.set_fingerprint(rows.withColumn("value", F.when(F.col("event_id") == 0, "x").otherwise(F.col("value"))), "domain", ["name", "domain"], "value")
    return a.join(b, "domain").join(changed.withColumnRenamed("fingerprint", "changed"), "domain").select(
        "domain", (F.col("fingerprint") == F.col("again")).alias("stable"), (F.col("fingerprint") != F.col("changed")).alias("changed"))


def login_wall(spark, folder):
    p = load(spark, folder, "pages").withColumn("status", F.when(F.col("page_id") % 3 == 0, 0).when(F.col("page_id") % 3 == 1, 200).otherwise(403))
    return audit.login_wall(p, ["andthe", "onthe", "wasun"], ["erthan", "DASDER"], [200], text="html").select("page_id", "logged_in", "rule", "evidence", "conflict")


def rate_audit(spark, folder):
    e = load(spark, folder, "events")
    log = e.select(F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))).alias("host"),
                   F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20).alias("ts_us"), F.col("event_id").alias("id"))
    return audit.politeness_audit(log, 4, 5_000_000).select("id", "host", "in_window", "over_quota", "too_soon")


def _downloads(spark, folder):
    """Line items as download log rows."""
    li = load(spark, folder, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("string"))
    size = F.col("l_quantity").cast("long") * 1000
    ext = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".mp4", ".bin", ".m3u8")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    ct = F.element_at(F.array(*[F.lit(x) for x in ("image/jpeg", "text/html; charset=x", "video/mp4", "", "application/json")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    digest = F.md5(F.col("l_partkey").cast("string").cast("binary"))
    headers = F.when(F.col("l_linenumber") == 1, F.create_map(F.lit("Digest"), F.concat(F.lit("MD5="), F.upper(digest)))) \
        .when(F.col("l_linenumber") == 2, F.create_map(F.lit("Content-MD5"), F.base64(F.unhex(digest)))) \
        .when(F.col("l_linenumber") == 3, F.create_map(F.lit("Digest"), F.lit("md5=00"))).otherwise(F.create_map().cast("map<string,string>"))
    return li.select(F.concat(F.lit("http://h/"), F.col("l_partkey").cast("string"), ext).alias("url"), F.concat(F.lit("f/"), key).alias("path"),
                     F.when(F.col("l_returnflag") == "A", "video").otherwise("").alias("item_kind"), ct.alias("content_type"),
                     F.when(F.col("l_discount") >= 0.1, 404).otherwise(200).alias("status"), size.alias("expected"),
                     F.when(F.col("l_tax") > 0.07, size - 1).when(F.col("l_tax") == 0.0, 0).otherwise(size).alias("actual"),
                     digest.alias("md5"), audit.header_md5(headers).alias("expected_md5"),
                     F.when(F.col("l_quantity") < 5, "small").otherwise("").alias("problem"), F.col("l_quantity").alias("q"))


def download_verdict(spark, folder):
    return audit.download_verdict(_downloads(spark, folder)).select("url", "path", "resource_type", "ok", "note")


def download_totals(spark, folder):
    return audit.download_totals(audit.download_verdict(_downloads(spark, folder)))


def download_manifest(spark, folder):
    d = only(audit.download_verdict(_downloads(spark, folder)), F.col("ok")).withColumn("size", F.col("actual"))
    items = load(spark, folder, "part").select(F.concat(F.lit("http://h/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("url"), F.col("p_name").alias("album"),
                                               F.col("p_size").cast("long").alias("width"), (F.col("p_size") % 3).cast("long").alias("height"), F.lit(0.0).alias("duration"))
    return audit.manifest_line(audit.manifest_rows(d, items)).select("path", "line")


def exact_dedup(spark, folder):
    d = load(spark, folder, "documents").select("doc_id", F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("md5"))
    return ops.exact_dedup(d, "path", ["doc_id"]).select("doc_id", "kept_path", "is_duplicate")


def quality_audit(spark, folder):
    p = load(spark, folder, "part")
    files = p.select(F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".svg").when(F.col("p_partkey") % 5 == 1, ".mp4").otherwise(".png")).alias("path"),
                     F.floor("p_retailprice").alias("size"), F.col("p_size").cast("long").alias("width"), (F.col("p_size") % 7).cast("long").alias("height"))
    return ops.quality_audit(files, ops.MediaConfig(min_size=950, max_size=1060, min_width=10, min_height=3)).select("path", "problem")


def image_headers(spark, folder):
    """Header bytes of five image formats built from the part sizes."""
    p = load(spark, folder, "part").withColumn("w", F.col("p_partkey") % 3000 + 1).withColumn("h", F.col("p_size").cast("long") + 2)
    hexed = lambda c, n: F.lpad(F.hex(c), n * 2, "0")
    swap = lambda c, n: F.concat(*[F.substring(hexed(c, n), 2 * i + 1, 2) for i in reversed(range(n))])
    zero = F.lit("00" * 40)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(F.col("w"), 4), hexed(F.col("h"), 4), zero)
    gif = F.concat(F.lit("474946383961"), swap(F.col("w"), 2), swap(F.col("h"), 2), zero)
    bmp = F.concat(F.lit("424D" + "00" * 16), swap(F.col("w"), 4), swap(F.col("h"), 4), zero)
    jpg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0004FFFFFFC0001108"), hexed(F.col("h"), 2), hexed(F.col("w"), 2), zero)
    webp = F.concat(F.lit("52494646000000005745425056503858" + "00" * 8), swap(F.col("w") - 1, 3), swap(F.col("h") - 1, 3), zero)
    k = F.col("p_partkey") % 6
    data = F.unhex(F.when(k == 0, png).when(k == 1, gif).when(k == 2, bmp).when(k == 3, jpg).when(k == 4, webp).otherwise(zero))
    d = ops.image_dimensions(data)
    return p.select("p_partkey", d["width"].alias("width"), d["height"].alias("height"))


def _playlists(spark, folder):
    """A playlist per order, its segments from the line items."""
    li = load(spark, folder, "lineitem").select("l_orderkey", F.struct(
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"), "l_returnflag").alias("s"))
    lines = F.transform("s", lambda s: F.concat(
        F.lit("#EXTINF:"), s["q"].cast("string"), F.lit(".5,\n"), F.when(s["l_returnflag"] == "A", F.concat(F.lit("#EXT-X-BYTERANGE:"), (s["q"] * 10).cast("string"),
        F.when(s["l_partkey"] % 3 == 0, F.concat(F.lit("@"), s["l_partkey"].cast("string"))).otherwise(""), F.lit("\n"))).otherwise(""),
        F.lit("seg/"), s["l_partkey"].cast("string"), F.lit(".ts")))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    keyed = F.when(F.col("l_orderkey") % 7 == 0, '#EXT-X-KEY:METHOD=AES-128,URI="k1"\n').when(F.col("l_orderkey") % 7 == 1, '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k"\n') \
        .when(F.col("l_orderkey") % 7 == 2, '#EXT-X-KEY:METHOD=AES-128,URI="k1"\n#EXT-X-KEY:METHOD=AES-128,URI="k2"\n').otherwise("")
    text = F.concat(F.lit("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), (F.col("l_orderkey") % 50).cast("string"), F.lit("\n"), keyed, F.array_join(lines, "\n"),
                    F.when(F.col("l_orderkey") % 2 == 0, "\n#EXT-X-ENDLIST").otherwise(""))
    return g.select("l_orderkey", text.alias("text"), F.concat(F.lit("http://v.example.com/"), F.col("l_orderkey").cast("string"), F.lit("/i.m3u8")).alias("url"))


def hls_segments(spark, folder):
    return playlists.parse_hls(_playlists(spark, folder), "l_orderkey")[1]


def hls_summary(spark, folder):
    return playlists.hls_totals(_playlists(spark, folder), "l_orderkey").select("l_orderkey", "key_uri", "live", "error", "segments", "total_duration")


def hls_best(spark, folder):
    o = load(spark, folder, "orders").select("o_custkey", F.struct("o_orderkey", F.floor("o_totalprice").alias("bw")).alias("s"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    lines = F.transform("s", lambda s: F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), s["bw"].cast("string"), F.lit(',CODECS="avc1,mp4a",RESOLUTION='),
                                                ((s["o_orderkey"] % 4 + 1) * 320).cast("string"), F.lit("x240\n"),
                                                F.when(s["o_orderkey"] % 5 == 0, "").otherwise(F.concat(F.lit("v"), s["o_orderkey"].cast("string"), F.lit(".m3u8")))))
    p = g.select("o_custkey", F.concat(F.lit("#EXTM3U\n"), F.array_join(lines, "\n")).alias("text"), F.lit("http://v.example.com/a/m.m3u8").alias("url"))
    return playlists.best_variant(playlists.hls_variants(playlists.playlist_lines(p, "o_custkey"), "o_custkey"), "o_custkey")


def _manifests(spark, folder):
    p = load(spark, folder, "part")
    k = F.col("p_partkey").cast("string")
    timeline = F.concat(F.lit('<SegmentTimeline><S t="100" d="'), (F.col("p_size") + 1).cast("string"), F.lit('" r="2"/><S d="7"/></SegmentTimeline>'))
    text = F.concat(F.lit('<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" mediaPresentationDuration="PT0H0M10.5S"><BaseURL>v/</BaseURL><Period>'
                          '<AdaptationSet contentType="video"><SegmentTemplate media="$RepresentationID$_$Number%03d$.m4s" initialization="$RepresentationID$_i.mp4" startNumber="5" timescale="2" duration="4"/>'
                          '<Representation id="a'), k, F.lit('" bandwidth="500" width="640" height="360"/><Representation id="b'), k,
                    F.lit('" bandwidth="900" width="640" height="360"/></AdaptationSet><AdaptationSet mimeType="audio/mp4"><Representation id="s" bandwidth="64">'
                          '<SegmentTemplate media="s_$Time$.m4s" timescale="1">'), timeline, F.lit('</SegmentTemplate></Representation></AdaptationSet></Period></MPD>'))
    return p.select("p_partkey", text.alias("text"), F.concat(F.lit("http://d.example.com/"), k, F.lit("/m.mpd")).alias("url"))


def dash_segments(spark, folder):
    return playlists.parse_dash(_manifests(spark, folder), "p_partkey")[1].select("p_partkey", "segment_url", "sequence", "duration")


def dash_best(spark, folder):
    reps, _ = playlists.parse_dash(_manifests(spark, folder), "p_partkey")
    best = playlists.best_representation(reps, "p_partkey", 480)
    return best.join(reps, ["p_partkey", "rep"]).select("p_partkey", "id", "init_url", F.col("audio_rep").isNotNull().alias("has_audio"))


QUERIES = {
    "last_write_wins": last_write_wins, "epoch_clean": epoch_clean, "expiry_rollup": expiry_rollup, "cookie_fields": cookie_fields,
    "fingerprints": fingerprints, "login_wall": login_wall, "rate_audit": rate_audit, "download_verdict": download_verdict,
    "download_totals": download_totals, "download_manifest": download_manifest, "exact_dedup": exact_dedup, "quality_audit": quality_audit,
    "image_headers": image_headers, "hls_segments": hls_segments, "hls_summary": hls_summary, "hls_best": hls_best,
    "dash_segments": dash_segments, "dash_best": dash_best,
}

_EXP = """x AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 6 = 5 THEN NULL ELSE floor(epoch(ts))::BIGINT END AS expiry, 'shop' || user_id % 7 || '.example.com' AS domain FROM events)"""
_SIZE = lambda n: f"CASE WHEN {n} < 1024 THEN printf('%.1f B', ({n})::DOUBLE) ELSE printf('%.1f KB', ({n}) / 1024.0::DOUBLE) END"
_DL = f"""d0 AS (SELECT *, l_quantity::BIGINT * 1000 AS expected, 'http://h/' || l_partkey || ['.jpg', '.mp4', '.bin', '.m3u8'][l_partkey % 4 + 1] AS url,
      'f/' || concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS path,
      ['image/jpeg', 'text/html', 'video/mp4', '', 'application/json'][l_suppkey % 5 + 1] AS ct, CASE WHEN l_returnflag = 'A' THEN 'video' ELSE '' END AS item FROM lineitem),
    d1 AS (SELECT *, CASE WHEN l_tax > 0.07 THEN expected - 1 WHEN l_tax = 0 THEN 0 ELSE expected END AS actual,
      CASE l_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 3 THEN 'video' ELSE CASE WHEN item <> '' THEN item ELSE 'other' END END AS ut FROM d0),
    d2 AS (SELECT *, CASE ct WHEN 'image/jpeg' THEN 'image' WHEN 'text/html' THEN 'document' WHEN 'video/mp4' THEN 'video' ELSE ut END AS resource_type,
      CASE WHEN ut IN ('image', 'video', 'audio') AND ct IN ('text/html', 'application/json') THEN '返回 ' || ct || ' 页面而非媒体文件（可能被拦截或链接失效）'
           WHEN l_discount >= 0.1 THEN 'HTTP 404' WHEN actual <= 0 THEN '未下载到有效数据'
           WHEN expected > 0 AND actual <> expected THEN '下载不完整（' || {_SIZE('actual')} || '/' || {_SIZE('expected')} || '），可续传'
           WHEN l_linenumber = 3 THEN 'MD5校验失败' WHEN l_quantity < 5 THEN '{audit.FILTERED}small' ELSE '' END AS note FROM d1)"""
_PL = """s AS (SELECT *, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity::BIGINT, l_returnflag) - 1 AS i FROM lineitem),
    r AS (SELECT *, l_returnflag = 'A' AS has, l_returnflag = 'A' AND l_partkey % 3 = 0 AS exp FROM s),
    g AS (SELECT *, count(*) FILTER (exp) OVER (PARTITION BY l_orderkey ORDER BY i) AS ch FROM r),
    e AS (SELECT *, coalesce(max(CASE WHEN exp THEN l_partkey END) OVER (PARTITION BY l_orderkey, ch), 0) + coalesce(sum(CASE WHEN has THEN q * 10 END) OVER (PARTITION BY l_orderkey, ch ORDER BY i), 0) AS en FROM g)"""

SQL = {
    "last_write_wins": """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, value, ts, event_id FROM events)
        SELECT user_id, event_type, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM e GROUP BY 1, 2""",
    "epoch_clean": f"WITH {_EXP} SELECT event_id, expiry FROM x",
    "expiry_rollup": f"WITH {_EXP} SELECT domain, count(*) AS total, count(*) FILTER (expiry <= {NOW}) AS expired FROM x GROUP BY 1",
    "cookie_fields": f"""WITH {_EXP} SELECT event_id, domain, CASE event_type WHEN 'view' THEN 'Strict' WHEN 'click' THEN 'None' WHEN 'error' THEN 'Lax' END AS same_site
        FROM x WHERE domain LIKE '%example.com'""",
    "fingerprints": f"WITH {_EXP} SELECT DISTINCT '.S' || domain[2:] AS domain, true AS stable, bool_or(event_id = 0) AS changed FROM x GROUP BY domain",
    "login_wall": """
        WITH p AS (SELECT page_id, html, lower(html) AS low, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 403 END AS status FROM pages),
        m AS (SELECT *, CASE WHEN contains(low, 'erthan') THEN 'erthan' WHEN contains(low, 'dasder') THEN 'dasder' ELSE '' END AS o,
                CASE WHEN contains(low, 'andthe') THEN 'andthe' WHEN contains(low, 'onthe') THEN 'onthe' WHEN contains(low, 'wasun') THEN 'wasun' ELSE '' END AS i FROM p),
        k AS (SELECT *, CASE WHEN o <> '' THEN o ELSE i END AS mk FROM m)
        SELECT page_id, CASE WHEN o <> '' THEN false WHEN i <> '' THEN true WHEN status <> 0 THEN status = 200 ELSE true END AS logged_in,
               CASE WHEN o <> '' THEN 'logout_marker' WHEN i <> '' THEN 'login_marker' WHEN status <> 0 THEN 'status' ELSE 'non_empty' END AS rule,
               CASE WHEN mk <> '' THEN replace(substr(html, greatest(instr(low, mk) - 40, 1), 120), chr(10), ' ') ELSE '' END AS evidence, o <> '' AND i <> '' AS conflict FROM k""",
    "rate_audit": """
        WITH l AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id % 10 END AS host, epoch_us(ts) // 20 AS t FROM events)
        SELECT id, host, count(*) OVER w AS in_window, count(*) OVER w > 4 AS over_quota, coalesce(t - lag(t) OVER (PARTITION BY host ORDER BY t, id) < 5000000, false) AS too_soon
        FROM l WINDOW w AS (PARTITION BY host ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
    "download_verdict": f"WITH {_DL} SELECT url, path, resource_type, note = '' AS ok, note FROM d2",
    "download_totals": f"""WITH {_DL} SELECT count(*) FILTER (note = '') AS success, count(*) FILTER (note <> '' AND NOT starts_with(note, '{audit.FILTERED}')) AS failed,
        count(*) FILTER (starts_with(note, '{audit.FILTERED}')) AS filtered FROM d2""",
    "download_manifest": f"""WITH {_DL}, m AS (SELECT d2.*, coalesce(CASE WHEN url LIKE '%.jpg' THEN p_name END, '') AS album,
          coalesce(CASE WHEN url LIKE '%.jpg' AND p_size > 0 AND p_size % 3 > 0 THEN p_size || 'x' || p_size % 3 END, '') AS res FROM d2 LEFT JOIN part ON p_partkey = l_partkey WHERE note = '')
        SELECT path, '[' || resource_type || ']' || CASE WHEN album || res = '' THEN '' ELSE ' ' || trim(album || ' ' || res) END || ' ' || url || chr(10) || '     → ' || path ||
          ' (' || {_SIZE('actual')} || ', MD5:' || md5(l_partkey::VARCHAR) || ')' AS line FROM m""",
    "exact_dedup": """WITH f AS (SELECT doc_id, 'p/' || doc_id AS path, first_value('p/' || doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS kept_path FROM documents)
        SELECT doc_id, kept_path, kept_path <> path AS is_duplicate FROM f""",
    "quality_audit": f"""WITH f AS (SELECT 'd/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.svg' WHEN 1 THEN '.mp4' ELSE '.png' END AS path, floor(p_retailprice)::BIGINT AS size, p_size AS w, p_size % 7 AS h,
          p_partkey % 5 AS k FROM part)
        SELECT path, CASE WHEN k = 0 THEN 'SVG 图标（默认排除）' WHEN size < 950 THEN '体积 ' || {_SIZE('size')} || ' 小于下限 950.0 B' WHEN size > 1060 THEN '体积 ' || {_SIZE('size')} || ' 超过上限 1.0 KB'
          WHEN k > 1 AND w > 0 AND w < 10 THEN '宽度 ' || w || ' 小于下限 10' WHEN k > 1 AND h > 0 AND h < 3 THEN '高度 ' || h || ' 小于下限 3' ELSE '' END AS problem FROM f""",
    "image_headers": """SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE p_partkey % 3000 + 1 END AS width, CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE p_size + 2 END::BIGINT AS height FROM part""",
    "hls_segments": f"""WITH {_PL} SELECT l_orderkey, 'http://v.example.com/' || l_orderkey || '/seg/' || l_partkey || '.ts' AS segment_url, q + 0.5::DOUBLE AS duration,
        l_orderkey % 50 + i AS sequence, CASE WHEN has THEN (en - q * 10)::BIGINT END AS range_offset, CASE WHEN has THEN q * 10 END AS range_length FROM e WHERE l_orderkey % 7 NOT IN (1, 2)""",
    "hls_summary": """WITH t AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity + 0.5) AS d FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CASE l_orderkey % 7 WHEN 0 THEN 'http://v.example.com/' || l_orderkey || '/k1' WHEN 1 THEN 'http://v.example.com/' || l_orderkey || '/k'
          WHEN 2 THEN 'http://v.example.com/' || l_orderkey || '/k2' ELSE '' END AS key_uri, l_orderkey % 2 = 1 AS live,
          CASE l_orderkey % 7 WHEN 1 THEN '该流使用 SAMPLE-AES 加密（样本级加密/DRM），本工具不支持' WHEN 2 THEN '播放列表内出现 2 个不同的密钥（密钥轮换）' ELSE '' END AS error,
          CASE WHEN l_orderkey % 7 NOT IN (1, 2) THEN n END AS segments, CASE WHEN l_orderkey % 7 NOT IN (1, 2) THEN d END AS total_duration FROM t""",
    "hls_best": """WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS bw, (o_orderkey % 4 + 1) * 320 AS w FROM orders WHERE o_orderkey % 5 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w * 240 DESC, bw DESC, o_orderkey) AS rn FROM o)
        SELECT o_custkey, 'http://v.example.com/a/v' || o_orderkey || '.m3u8' AS variant_url, bw AS bandwidth, w || 'x240' AS resolution, 'avc1,mp4a' AS codecs FROM r WHERE rn = 1""",
    "dash_segments": """
        SELECT p_partkey, 'http://d.example.com/' || p_partkey || '/v/' || r || p_partkey || '_' || lpad((5 + k)::VARCHAR, 3, '0') || '.m4s' AS segment_url, 5 + k AS sequence, 2.0::DOUBLE AS duration
        FROM part, (VALUES ('a'), ('b')) v(r), range(6) x(k)
        UNION ALL SELECT p_partkey, 'http://d.example.com/' || p_partkey || '/v/s_' || (100 + k * (p_size + 1)) || '.m4s', 1 + k, CASE WHEN k < 3 THEN p_size + 1 ELSE 7 END::DOUBLE FROM part, range(4) x(k)""",
    "dash_best": "SELECT p_partkey, 'b' || p_partkey AS id, 'http://d.example.com/' || p_partkey || '/v/b' || p_partkey || '_i.mp4' AS init_url, true AS has_audio FROM part",
}
