"""One page -> many rows. Every extraction runs inside the page row; exploding comes last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftweb.functions import fixed, html, media, urls
from siftweb.scale import unnest

EMPTY_MAP = "map<string,string>"


def _empty_map() -> Column:
    return F.create_map().cast(EMPTY_MAP)


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct absolute http(s) links of each page."""
    hrefs = F.array_distinct(html.href_values(F.col("html")))
    links = F.array_distinct(F.filter(F.transform(
        hrefs, lambda h: urls.join_url(F.col("base_url"), urls.trimmed(h))), lambda u: u.rlike("^https?://")))
    return unnest(pages, ["page_id", "base_url"], links, "link").drop("_pos")


def _found(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(group))


def media_link_array() -> Column:
    """Distinct media addresses mentioned anywhere in the ``html`` column."""
    attrs = "|".join(fixed.LAZY_SRC_ATTRS)
    plain = [_found(rf"""(?i)<{tag}\b[^>]*\b(?:{attrs})\s*=\s*["']([^"']+)["']""") for tag in fixed.MEDIA_TAGS]
    plain.append(_found(r"""(?i)<(?:img|video)\b[^>]*\b(?:poster|data-poster)\s*=\s*["']([^"']+)["']"""))
    plain.append(_found(r"""(?i)<(?:img|source)\b[^>]*\b(?:srcset|data-srcset)\s*=\s*["']([^"']+)["']"""))
    preload = F.filter(_found(r"(?i)<link\b[^>]*>", 0), lambda t: t.rlike(r"""(?i)as\s*=\s*["'](?:video|audio)["']"""))
    plain.append(F.transform(preload, lambda t: F.regexp_extract(t, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)))
    plain.append(_found(rf"""(?i)["']((?:https?:)?//[^"'\s<>]+?{fixed.LINKED_MEDIA_EXT}(?:\?[^"'\s<>]*)?)["']"""))
    metas = _found(r"""(?i)<meta\b[^>]*\b(?:property|name)\s*=\s*["'](?:og:video(?::url|:secure_url)?|twitter:player:stream)["'][^>]*>""", 0)
    strict = [_found(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""),
              F.transform(metas, lambda t: F.regexp_extract(t, r"""(?i)content\s*=\s*["']([^"']+)["']""", 1))]

    def absolute(raw: Column) -> Column:
        def join(text: Column) -> Column:
            first = F.substring_index(urls.trimmed(F.substring_index(text, ",", 1)), " ", 1)
            return F.when((text == "") | text.rlike("(?i)^(?:data:|blob:|javascript:|about:|#)"), "") \
                .otherwise(urls.join_url(F.col("base_url"), first))

        return urls.bind(urls.trimmed(html.unescape(raw)), join)

    def resolved(arrays: list[Column]) -> Column:
        return F.filter(F.transform(F.array_distinct(F.concat(*arrays)), absolute), lambda u: u.rlike("^https?://"))

    by_ext = F.filter(resolved(strict), lambda u: u.rlike(rf"(?i){fixed.LINKED_MEDIA_EXT}(?:[?#]|$)"))
    return F.array_distinct(F.concat(resolved(plain), by_ext))


def extract_media_links(pages: DataFrame) -> DataFrame:
    return unnest(pages, ["page_id", "base_url"], media_link_array(), "media_url").drop("_pos")


def extract_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "base_url", html.page_text(F.col("html")).alias("text"))


def extract_anchors(pages: DataFrame) -> DataFrame:
    return (unnest(pages, ["page_id", "base_url"], html.anchors(F.col("html")), "a", "pos")
            .select("page_id", "base_url", "pos", F.col("a.href").alias("href"), F.col("a.text").alias("text"),
                    html.anchor_hint(F.col("a.text")).alias("hint")))


def site_links(pages: DataFrame) -> DataFrame:
    """Distinct same-host links of each page, fragments cut."""
    hrefs = F.array_distinct(_found(r"""(?i)href\s*=\s*["']([^"']+)["']"""))
    links = F.transform(hrefs, lambda h: urls.resolve_url(F.col("base_url"), h, keep_fragment=False))
    here = urls.host_of(F.col("base_url"))
    kept = F.filter(links, lambda u: (u != "") & ((here == "") | (urls.host_of(u) == "") | (urls.host_of(u) == here)))
    return unnest(pages, ["page_id", "base_url"], F.array_distinct(kept), "link").drop("_pos")


# ---- media from markup -------------------------------------------------------

def _candidate(raw: Column, title: Column, origin) -> Column:
    origin = F.lit(origin) if isinstance(origin, str) else origin
    return F.struct(raw.alias("raw"), title.alias("title"), origin.alias("origin"))


def _tag_candidates(tag_name: str) -> Column:
    def filled(attrs: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(attrs, F.lit(n)), F.lit("")) for n in names], F.lit(""))

    def choose(p: Column) -> Column:
        sharp, best = p["sharp"], p["best"]
        weak = ~best["attr"].isin(fixed.STRONG_SRC_ATTRS)
        use_best = ~((sharp != "") & weak) & (best["value"] != "")
        use_sharp = (sharp != "") & (weak | (sharp != best["value"]))
        return F.array(
            _candidate(F.when(use_best, best["value"]), p["title"], f"html:{tag_name}"),
            _candidate(F.when(use_sharp, sharp), p["title"], "html:srcset"),
            _candidate(F.when(p["poster"] != "", p["poster"]), p["title"], "html:poster"))

    def per_tag(tag: Column) -> Column:
        return urls.bind(html.parse_attrs(tag), lambda attrs: urls.bind(F.struct(
            F.left(urls.trimmed(html.unescape(filled(attrs, "alt", "title"))), F.lit(60)).alias("title"),
            html.best_src(attrs).alias("best"),
            html.best_srcset(filled(attrs, *fixed.SRCSET_ATTRS)).alias("sharp"),
            urls.trimmed(filled(attrs, "poster", "data-poster")).alias("poster")), choose))

    return F.flatten(F.transform(_found(rf"(?i)<{tag_name}\b[^>]*>", 0), per_tag))


def _meta_candidates(names: str, origin: str) -> Column:
    tags = _found(rf"""(?i)<meta\b[^>]*\b(?:property|name)\s*=\s*["'](?:{names})["'][^>]*>""", 0)
    return F.transform(tags, lambda t: _candidate(html.meta_content(t), F.lit(""), origin))


def _css_candidates() -> Column:
    blocks = F.concat(_found(r"""(?i)style\s*=\s*(?:"[^"]*"|'[^']*')""", 0), _found(r"(?is)<style[^>]*>.*?</style>", 0))
    # the outer quotes of an attribute would be taken for those of url(...)
    bodies = F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"""(?i)url\(\s*(?:"[^"]*"|'[^']*'|[^)'"]+)\s*\)"""), F.lit(0)))
    values = F.transform(F.flatten(bodies), lambda u: urls.trimmed(
        F.regexp_replace(F.regexp_replace(u, r"""(?i)^url\(\s*["']?|\s*\)$""", ""), "[\"']$", "")))
    return F.transform(F.filter(values, media.has_media_ext), lambda v: _candidate(v, F.lit(""), "html:css"))


def _script_candidates() -> Column:
    body = r"""[^"'\s<>\\]+?""" + fixed.SCRIPT_MEDIA_EXT + r"""(?:\?[^"'\s<>\\]*)?)["']"""
    blocks = _found(r"(?is)<script\b[^>]*>(.*?)</script>", 1)

    def per_block(block: Column) -> Column:
        absolute = F.regexp_extract_all(block, F.lit(r"""(?i)["']((?:https?:)?//""" + body), F.lit(1))
        rooted = F.regexp_extract_all(block, F.lit(r"""(?i)["'](/""" + body), F.lit(1))
        return F.concat(F.transform(absolute, lambda v: _candidate(v, F.lit(""), "html:js")),
                        F.transform(rooted, lambda v: _candidate(v, F.lit(""), "html:js-rel")))

    return F.flatten(F.transform(blocks, per_block))


def _anchor_candidates() -> Column:
    tags = _found(r"""(?i)<a\b[^>]*\bhref\s*=\s*(?:"[^"]*"|'[^']*')""", 0)
    values = F.transform(tags, lambda t: urls.trimmed(F.regexp_replace(
        F.regexp_extract(t, r"""(?i)href\s*=\s*("[^"]*"|'[^']*')$""", 1), "^[\"']|[\"']$", "")))
    linked = F.filter(values, lambda v: media.has_media_ext(v) & (urls.ext_of(v) != ""))
    return F.transform(linked, lambda v: _candidate(v, F.lit(""), "html:a-href"))


def extract_media_html(pages: DataFrame, upgrade: bool = True) -> DataFrame:
    """Media candidates of the markup in source order, first address wins inside a page.

    With ``upgrade`` each thumbnail that maps to an original adds that original right behind it.
    """
    found = F.concat(
        *[_tag_candidates(tag) for tag in fixed.MEDIA_TAGS],
        _meta_candidates("og:image(?::url|:secure_url)?|twitter:image(?::src)?", "html:og:image"),
        _meta_candidates("og:video(?::url|:secure_url)?|twitter:player:stream", "html:og:video"),
        _css_candidates(), _script_candidates(), _anchor_candidates())
    raw = F.filter(found, lambda c: c["raw"].isNotNull() & (c["raw"] != ""))
    # two steps through named columns keep the lambda bodies from being evaluated again and again
    listed = pages.withColumn("_raw", raw)
    listed = listed.withColumn("_items", F.transform("_raw", lambda c, i: F.struct(
        urls.resolve_url(F.col("base_url"), c["raw"]).alias("url"), i.alias("pos"), c["title"].alias("title"),
        c["origin"].alias("origin"))))
    listed = listed.withColumn("_items", F.transform(
        F.filter("_items", lambda c: c["url"] != ""),
        lambda c: F.struct(c["url"].alias("url"), F.struct(
            c["pos"].alias("pos"), F.lit(0).alias("step"), c["title"].alias("title"), c["origin"].alias("origin"),
            media.kind_of(c["url"]).alias("kind"), F.lit("").alias("upgraded_from")).alias("item"))))
    if upgrade:
        def with_original(c: Column) -> Column:
            return urls.bind(urls.upgrade_thumbnail(c["url"]), lambda larger: pair(c, larger))

        def pair(c: Column, larger: Column) -> Column:
            extra = F.struct(larger.alias("url"), F.struct(
                c["item"]["pos"].alias("pos"), F.lit(1).alias("step"), c["item"]["title"].alias("title"),
                F.concat(c["item"]["origin"], F.lit("+upgrade")).alias("origin"), c["item"]["kind"].alias("kind"),
                c["url"].alias("upgraded_from")).alias("item"))
            return F.when((larger != "") & media.is_media_kind(c["item"]["kind"]), F.array(c, extra)).otherwise(F.array(c))

        listed = listed.withColumn("_items", F.flatten(F.transform("_items", with_original)))
    # a map keeps one entry per address; fed backwards, that entry is the first
    firsts = F.map_from_entries(F.reverse("_items"))
    ordered = F.array_sort(F.filter(F.transform(F.map_entries(firsts), lambda e: F.struct(
        e["value"]["pos"].alias("pos"), e["value"]["step"].alias("step"), e["value"]["title"].alias("title"),
        e["value"]["origin"].alias("origin"), e["value"]["kind"].alias("kind"),
        e["value"]["upgraded_from"].alias("upgraded_from"), e["key"].alias("url"))), lambda e: media.is_media_kind(e["kind"])))
    listed = listed.withColumn("_items", ordered)
    mains = F.transform(F.filter("_items", lambda e: e["step"] == 0), lambda e: e["pos"])
    listed = listed.withColumn("_mains", mains).withColumn("_album", html.page_album(F.col("html")))
    return (unnest(listed, ["page_id", "base_url", "_album", "_mains"], "_items", "m", "_seq")
            .select(F.col("page_id").alias("page_seq"), F.lit(80).alias("priority"), F.col("_seq").cast("long").alias("pos"),
                    F.col("m.url").alias("url"), F.col("m.kind").alias("kind"), F.col("base_url").alias("source_page"),
                    F.col("_album").alias("album"), F.col("m.title").alias("title"),
                    F.array_position("_mains", F.col("m.pos")).cast("long").alias("index"), F.lit("").alias("ext"),
                    _empty_map().alias("headers"), F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"),
                    F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("duration"), F.col("m.origin").alias("origin"),
                    F.when(F.col("m.upgraded_from") != "", F.create_map(F.lit("upgraded_from"), F.col("m.upgraded_from")))
                    .otherwise(_empty_map()).alias("extra")))


# ---- media from interface JSON ----------------------------------------------

def extract_media_json(pages: DataFrame, json_column: str = "json_text", depth: int = fixed.JSON_MAX_DEPTH, longest: int = 0) -> DataFrame:
    """Media addresses in interface responses, containers walked down to ``depth``; ``longest``: characters of an address, 0 for any.

    One generator per level: containers are opened, texts that may be addresses wait, all else is left behind where it is met, so the
    plan stays one straight line. Members of an object are visited in key order. What several columns need is computed
    in front of a generator (``unnest``), behind which no filter can copy it.
    """
    spark = pages.sparkSession

    def text_of(value: Column) -> Column:
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    def title_of(name: str) -> Column:
        value = F.try_variant_get("node", f"$.{name}", "variant")
        return F.when(value.isNotNull(), urls.bind(urls.trimmed(text_of(value)), lambda t: F.when(t != "", t)))

    def sorted_out(value: Column) -> Column:
        """The kind of a value, itself if it is a container, its text if that may be an address."""
        def settle(x: Column) -> Column:
            is_box = x["kind"].startswith("OBJECT") | x["kind"].startswith("ARRAY")
            text = urls.bind(F.when(x["kind"] == "STRING", urls.trimmed(F.try_variant_get(x["value"], "$", "string"))), lambda t: F.when(
                ((F.length(t) <= longest) | F.lit(longest == 0)) & t.rlike(r"^(?:https?://|//|/|\./|\.\./)"), t))
            return F.struct(x["kind"].startswith("OBJECT").alias("object"), F.when(is_box, x["value"]).alias("node"), text.alias("text"))

        return urls.bind(F.struct(F.schema_of_variant(value).alias("kind"), value.alias("value")), settle)

    def opened(rows: DataFrame, value: Column) -> DataFrame:
        """Rows whose fresh ``value`` is a container or an address, or that wait with their text."""
        kept = unnest(rows, ["page_id", "base_url", "title", "key", "path", "text"], F.array(F.when(value.isNotNull(), sorted_out(value))), "s")
        return kept.select("page_id", "base_url", "title", "key", "path", F.coalesce("s.object", F.lit(False)).alias("object"), F.col("s.node").alias("node"),
                           F.coalesce("text", "s.text").alias("text")).filter(F.col("node").isNotNull() | F.col("text").isNotNull())

    node = opened(pages.filter(F.col(json_column).isNotNull())
                  .select("page_id", "base_url", F.lit("").alias("title"), F.lit("").alias("key"), F.array().cast("array<int>").alias("path"),
                          F.lit(None).cast("string").alias("text"), F.try_parse_json(json_column).alias("_value")), F.col("_value"))
    for _ in range(depth + 1):
        local = F.left(F.coalesce(*map(title_of, fixed.JSON_TITLE_KEYS), F.col("title")), F.lit(60))
        named = node.withColumn("title", F.when(F.col("object"), local).otherwise(F.col("title"))).drop("object")
        children = named.lateralJoin(
            spark.tvf.variant_explode_outer(F.col("node").outer()).toDF("_pos", "_key", "_value"))
        inside = F.col("_pos").isNotNull()
        node = opened(children.select(
            "page_id", "base_url", "title", "text", F.when(inside, F.lower(F.coalesce("_key", F.lit("")))).otherwise(F.col("key")).alias("key"),
            F.when(inside, F.array_append("path", F.col("_pos"))).otherwise(F.col("path")).alias("path"), "_value"), F.col("_value"))

    read = urls.bind(urls.resolve_url(F.col("base_url"), F.col("text")), lambda u: F.struct(u.alias("url"), media.kind_of(u).alias("by_ext")))
    found = unnest(node.filter(F.col("text").isNotNull()), ["page_id", "base_url", "title", "key", "path"], F.array(read), "u")
    found = (found.select("page_id", "base_url", "title", "key", "path", "u.url", "u.by_ext")
             .filter((F.col("url") != "") & (F.col("url") != F.col("base_url")))
             .withColumn("hint", F.when(media.is_media_kind(F.col("by_ext")), "")
                         .when(F.col("key").isin(fixed.JSON_EXTLESS_KEYS), F.col("key")))
             .filter(F.col("hint").isNotNull())
             .withColumn("kind", F.when(F.col("hint") == "", F.col("by_ext"))
                         .when(F.col("hint").isin("m3u8", "mp4", "mpd", "dash", "hls"), "video").otherwise("image")))
    # first mention of an address inside its page; pages bound the groups
    firsts = found.groupBy("page_id", "base_url", "url").agg(
        F.min(F.struct("path", "title", "kind", "hint")).alias("m"))
    return firsts.select(
        F.col("page_id").alias("page_seq"), F.lit(90).alias("priority"),
        F.col("m.path").alias("path"), "url", F.col("m.kind").alias("kind"), F.col("base_url").alias("source_page"),
        F.col("m.title").alias("title"), F.when(F.col("m.hint") == "", "json").otherwise("json:hint").alias("origin"),
        F.when(F.col("m.hint") != "", F.create_map(F.lit("key_hint"), F.col("m.hint"))).otherwise(_empty_map()).alias("extra"))


# ---- media from request logs --------------------------------------------------

def network_noise(url: Column, status: Column) -> Column:
    """Failed requests, beacons and advertising hosts."""
    return (F.coalesce(status, F.lit(0)) >= 400) | url.rlike(fixed.NOISE_URL) | urls.in_domains(urls.host_of(url), fixed.AD_DOMAINS)


def extract_media_network(events: DataFrame) -> DataFrame:
    """Media rows of a request log; stateless, so it runs on streams as well."""
    from siftweb.sources.pages import forward_headers

    url = urls.trimmed(F.col("url"))
    return (events.withColumn("url", url).filter(F.col("url").rlike("^https?://"))
            .filter(~network_noise(F.col("url"), F.col("status")))
            .withColumn("kind", media.event_kind(F.col("url"), F.col("content_type"), F.col("resource_type")))
            .filter(media.is_media_kind(F.col("kind")))
            .select(F.col("page_id").alias("page_seq"), F.lit(60).alias("priority"), F.col("pos").cast("long").alias("pos"),
                    "url", "kind", F.col("base_url").alias("source_page"), F.lit("").alias("album"), F.lit("").alias("title"),
                    F.lit(0).cast("long").alias("index"), F.lit("").alias("ext"),
                    forward_headers(F.col("request_headers"), F.col("base_url")).alias("headers"),
                    F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"),
                    F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("duration"), F.lit("network").alias("origin"),
                    F.create_map(F.lit("resource_type"), F.coalesce("resource_type", F.lit("")),
                                 F.lit("status"), F.coalesce(F.col("status"), F.lit(0)).cast("string")).alias("extra")))
