"""URL filters, frontier rules and verdict ladders.

A rule list is plan-time data: it is compiled into one expression, so no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftweb.functions import urls
from siftweb.scale import unnest


def usable_patterns(patterns: Sequence[str]) -> list[str]:
    """Stripped, distinct patterns that compile."""
    kept: list[str] = []
    for pattern in patterns:
        pattern = str(pattern).strip()
        try:
            re.compile(pattern)
        except re.error:
            continue
        if pattern and pattern not in kept:
            kept.append(pattern)
    return kept


def _first_match(url: Column, patterns: Sequence[str]) -> Column:
    """First pattern found in the address, NULL when none is."""
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(url.rlike(pattern), F.lit(pattern)).otherwise(out)
    return out


def url_filter(df: DataFrame, block: Sequence[str] = (), allow: Sequence[str] = (), url: str = "url") -> DataFrame:
    """Add ``allowed`` and ``reason``: allow-list first, then the first blocking pattern.

    The host is compared without its port.
    """
    block = usable_patterns(block)
    domains = sorted({d for d in (re.sub(r"^\.+", "", re.split(r"[/:]", re.sub(r"^.*?://", "", a.strip().lower()))[0])
                                  for a in allow) if d})
    host = urls.host_of(F.col(url))
    outside = ~urls.in_domains(host, domains) if domains else F.lit(False)
    shown = F.when(host == "", "未知").otherwise(host)
    hit = _first_match(F.col(url), block)
    passed = F.concat(F.lit("命中白名单域名 "), host) if domains else F.lit("未命中任何屏蔽规则")
    return (df.withColumn("_outside", outside).withColumn("_hit", hit)
            .withColumn("allowed", ~F.col("_outside") & F.col("_hit").isNull())
            .withColumn("reason", F.when(F.col("_outside"), F.concat(F.lit("域名 "), shown, F.lit(" 不在白名单内")))
                        .when(F.col("_hit").isNotNull(), F.concat(F.lit("命中屏蔽正则："), F.col("_hit"))).otherwise(passed))
            .drop("_outside", "_hit"))


def url_filter_stats(filtered: DataFrame, order: str, url: str = "url", recent: int = 100) -> DataFrame:
    """Counts and the last ``recent`` blocked addresses, newest last."""
    counts = filtered.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("allowed")).alias("filtered_count"))
    last = (filtered.filter(~F.col("allowed")).orderBy(F.col(order).desc()).limit(recent)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(url)))).alias("s"))
            .select(F.transform("s", lambda x: x[url]).alias("recent_filtered")))
    return counts.withColumn("recent_filtered", last.scalar())


def frontier_links(links: DataFrame, seen: DataFrame | None = None, keyword: str = "", external: bool = False) -> DataFrame:
    """Links worth following: keyword, same authority unless ``external``, not seen before."""
    kept = links
    if keyword:
        kept = kept.filter(F.col("link").contains(keyword))
    if not external:
        kept = kept.filter(urls.url_domain(F.col("link")) == urls.url_domain(F.col("base_url")))
    if seen is not None:
        kept = kept.join(seen.select(F.col("url").alias("link")), "link", "left_anti")
    return kept


# --- fixed values: markers of script-built pages; paths that are not content
JS_SIGNAL = (
    r"(?i)(?:data-src|data-original|lazyload|lazy-load|IntersectionObserver|"
    r"__NEXT_DATA__|__NUXT__|__INITIAL_STATE__|window\.__|vue|react|"
    r"infinite-scroll|waterfall)")
DETAIL_EXCLUDE = (
    r"(?i)(?:login|logout|register|signup|sign-in|cart|account|user|help|about|"
    r"contact|privacy|terms|subscribe|rss|feed|share|comment|download|"
    r"javascript:|mailto:)")
RENDER_MIN_CHARS = 800
RENDER_MIN_MEDIA = 3


def needs_render(pages: DataFrame, media_count: str = "media_count") -> DataFrame:
    """Pages whose content a plain fetch most likely missed."""
    markup = F.coalesce(F.col("html"), F.lit(""))
    thin = (F.length(markup) >= RENDER_MIN_CHARS) & (F.col(media_count) < RENDER_MIN_MEDIA) & markup.rlike(JS_SIGNAL)
    return pages.withColumn("needs_render", F.when(F.col("media_direct"), F.lit(False))
                            .when(~F.col("ok"), F.col("error") != "").otherwise(thin))


def detail_links(pages: DataFrame, pattern: str = "", most: int = 0) -> DataFrame:
    """Content links of a listing page in document order; with ``most`` the first ones of each page only."""
    from siftweb.functions.media import has_media_ext

    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))
    here = urls.host_of(F.col("base_url"))
    links = F.array_distinct(F.transform(F.filter(hrefs, lambda h: ~h.startswith("#")), lambda h: F.substring_index(
        urls.join_url(F.col("base_url"), urls.trimmed(h)), "#", 1)))

    def wanted(link):
        def near(host):
            dot = F.lit(".")
            return (host != "") & ((host == here) | F.endswith(host, F.concat(dot, here)) | F.endswith(here, F.concat(dot, host)))

        ok = link.rlike("^https?://") & ~has_media_ext(link) & ~link.rlike(DETAIL_EXCLUDE) & urls.bind(urls.host_of(link), near)
        return ok & link.contains(pattern) if pattern else ok

    return unnest(pages, ["page_id", "base_url"], F.slice(F.filter(links, wanted), 1, most) if most else F.filter(links, wanted), "link", "pos")


def media_direct(pages: DataFrame, seeds: str = "") -> DataFrame:
    """Pages that are a media file themselves, as media rows."""
    from siftweb.functions.media import kind_of

    source = F.when(F.col("url") == seeds, "").otherwise(seeds)
    return (pages.filter("media_direct")
            .select(F.col("page_id").alias("page_seq"), "url", kind_of(F.col("url"), F.col("content_type")).alias("kind"),
                    source.alias("source_page"), F.lit("direct").alias("origin"),
                    F.create_map(F.lit("content_type"), F.col("content_type")).alias("extra")))


def media_kind_reason(kinds: Sequence[str], allow_svg: bool = False) -> Column:
    """Why a candidate's address or kind is out, '' when it may pass."""
    from siftweb.functions import fixed

    chosen = [k for k in dict.fromkeys(str(k).strip().lower() for k in kinds) if k in fixed.KIND_GROUPS] or ["image", "video"]
    wanted = [kind for group in chosen for kind in fixed.KIND_GROUPS[group]]
    ext = F.lower(F.when(F.coalesce(F.col("ext"), F.lit("")) != "", F.col("ext")).otherwise(urls.ext_of(F.col("url"))))
    return (F.when(~F.col("url").rlike("^https?://") | ~F.col("kind").isin(fixed.MEDIA_KINDS) | ~F.col("kind").isin(wanted), "wrong_kind")
            .when((ext == ".svg") & F.lit(not allow_svg), "svg")
            .otherwise(""))


def media_quality_reason(min_width: int = 0, min_height: int = 0, min_size: int = 0, max_size: int = 0) -> Column:
    """Known measures outside the bounds; 0 means unknown and passes."""
    def low(name: str, bound: int) -> Column:
        return F.lit(bound > 0) & (F.coalesce(F.col(name), F.lit(0)) > 0) & (F.col(name) < bound)

    return (F.when(low("size", min_size), "too_small")
            .when(F.lit(max_size > 0) & (F.coalesce(F.col("size"), F.lit(0)) > max_size), "too_large")
            .when(low("width", min_width) | low("height", min_height), "too_small")
            .otherwise(""))
