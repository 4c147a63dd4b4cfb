"""What a user calls: inventory, crawl audit, risk scan, policy screening, books, download audit, playlists.

A job returns named DataFrames. Tables that feed several outputs are checkpointed while the job is built;
the rest runs when an output is written or read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftweb.functions import html, urls
from siftweb.operators import audit, books, extract, filters, graph, media, playlists, policy, risk, rules
from siftweb.scale import dealt, only
from siftweb.session import cut_lineage


def media_inventory(pages: DataFrame, config: media.MediaConfig, site_rules: DataFrame | None = None,
                    events: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates of every extractor -> merged -> deduplicated, filtered, capped, numbered."""
    sources, problems = rules.run_plugins(pages)
    if site_rules is not None:
        sources.append(rules.extract_media_rules(pages, site_rules))
    if events is not None:
        sources.append(extract.extract_media_network(events))
    sources.append(extract.extract_media_html(pages, config.upgrade_urls))
    answers = extract.extract_media_json(pages)
    # the path itself orders the values of a page; their numbers need no packing and no bound
    in_order = Window.partitionBy("page_seq").orderBy("path", "url")
    sources.append(answers.withColumn("pos", F.row_number().over(in_order).cast("long")).drop("path"))
    # merged once, read by the labels, the items and the counters
    candidates = cut_lineage(media.union_sources(*sources))
    labelled = cut_lineage(media.label_media(candidates, config))
    items = media.kept_items(labelled)
    named = items.withColumn("file_name", urls.media_filename(
        F.col("album"), F.col("title"), F.col("index"), F.col("kind"), F.when(F.col("ext") != "", F.col("ext")).otherwise(urls.ext_of(F.col("url"))),
        F.col("url"), config.filename_template))
    return {"labelled": labelled, "items": named, "stats": media.media_stats(labelled), "samples": media.rejected_samples(labelled),
            "plugin_problems": pages.sparkSession.createDataFrame(sorted(problems.items()), "plugin string, problem string")}


def crawl_audit(pages: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int = 0, block: Sequence[str] = (), allow: Sequence[str] = (),
                robots: DataFrame | None = None, agent: str = "") -> dict[str, DataFrame]:
    """Levels of the link graph with page statistics and robots verdicts."""
    links = extract.extract_links(pages)
    edges = cut_lineage(links.select(F.col("base_url").alias("src"), F.col("link").alias("dst")))
    levels = graph.bfs_crawl(edges, seeds, max_depth, max_pages, block, allow)
    stats = pages.select(F.col("base_url").alias("url"), F.length(html.page_text(F.col("html"))).cast("long").alias("chars"),
                         F.size(F.array_distinct(html.href_values(F.col("html")))).cast("long").alias("links"),
                         F.size(extract.media_link_array()).cast("long").alias("media"))
    reached = levels.join(stats, "url", "left")
    if robots is not None:
        sited = reached.withColumn("site", urls.host_of(F.col("url")))
        reached = policy.robots_allowed(sited, policy.robots_groups(robots, agent))
    totals = reached.agg(F.count(F.lit(1)).alias("urls"), F.count("chars").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("media").alias("media"))
    return {"levels": reached, "totals": totals}


def media_walk(pages: DataFrame, site_rules: DataFrame, seeds: DataFrame, max_depth: int, page_budget: int = 0) -> dict[str, DataFrame]:
    """Listing pages to their detail pages and on through the paging, by the sites' rules: reached pages and both kinds of links."""
    detail = cut_lineage(rules.extract_detail_links(pages, site_rules).select(F.col("base_url").alias("src"), F.col("link").alias("dst")).distinct())
    paging = cut_lineage(graph.next_pages(pages, rule=rules.page_rule_for(pages, site_rules)).select(F.col("base_url").alias("src"), F.col("next_url").alias("dst")).distinct())
    return {"pages": graph.media_frontier(detail, paging, seeds, max_depth, page_budget), "detail": detail, "paging": paging}


def url_risk_scan(addresses: DataFrame, url: str = "url", order: str = "pos") -> dict[str, DataFrame]:
    analyzed = risk.analyze_urls(risk.distinct_urls(addresses, url, order))
    findings = risk.finding_rows(analyzed)
    return {"findings": findings, "levels": risk.risk_levels(analyzed), "suggestions": risk.regex_suggestions(findings), "summary": risk.risk_summary(analyzed)}


def policy_screen(pages: DataFrame, scan_time: str, annotations: DataFrame | None = None, robots: DataFrame | None = None,
                  agent: str = "", max_pages: int = 12) -> dict[str, DataFrame]:
    """Start pages -> seeds -> the seed pages among ``pages`` -> clauses -> findings -> report per site."""
    site = urls.host_of(F.col("base_url"))
    # a site is entered at its root page, or else at the page with the shortest path
    entry = F.min(F.struct(F.length(urls.path_of(F.col("base_url"))).alias("depth"), F.col("base_url")))["base_url"]
    first = pages.groupBy(site.alias("_site")).agg(entry.alias("base_url"))
    # few bytes each, but thirty seeds and more are made of every start
    starts = cut_lineage(dealt(pages.join(first.select("base_url"), "base_url", "left_semi"), "base_url", "page_id"))
    seeds = policy.union_seeds(policy.anchor_seeds(starts), policy.path_seeds(starts.select(site.alias("site"), F.col("base_url").alias("start_url"))))
    if robots is not None:
        checked = policy.robots_allowed(seeds, policy.robots_groups(robots, agent))
        seeds = checked.withColumn("reason", F.when((F.col("reason") == "") & ~F.col("robots_ok"), "robots.txt 禁止访问该路径").otherwise(F.col("reason"))).drop("robots_ok")
    # both are read by the pages, the skipped addresses and the report
    seeds = cut_lineage(seeds)
    ranked = cut_lineage(policy.rank_legal_seeds(seeds, max_pages))
    picked = ranked.filter("picked").select("site", "url", F.col("source").alias("matched_by"), "position")
    keyed = pages.withColumn("_key", urls.legal_url_key(F.col("base_url")))
    found = picked.join(keyed.select(F.col("_key").alias("url"), "html", "status", "error"), "url")
    texts = cut_lineage(found.select(
        "site", "url", "matched_by", "position", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("error", F.lit("")).alias("error"),
        html.page_title(F.col("html")).alias("title"), html.main_text(F.col("html")).alias("text")).withColumn("chars", F.length("text")))
    # a clause is named by its page's address hash and its number
    source = texts.select(F.left(urls.url_hash_raw(F.col("url")), F.lit(16)).alias("page_index"), F.col("url").alias("page_url"), "text")
    hits = policy.score_clauses(policy.segment_clauses(source))
    if annotations is not None:
        hits = policy.apply_refinements(hits, annotations)
    sited = hits.withColumn("site", urls.host_of(F.col("page_url")))
    skipped = seeds.filter("reason <> ''").select("site", "url", "reason").unionByName(ranked.filter(~F.col("picked")).select("site", "url", "reason")).distinct()
    sites = starts.groupBy(site.alias("site")).agg(F.min("base_url").alias("start_url"))
    return {"seeds": ranked, "skipped": skipped, "pages": texts, "hits": sited, "stats": policy.category_stats(hits),
            "reports": policy.compliance_report(sites, texts, sited, skipped, scan_time)}


def assemble_books(pages: DataFrame, starts: DataFrame, max_pages: int = 0) -> dict[str, DataFrame]:
    """``starts(node)`` are first pages; chains, texts and metadata of all books at once."""
    read = cut_lineage(books.read_book_pages(pages))
    links = cut_lineage(books.next_pointers(read, extract.site_links(pages)))
    chain = graph.next_chain(links, starts, max_pages)
    body = read.select(F.col("base_url").alias("node"), "title", "body")
    ordered = chain.join(body, "node", "left").select(
        F.col("start").alias("book"), "dist", "node", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"),
        F.when(F.col("body").isNull(), "抓取失败").when(F.col("body") == "", "未提取到正文").otherwise("").alias("error"))
    return {"pages": ordered, "texts": books.assemble_book(ordered), "metadata": books.book_metadata(ordered),
            "stops": graph.chain_stop_reason(chain, links, max_pages)}


def download_audit(log: DataFrame, items: DataFrame, order: Sequence[str]) -> dict[str, DataFrame]:
    """Verdicts, exact duplicates among good images, manifest and totals."""
    judged = audit.download_verdict(log)
    images = media.exact_dedup(only(judged, F.col("ok") & (F.col("resource_type") == "image")), "path", order)
    manifest = audit.manifest_line(audit.manifest_rows(only(judged, F.col("ok")).withColumn("size", F.col("actual")), items))
    return {"audited": judged, "duplicates": images.filter("is_duplicate"), "manifest": manifest, "totals": audit.download_totals(judged), "again": audit.failed_urls(judged)}


def playlist_inventory(texts: DataFrame, key: str) -> dict[str, DataFrame]:
    """HLS and DASH documents told apart by their text."""
    is_dash = F.col("text").rlike(r"(?s)<\s*(?:\w+:)?MPD\b")
    # the other kind's texts become null instead of being filtered: a filter would be pushed down with a copy of what makes the text
    playlist_texts, manifests = (texts.withColumn("text", F.when(kind, F.col("text"))) for kind in (~is_dash, is_dash))
    summary, segments = playlists.parse_hls(playlist_texts, key)
    lines = playlists.playlist_lines(playlist_texts, key)
    reps, dash_segments = playlists.parse_dash(manifests, key)
    return {"hls": summary, "hls_segments": segments, "hls_best": playlists.best_variant(playlists.hls_variants(lines, key), key),
            "dash": reps, "dash_segments": dash_segments, "dash_best": playlists.best_representation(reps, key),
            "totals": playlists.playlist_totals(segments, key)}
