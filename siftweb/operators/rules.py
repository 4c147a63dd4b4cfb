"""Site rules applied to pages."""

from __future__ import annotations

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftweb.functions import arrow, html, media, urls
from siftweb.functions.multimatch import required_words
from siftweb.scale import fits_broadcast, unnest
from siftweb.session import cut_lineage

#: a rule set is broadcast up to so many rules; a larger one is joined by an ordinary shuffle
BROADCAST_RULES = 10_000


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if fits_broadcast(rules, BROADCAST_RULES) else rules


#: characters of a key of the rule index; rules that need no such run of characters are tried on every page, so many at once
KEY, TOGETHER = 3, 500


@F.pandas_udf(ArrayType(StringType()))
def _needed(patterns: pd.Series) -> pd.Series:
    """Words of which a matching lower-cased address holds one; null if there are none or one is too short to be a key."""
    found = patterns.map(required_words)
    return found.map(lambda ws: sorted(ws) if ws and min(map(len, ws)) >= KEY else None)


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= KEY, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - KEY + 1), lambda i: F.substring(text, i, F.lit(KEY)))))


def _proposed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, base_url, id) for every rule (id, _p) whose expression may match the page's address.

    Every word that an expression needs is listed under its rarest run of KEY characters; addresses meet the list by
    their own runs. Rules without such a word go through all pages in groups of TOGETHER, tried inside the row.
    """
    needed = rules.withColumn("_w", _needed("_p"))
    runs = unnest(unnest(needed, ["id"], "_w", "_word").drop("_pos"), ["id", "_word"], _grams(F.col("_word")), "_gram").drop("_pos")
    common = runs.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    index = (runs.join(common, "_gram").groupBy("id", "_word").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram")).select("id", "_gram").distinct())
    index = cut_lineage(index)
    found = unnest(pages, ["page_id", "base_url"], _grams(F.lower("base_url")), "_gram").drop("_pos").join(_small(index), "_gram")
    found = found.select("page_id", "base_url", "id").distinct()
    rest = needed.filter("_w IS NULL").select("id", "_p")
    groups = -(-rest.count() // TOGETHER)
    if not groups:
        return found
    listed = rest.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("_group")).agg(F.collect_list(F.struct("id", "_p")).alias("_rules"))
    each = unnest(pages, ["page_id", "base_url"], F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")), "_group").drop("_pos").join(_small(listed), "_group")
    hits = F.filter("_rules", lambda r: F.rlike(F.col("base_url"), r["_p"]))
    return found.unionByName(unnest(each, ["page_id", "base_url"], hits, "r").select("page_id", "base_url", F.col("r.id").alias("id")))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, rule) pairs with score 1.0 domain and expression, 0.9 domain, 0.85 expression; best first per page.

    Domain rules meet hosts through an equi join on the host's parents. Rules without a domain are found by three characters
    that their expression needs, and only the rules found are tried.
    """
    rules = rules.filter("enabled")
    text = F.regexp_replace(F.lower(F.trim("pattern")), r"^\.+", "")
    doms = (rules.select("id", F.explode_outer("match.domain").alias("pattern")).filter("pattern is not null")
            .withColumn("_text", text).filter("_text <> ''")
            .select("id", F.regexp_replace("_text", r"^\*\.", "").alias("_parent"), F.col("_text").startswith("*.").alias("_below")))
    hosts = pages.select("page_id", "base_url", urls.host_of(F.col("base_url")).alias("_host"))
    family = unnest(hosts, ["page_id", "base_url", "_host"], urls.domain_family(F.col("_host")), "_parent").drop("_pos")
    by_domain = (family.join(_small(doms), "_parent").filter(~F.col("_below") | (F.col("_host") != F.col("_parent")))
                 .select("page_id", "base_url", "id").distinct().withColumn("_domain", F.lit(True)))
    open_rules = rules.filter((F.coalesce(F.size("match.domain"), F.lit(0)) == 0) & (F.coalesce("match.url_regex", F.lit("")) != ""))
    by_regex = _proposed(pages.select("page_id", "base_url"), open_rules.select("id", F.col("match.url_regex").alias("_p"))).withColumn("_domain", F.lit(False))
    detail = rules.select("id", "priority", F.coalesce("match.url_regex", F.lit("")).alias("_p"), F.coalesce("match.exclude_url_regex", F.lit("")).alias("_x"))
    joined = by_domain.unionByName(by_regex).join(_small(detail), "id")
    regex_hit = (F.col("_p") != "") & F.rlike(F.col("base_url"), F.col("_p"))
    score = (F.when((F.col("_x") != "") & F.rlike(F.col("base_url"), F.col("_x")), 0.0).when((F.col("_p") != "") & ~regex_hit, 0.0)
             .when(F.col("_domain") & regex_hit, 1.0).when(F.col("_domain"), 0.9).when(regex_hit, 0.85).otherwise(0.0))
    scored = joined.withColumn("score", score).filter(F.col("score") > 0)
    # a page matches few rules
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "priority", "id")
    return scored.withColumn("rank", F.row_number().over(order)).select("page_id", "base_url", F.col("id").alias("rule_id"), "priority", "score", "rank")


def page_rule_for(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pagination settings of the best matching rule that has any."""
    paged = rules.filter(F.col("pagination").isNotNull()).select(F.col("id").alias("rule_id"), "pagination")
    found = match_rules(pages, rules).join(_small(paged), "rule_id")
    return found.groupBy("page_id").agg(F.min_by(F.struct("rule_id", "pagination"), "rank").alias("f")).select("page_id", "f.rule_id", "f.pagination.*")


def extract_media_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Media named by the matching rules: selectors, then expressions; page markup is read once per spec."""
    detail = rules.select(F.col("id").alias("rule_id"), "media", "regex", "album", "headers")
    jobs = match_rules(pages, rules).join(_small(detail), "rule_id").join(pages.select("page_id", "html"), "page_id")
    # the album's selector goes first, the media selectors follow: all of a rule's in one pass over the page
    specs = F.coalesce("media", F.array().cast(dict(rules.dtypes)["media"]))
    selectors = F.concat(F.array(F.coalesce("album.selector", F.lit(""))), F.transform(specs, lambda s: F.coalesce(s["selector"], F.lit(""))))
    attrs = F.concat(F.array(F.coalesce("album.attr", F.lit("text"))), F.transform(specs, lambda s: F.coalesce(s["attr"], F.lit("src"))))
    jobs = jobs.withColumn("_found", arrow.select_lists(F.col("html"), selectors, attrs))
    album = F.get(F.get("_found", F.lit(0)), F.lit(0))
    jobs = jobs.withColumn("_album", F.coalesce(F.left(F.trim(album), F.lit(60)), html.page_album(F.col("html"))))
    keep = ["page_id", "base_url", "rule_id", "rank", "_album", "headers"]
    picked = unnest(jobs, [*keep, "_found"], "media", "s", "_spec").withColumn("_values", F.get("_found", F.col("_spec") + 1))
    values = unnest(picked, [*keep, "s", "_spec"], "_values", "raw", "_at")
    raw = F.when(F.col("s.attr") == "srcset", html.best_srcset(F.col("raw"))).otherwise(F.col("raw"))
    values = values.withColumn("url", urls.resolve_url(F.col("base_url"), raw)).filter(
        (F.col("url") != "") & ((F.coalesce("s.require", F.lit("")) == "") | F.rlike(F.col("url"), F.col("s.require"))))
    ups = F.transform(F.filter(F.coalesce("s.upgrade", F.array().cast("array<array<string>>")), lambda p: (F.size(p) >= 2) & F.contains(F.col("url"), F.get(p, F.lit(0)))),
                      lambda p: F.struct(F.replace(F.col("url"), F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("url"), F.col("url").alias("from")))
    both = F.concat(F.array(F.struct(F.col("url"), F.lit("").alias("from"))), ups)
    by_selector = unnest(values.withColumn("_kind", F.coalesce(F.nullif("s.kind", F.lit("")), media.kind_of(F.col("url")))),
                         [*keep, "_spec", "_at", "_kind"], both, "c", "_step")
    patterns = unnest(jobs, [*keep, "html"], "regex", "s", "_spec")
    found = F.call_function("regexp_extract_all", F.col("html"), F.when(F.coalesce("s.ignore_case", F.lit(True)), F.concat(F.lit("(?i)"), F.col("s.pattern")))
                            .otherwise(F.col("s.pattern")), F.coalesce(F.nullif("s.group", F.lit(0)), F.lit(1)))
    by_regex = unnest(patterns, [*keep, "s", "_spec"], found, "raw", "_at").withColumn("url", urls.resolve_url(F.col("base_url"), F.col("raw"))).filter("url <> ''") \
        .select(*keep, F.lit(1).alias("_part"), "_spec", "_at", F.coalesce(F.nullif("s.kind", F.lit("")), media.kind_of(F.col("url"))).alias("_kind"),
                F.struct(F.col("url"), F.lit("").alias("from")).alias("c"), F.lit(0).alias("_step"))
    rows = by_selector.withColumn("_part", F.lit(0)).unionByName(by_regex).filter(media.is_media_kind(F.col("_kind")))
    order = F.struct("_part", "_spec", "_at", "_step")
    firsts = rows.groupBy("page_id", "rule_id", F.col("c.url").alias("url"))
    ones = firsts.agg(F.min_by(F.struct("base_url", "rank", "_album", "headers", "_kind", "c"), order).alias("m"), F.min(order).alias("o"))
    # the index counts inside (page, rule): as many rows as a page names
    numbered = ones.withColumn("index", F.row_number().over(Window.partitionBy("page_id", "rule_id").orderBy("o")).cast("long"))
    numbered = numbered.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("m.rank", "index")).cast("long"))
    empty = F.create_map().cast("map<string,string>")
    return numbered.select(
        F.col("page_id").alias("page_seq"), F.lit(50).alias("priority"), "pos", "url",
        F.col("m._kind").alias("kind"), F.col("m.base_url").alias("source_page"), F.col("m._album").alias("album"), F.lit("").alias("title"), "index",
        F.lit("").alias("ext"), F.coalesce("m.headers", empty).alias("headers"), F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"),
        F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("duration"), F.concat(F.lit("rule:"), "rule_id").alias("origin"),
        F.when(F.col("m.c.from") != "", F.create_map(F.lit("upgraded_from"), F.col("m.c.from"))).otherwise(empty).alias("extra"))


def extract_detail_links(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Listing links of the best rule that has a selector for them: page, position, link."""
    having = rules.filter(F.coalesce("detail_links.selector", F.lit("")) != "").select(F.col("id").alias("rule_id"), "detail_links")
    best = (match_rules(pages, rules).join(_small(having), "rule_id").groupBy("page_id", "base_url")
            .agg(F.min_by("detail_links", "rank").alias("d")))
    jobs = best.join(pages.select("page_id", "html"), "page_id")
    found = jobs.withColumn("_v", arrow.select_values(F.col("html"), F.col("d.selector"), F.coalesce(F.nullif("d.attr", F.lit("")), F.lit("href")))).drop("html")
    links = F.array_distinct(F.filter(F.transform("_v", lambda v: urls.resolve_url(F.col("base_url"), v, keep_fragment=False)),
                                      lambda u: (u != "") & F.contains(u, F.coalesce("d.pattern", F.lit("")))))
    return unnest(found, ["page_id", "base_url"], links, "link", "pos")


_PLUGINS: dict = {}


def register_extractor(name: str, priority: int, extract, can_handle=None) -> None:
    """A plug-in: ``extract(pages) -> media rows``; ``can_handle`` is a column test on pages."""
    _PLUGINS[name] = (priority, extract, can_handle)


def run_plugins(pages: DataFrame) -> tuple[list[DataFrame], dict[str, str]]:
    """Media of all plug-ins in priority order, and why plug-ins were left out.

    Every plug-in is run and its rows are written before they are handed on, so one that can't be planned and one that fails on some page
    are both left out and named, and neither stops the others. Errors in the library itself are not plug-in errors and are raised.
    """
    out, problems = [], {}
    for name, (priority, extract, can_handle) in sorted(_PLUGINS.items(), key=lambda p: p[1][0]):
        own = pages if can_handle is None else pages.filter(can_handle)
        try:
            rows = extract(own)
            if not isinstance(rows, DataFrame):
                raise TypeError(f"{type(rows).__name__} instead of a DataFrame")
            out.append(cut_lineage(rows.withColumn("priority", F.lit(priority))))
        except (PySparkException, Py4JError, ArithmeticError, AttributeError, LookupError, TypeError, ValueError) as exc:
            problems[name] = str(exc)
    return out, problems


#: why plug-ins were left out by the last call of ``plugin_sources``
PLUGIN_PROBLEMS: dict[str, str] = {}


def plugin_sources(pages: DataFrame) -> list[DataFrame]:
    """Media of all plug-ins in priority order; the problems of this call are in PLUGIN_PROBLEMS."""
    out, problems = run_plugins(pages)
    PLUGIN_PROBLEMS.clear()
    PLUGIN_PROBLEMS.update(problems)
    return out
