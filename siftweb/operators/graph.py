"""Iterative operators. Each round is one Spark job over whole tables; lineage is cut by reliable checkpoints."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.operators.filters import url_filter
from siftweb.scale import BROADCAST_ROWS, number_all
from siftweb.session import cut_lineage


def unvisited(frontier: DataFrame, visited: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    return frontier.join(visited.select(*keys), list(keys), "left_anti")


#: a frontier is broadcast up to so many bytes of addresses
FRONTIER_BYTES = 16 << 20


def _sized(frontier: DataFrame):
    """How many rows a frontier has, and what marks it for a broadcast if its counted size allows that: then the links are only read, not moved."""
    rows, size = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    return rows, F.broadcast if rows <= BROADCAST_ROWS and size <= FRONTIER_BYTES else lambda df: df


def bfs_crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int = 0,
              block: Sequence[str] = (), allow: Sequence[str] = ()) -> DataFrame:
    """Breadth-first levels over ``edges(src, dst)`` from ``seeds(url)``: url and least depth.

    One exchange per level for the distinct and the anti join; links may repeat and move only where a frontier is too large for a broadcast. A page budget takes a level's addresses
    in order; the level that exhausts it is cut and the walk ends there.
    """
    def wanted(df: DataFrame) -> DataFrame:
        if not block and not allow:
            return df
        return url_filter(df, block, allow).filter("allowed").select("url")

    frontier = cut_lineage(wanted(seeds.select("url").distinct()))
    visited, budget = None, max_pages
    for depth in range(max_depth + 1):
        size, near = _sized(frontier)
        if size == 0:
            break
        if max_pages and size > budget:
            frontier = cut_lineage(first_in_order(frontier, "url", budget))
        level = frontier.select("url", F.lit(depth).alias("depth"))
        visited = level if visited is None else visited.unionByName(level)
        budget -= size
        if depth == max_depth or (max_pages and budget <= 0):
            break
        steps = edges.join(near(frontier.withColumnRenamed("url", "src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = cut_lineage(unvisited(wanted(steps), visited))
    return visited if visited is not None else seeds.select("url", F.lit(0).alias("depth")).limit(0)


def first_in_order(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` smallest rows: ranges of the full value are cut, counted and numbered inside.

    The ranges are checkpointed, so a row keeps its range in both passes; one count per range meets in one task.
    """
    ranged = cut_lineage(df.repartitionByRange(column)).withColumn("_range", F.spark_partition_id())
    return number_all(ranged, [column], F.col("_range"), "_n").filter(F.col("_n") <= n).drop("_n", "_range")


def media_frontier(detail: DataFrame, paging: DataFrame, seeds: DataFrame, max_depth: int, hard_cap: int = 0) -> DataFrame:
    """Pages reached over two edge kinds: paging keeps the depth, detail links add one.

    Rounds relax (url, least depth) until nothing changes; ``hard_cap`` is the user's page budget, 0 for none. Links may repeat.
    """
    best = cut_lineage(seeds.select("url", F.lit(0).alias("depth"), F.lit(0).alias("round")).distinct())
    fresh, near = best, _sized(best)[1]
    for step in count(1):
        same = paging.join(near(fresh.select(F.col("url").alias("src"), "depth")), "src").select(F.col("dst").alias("url"), "depth")
        deeper = detail.join(near(fresh.filter(F.col("depth") < max_depth).select(F.col("url").alias("src"), (F.col("depth") + 1).alias("depth"))), "src") \
            .select(F.col("dst").alias("url"), "depth")
        found = same.unionByName(deeper).groupBy("url").agg(F.min("depth").alias("depth"))
        known = best.select("url", F.col("depth").alias("old"), F.col("round").alias("old_round"))
        fresh = cut_lineage(found.join(known, "url", "left").filter(F.col("old").isNull() | (F.col("depth") < F.col("old")))
                            .select("url", "depth", F.coalesce("old_round", F.lit(step)).alias("round")))
        size, near = _sized(fresh)
        if size == 0:
            break
        best = cut_lineage(best.join(fresh.select("url"), "url", "left_anti").unionByName(fresh))
    return best.orderBy("round", "depth", "url").limit(hard_cap) if hard_cap else best


def next_chain(links: DataFrame, starts: DataFrame, max_pages: int = 0) -> DataFrame:
    """Pages of each start in reading order over ``links(node, next)``: start, node, dist; ``max_pages`` 0 for all.

    Pointer doubling: after k rounds every node within 2^k steps is known, so a book of n pages takes
    log2(n) joins for all books at once. A cycle ends where it would repeat.
    """
    jump = links.filter(F.col("next").isNotNull()).groupBy("node").agg(F.min("next").alias("next"))
    chain = cut_lineage(starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("dist")).distinct())
    span, jump, known = 1, cut_lineage(jump), chain.count()
    while not max_pages or span < max_pages:
        # known nodes sit at distances below ``span``; one jump of ``span`` steps doubles them
        ahead = chain.join(jump, "node").select("start", F.col("next").alias("node"), (F.col("dist") + span).alias("dist"))
        chain = chain.unionByName(ahead).groupBy("start", "node").agg(F.min("dist").alias("dist"))
        chain = cut_lineage(chain.filter(F.col("dist") < max_pages) if max_pages else chain)
        before, known = known, chain.count()
        if known == before:
            break
        other = jump.select(F.col("node").alias("next"), F.col("next").alias("after"))
        jump = cut_lineage(jump.join(other, "next").select("node", F.col("after").alias("next")))
        span *= 2
    return chain


def chain_stop_reason(chain: DataFrame, links: DataFrame, max_pages: int = 0) -> DataFrame:
    """Why each chain ended: no next page, a page seen before, or the page limit."""
    last = chain.groupBy("start").agg(F.max(F.struct("dist", "node")).alias("l")) \
        .select("start", F.col("l.node").alias("node"), (F.col("l.dist") + 1).alias("pages"))
    nexts = links.groupBy("node").agg(F.min("next").alias("next"))
    joined = last.join(nexts, "node", "left")
    return joined.select("start", "pages", F.when(F.col("next").isNull(), "end")
                         .when(F.lit(max_pages > 0) & (F.col("pages") >= max_pages), "limit").otherwise("loop").alias("stop_reason"))


def fail_cascade(tasks: DataFrame) -> DataFrame:
    """Failure runs down to pending dependents, on and on: all tasks with their final status.

    ``failed`` here means out of retries. A pending task fails if a failed one can be reached along its dependencies; its cause is
    the dependency nearest to a failed task, the least of several.
    """
    retryable = (F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries"))
    state = tasks.withColumns({"status": F.when(retryable, "pending").otherwise(F.col("status")),
                               "retry_count": F.when(retryable, F.col("retry_count") + 1).otherwise(F.col("retry_count"))})
    state = cut_lineage(state)
    dead = cut_lineage(state.filter(F.col("status") == "failed").select("id").distinct())
    pending = state.filter(F.col("status") == "pending")
    mortal = pending.select(F.col("id").alias("dep")).unionByName(dead.select(F.col("id").alias("dep"))).distinct()
    edges = cut_lineage(pending.select("id", F.explode_outer("depends_on").alias("dep")).filter("dep is not null").distinct().join(mortal, "dep", "left_semi"))
    near = distances(edges, dead).select(F.col("id").alias("dep"), "dist")
    reached = edges.join(near, "dep").groupBy("id").agg(F.min(F.struct("dist", "dep")).alias("least")).select("id", F.col("least.dep").alias("cause"))
    return (state.join(reached, "id", "left")
            .withColumn("error", F.when(F.col("cause").isNotNull(), F.concat(F.lit("依赖任务（任务"), F.col("cause").cast("string"), F.lit("）已失败"))).otherwise(""))
            .withColumn("status", F.when(F.col("cause").isNotNull(), "failed").otherwise(F.col("status"))).drop("cause"))


def distances(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, dist): least number of ``edges(id, dep)`` from every node to one of ``targets(id)``, for nodes that reach one.

    Nodes with one edge only pass on: pointer doubling takes each of them to the end of its chain, in as many rounds as the chain's length
    has binary digits. What is left are the nodes with several edges, whose distances settle in as many rounds as such nodes follow each other.
    """
    targets = targets.select("id").distinct()
    edges = edges.join(targets, "id", "left_anti")  # a target is reached where it stands
    several = edges.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("dep").alias("to"))
    chain = cut_lineage(several.filter("_n = 1").select("id", "to", F.lit(1).cast("long").alias("w")))
    for _ in range(chain.count().bit_length() + 1):
        ahead = chain.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("w").alias("more"))
        chain = cut_lineage(chain.join(ahead, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
                                                                   F.col("far").isNotNull().alias("moved")))
        if chain.filter("moved").isEmpty():
            break
        chain = chain.drop("moved")
    # a chain that still moves runs in a circle
    ends = chain.select("id", "to", "w").join(chain.select(F.col("id").alias("to")), "to", "left_anti")
    forks = edges.join(several.filter("_n > 1").select("id"), "id", "left_semi").join(
        ends.select(F.col("id").alias("dep"), F.col("to").alias("far"), "w"), "dep", "left").select(
        "id", F.coalesce("far", "dep").alias("to"), (F.coalesce("w", F.lit(0)) + 1).alias("w"))
    forks = cut_lineage(forks.groupBy("id", "to").agg(F.min("w").alias("w")))
    known = fresh = cut_lineage(targets.select("id", F.lit(0).cast("long").alias("dist")))
    while True:
        found = forks.join(fresh.select(F.col("id").alias("to"), "dist"), "to").groupBy("id").agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        better = found.join(known.select("id", F.col("dist").alias("old")), "id", "left").filter(F.col("old").isNull() | (F.col("dist") < F.col("old")))
        fresh = cut_lineage(better.select("id", "dist"))
        if fresh.isEmpty():
            break
        known = cut_lineage(known.join(fresh.select("id"), "id", "left_anti").unionByName(fresh))
    passed = ends.join(known.select(F.col("id").alias("to"), "dist"), "to").select("id", (F.col("dist") + F.col("w")).alias("dist"))
    return known.unionByName(passed)


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks whose every existing dependency is completed; a missing one counts as satisfied."""
    waits = (tasks.filter(F.col("status") == "pending").select("id", F.explode_outer("depends_on").alias("dep")).filter("dep is not null")
             .join(tasks.filter(F.col("status") != "completed").select(F.col("id").alias("dep")), "dep", "left_semi"))
    return tasks.filter(F.col("status") == "pending").join(waits.select("id"), "id", "left_anti")


def pending_order(tasks: DataFrame, slots: int) -> DataFrame:
    return ready_tasks(tasks).orderBy("priority", "id").limit(slots)


TASK_STATES = ["pending", "running", "completed", "paused", "failed"]


def task_summary(tasks: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("pages", "links", "media", "elapsed") if c in tasks.columns]
    return tasks.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in TASK_STATES], *sums)


def compare_tasks(tasks: DataFrame) -> DataFrame:
    """One line per task with readable status and priority, for side-by-side reading."""
    # --- fixed values: display names
    status = {"pending": "待执行", "running": "执行中", "completed": "已完成", "paused": "已暂停", "failed": "失败"}
    priority = {0: "高", 1: "中", 2: "低"}
    named, ranked = F.col("status"), F.lit("-")
    for key, text in status.items():
        named = F.when(F.col("status") == key, text).otherwise(named)
    for key, text in priority.items():
        ranked = F.when(F.col("priority") == key, text).otherwise(ranked)
    return tasks.withColumn("status_text", named).withColumn("priority_text", ranked)


def merged_results(results: DataFrame, tasks: DataFrame, task_ids: Sequence[int] | None = None) -> DataFrame:
    """Outputs of all or chosen tasks with the task's name."""
    chosen = results if task_ids is None else results.filter(F.col("task_id").isin(list(task_ids)))
    return chosen.join(tasks.select(F.col("id").alias("task_id"), F.col("name").alias("task_name")), "task_id")


# ---- paging candidates -------------------------------------------------------------

def _own_number(base: Column, name: Column) -> Column:
    """(name, value) of the query part called ``name`` if it is a number."""
    from siftweb.functions import urls

    parts = F.filter(F.split(urls.query_of(base), "&"), lambda p: (F.lower(F.substring_index(p, "=", 1)) == F.lower(name)) & p.rlike("^[^=]+=[0-9]+$"))
    first = F.get(parts, F.lit(0))
    return F.when((F.coalesce(name, F.lit("")) != "") & first.isNotNull(), F.struct(
        F.substring_index(first, "=", 1).alias("name"), F.substring_index(first, "=", -1).try_cast("long").alias("value")))


def next_pages(pages: DataFrame, step: int = 1, most: int = 0, rule: DataFrame | None = None) -> DataFrame:
    """Next-page addresses per page, in order of trust: links, own number, inferred numbering; ``most`` of them, 0 for all.

    ``rule``: page_id, strategy, template, param, start, step, as ``rules.page_rule_for`` gives them. ``next_link`` follows
    links only, ``page_param`` numbers only, ``api_offset`` the template only, ``auto`` links and numbers. A template's
    ``{n}`` is start + page_index * step, where ``page_index`` is a column of ``pages`` or 1. Pages without a rule are ``auto``.
    """
    from siftweb.functions import fixed, html, urls
    from siftweb.functions.urls import bind
    from siftweb.scale import unnest

    names = ["strategy", "template", "param", "start", "step"]
    if rule is None:
        setting = dict.fromkeys(names, F.lit(None).cast("string")) | {"start": F.lit(1), "step": F.lit(step)}
    else:
        pages = pages.join(rule.select("page_id", F.struct(*names).alias("_rule")), "page_id", "left")
        setting = {n: F.col(f"_rule.{n}") for n in names}
    strategy = F.coalesce(F.nullif(setting["strategy"], F.lit("")), F.lit("auto"))
    step = F.greatest(F.coalesce(setting["step"], F.lit(step)), F.lit(1)).cast("long")
    index = F.greatest(F.col("page_index"), F.lit(1)) if "page_index" in pages.columns else F.lit(1)
    template = F.nullif(setting["template"], F.lit(""))
    from_template = F.replace(template, F.lit("{n}"), (F.coalesce(setting["start"], F.lit(1)) + index * step).cast("string"))
    base = F.col("base_url")
    clean = lambda href: urls.resolve_url(base, href, keep_fragment=False)
    tag_href = lambda t: F.regexp_extract(t, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)
    rel = F.filter(F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*\brel\s*=\s*["']next["'][^>]*>"""), F.lit(0)), lambda t: tag_href(t) != "")
    texts = F.filter(F.regexp_extract_all("html", F.lit(html.ANCHOR), F.lit(0)), lambda t: (tag_href(t) != "") & urls.trimmed(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)^<a\b[^>]*>", ""), r"(?i)</a>$", ""), "<[^>]+>", "")).rlike(fixed.NEXT_TEXT))
    linked = F.transform(F.concat(rel, texts), lambda t: clean(tag_href(t)))
    own = F.coalesce(_own_number(base, setting["param"]), urls.query_param(base)) if rule is not None else urls.query_param(base)
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1)))
    near = F.filter(F.transform(hrefs, clean), lambda u: (u != "") & urls.same_site(u, base))
    staged = pages.withColumn("_own", own).withColumn("_linked", linked).withColumn(
        "_near", F.when(own["name"].isNull(), near).otherwise(F.array().cast("array<string>")))
    here = urls.split_trailing_number(urls.path_of(base))
    staged = staged.withColumn("_here", here)

    def pick_next(numbers, current):
        later = F.array_min(F.filter(numbers, lambda n: n > 1))
        return F.when(current > 0, current + step).otherwise(F.coalesce(later, F.array_max(numbers) + step))

    same_path = F.filter("_near", lambda u: urls.path_of(u) == urls.path_of(base))
    params = F.filter(F.transform(same_path, lambda u: urls.query_param(u)), lambda p: p["name"].isNotNull())
    first_name = F.get(params, F.lit(0))["name"]
    numbers = F.transform(F.filter(params, lambda p: p["name"] == first_name), lambda p: p["value"])
    by_param = F.when(F.size(params) > 0, urls.with_param(base, first_name, pick_next(numbers, F.lit(0))))
    siblings = F.filter(F.transform("_near", lambda u: urls.split_trailing_number(urls.path_of(u))),
                        lambda s: (s["prefix"] == F.col("_here.prefix")) & (s["suffix"] == F.col("_here.suffix")))
    next_number = bind(F.transform(siblings, lambda s: s["number"]), lambda ns: pick_next(ns, F.col("_here.number")))
    path = F.concat(F.col("_here.prefix"), next_number.cast("string"), F.col("_here.suffix"))
    query = F.when(urls.query_of(base) != "", F.concat(F.lit("?"), urls.query_of(base))).otherwise("")
    by_path = F.when(F.size(siblings) > 0, F.concat(urls.part(base, 1), F.lit("://"), urls.url_domain(base), path, query))
    numbered = F.when(F.col("_own.name").isNotNull() & (F.col("_own.value") > 0),
                      F.array(urls.with_param(base, F.col("_own.name"), F.col("_own.value") + step))).otherwise(F.array(by_param, by_path))
    none = F.array().cast("array<string>")
    numbered = F.when(template.isNotNull(), F.array(from_template)).otherwise(numbered)
    by_rule = F.when(strategy.isin("auto", "page_param"), numbered).when(strategy == "api_offset", F.array(from_template)).otherwise(none)
    staged = staged.withColumn("_numbered", by_rule).withColumn("_linked", F.when(strategy.isin("auto", "next_link"), F.col("_linked")).otherwise(none))
    fits = F.filter(F.array_distinct(F.concat("_linked", "_numbered")), lambda u: u.isNotNull() & (u != "") & (u != base)
                    & ~u.rlike(fixed.PAGED_MEDIA) & urls.same_site(u, base))
    return unnest(staged, ["page_id", "base_url"], F.slice(fits, 1, most) if most else fits, "next_url", "rank")
