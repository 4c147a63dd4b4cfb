"""Cascades against a plain walk, long chains, and site rules and plug-ins at their limits."""

import random
import re
import time
from collections import deque

import pytest

from siftweb.operators import graph, rules


def plain(edges, dead):
    users, dist = {}, {d: 0 for d in dead}
    for a, b in edges:
        users.setdefault(b, []).append(a)
    queue = deque(dead)
    while queue:
        b = queue.popleft()
        for a in users.get(b, []):
            if a not in dist:
                dist[a] = dist[b] + 1
                queue.append(a)
    return dist


@pytest.mark.parametrize("seed", range(4))
def test_distances(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = {(i, rng.randrange(max(0, i - 9), i + (5 if seed == 3 else 0)) if i else 1) for i in range(n) for _ in range(rng.choice([1, 1, 1, 2, 3]))}
    edges = {(a, b) for a, b in edges if a != b}
    dead = set(rng.sample(range(n), 4))
    got = graph.distances(spark.createDataFrame(sorted(edges), "id long, dep long"), spark.createDataFrame([(d,) for d in dead], "id long")).collect()
    assert sorted((r["id"], r["dist"]) for r in got) == sorted(plain(edges, dead).items())


def test_long_chain(spark):
    n = 100_000
    tasks = spark.range(n).selectExpr("id", "if(id = 0, 'failed', 'pending') AS status", "0 AS retry_count", "0 AS max_retries", "if(id = 0, array(), array(id - 1)) AS depends_on")
    started = time.time()
    out = graph.fail_cascade(tasks)
    assert out.filter("status = 'failed'").count() == n
    assert out.filter("id = 77777").first()["error"] == "依赖任务（任务77776）已失败"
    assert time.time() - started < 200


def test_cause_is_the_least_of_the_nearest(spark):
    tasks = spark.createDataFrame([(1, "failed", 0, 0, []), (2, "pending", 0, 0, [1]), (3, "failed", 0, 0, []), (4, "pending", 0, 0, [2, 3, 9]), (5, "pending", 0, 0, [6]),
                                   (6, "pending", 0, 0, [5]), (7, "failed", 0, 2, []), (8, "pending", 0, 0, [7])],
                                  "id long, status string, retry_count int, max_retries int, depends_on array<long>")
    got = {r["id"]: (r["status"], r["error"], r["retry_count"]) for r in graph.fail_cascade(tasks).collect()}
    assert got[4] == ("failed", "依赖任务（任务3）已失败", 0) and got[2][0] == "failed" and got[5][0] == got[6][0] == got[8][0] == "pending" and got[7] == ("pending", "", 1)


RULE = "id string, enabled boolean, priority int, match struct<domain: array<string>, url_regex: string, exclude_url_regex: string>"


def _match(spark, addresses, expressions):
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, base_url string")
    listed = spark.createDataFrame([(i, True, 5, (None, e, None)) for i, e in expressions], RULE)
    return {(r["page_id"], r["rule_id"]) for r in rules.match_rules(pages, listed).collect()}


def test_open_rules_against_every_expression(spark, monkeypatch):
    monkeypatch.setattr(rules, "TOGETHER", 3)
    rng = random.Random(2)
    hosts = ["shop.example.com", "IMG.example.org", "a.bc", "été.example"]
    addresses = [f"https://{rng.choice(hosts)}/{rng.choice(['item', 'List', 'p'])}/{rng.randrange(99)}" for _ in range(60)]
    expressions = [("r1", r"shop\.example\.com/item/\d+"), ("r2", r"(?i)/list/"), ("r3", r"\d\d$"), ("r4", "(item|list)/[0-4]"), ("r5", "^https://a"), ("r6", "x?"), ("r7", "(?i)IMG"), ("r8", "é")]
    want = {(i, r) for i, a in enumerate(addresses) for r, e in expressions if re.search(e, a)}
    assert _match(spark, addresses, expressions) == want


def test_a_hundred_thousand_open_rules(spark):
    expressions = [(f"r{i:06d}", rf"^https?://site{i:06d}\.example\.com/(item|page)/\d+") for i in range(100_000)]
    got = _match(spark, ["https://site000777.example.com/item/5", "https://site099999.example.com/page/1", "https://other.example.com/item/5"], expressions)
    assert got == {(0, "r000777"), (1, "r099999")}


def test_plugins_that_fail_while_running(spark):
    from pyspark.sql import functions as F

    pages = spark.range(3)
    rules.register_extractor("late", 1, lambda p: p.select((F.lit(1) / (F.col("id") - 1)).alias("url")))
    rules.register_extractor("fine", 2, lambda p: p.select(F.col("id").alias("url")))
    rules.register_extractor("wrong", 3, lambda p: None)
    try:
        rows, problems = rules.run_plugins(pages)
        assert len(rows) == 1 and rows[0].count() == 3 and set(problems) == {"late", "wrong"} and "DIVIDE_BY_ZERO" in problems["late"]
    finally:
        for name in ("late", "fine", "wrong"):
            rules._PLUGINS.pop(name)
