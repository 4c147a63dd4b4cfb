"""Near pairs and greedy groups against plain loops, and a long chain."""

import random
import time

import pytest

from siftweb.operators import media


def some_hashes(seed, n=250):
    rng = random.Random(seed)
    out = [rng.getrandbits(63) for _ in range(n // 5)]
    while len(out) < n:
        h = rng.choice(out)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(63)
        out.append(h)
    return [(i, h) for i, h in enumerate(out)]


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 4, 5])
def test_pairs(spark, threshold):
    rows = some_hashes(threshold)
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    items = sorted((i, h) for h, i in first.items() if h)
    want = {(a, b, (x ^ y).bit_count()) for a, x in items for b, y in items if a < b and (x ^ y).bit_count() <= threshold}
    got = media.near_duplicate_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", threshold).collect()
    assert sorted((r["a_key"], r["b_key"], r["distance"]) for r in got) == sorted(want)


@pytest.mark.parametrize("run,links", [(100_000, 2_000_000), (7, 5), (3, 0)])
def test_groups(spark, monkeypatch, run, links):
    monkeypatch.setattr(media, "RUN", run)
    monkeypatch.setattr(media, "RUN_LINKS", links)
    rows = some_hashes(11, 80)
    keepers, want = [], {}
    for i, h in rows:
        near = next((k for k, x in keepers if (x ^ h).bit_count() <= 4), None) if h else None
        if h and h not in want:
            want[h] = i if near is None else near
            if near is None:
                keepers.append((i, h))
    got = media.perceptual_groups(spark.createDataFrame(rows, "id long, h long").withColumn("at", media.F.col("id")), "id", "h", "at", 4).collect()
    assert {r["h"]: r["keeper_order"] for r in got} == want and len(got) == sum(h != 0 for _, h in rows)


def test_pairs_broadcast_no_unfolded_side(spark):
    rows = spark.range(2000).selectExpr("id", "xxhash64(id) AS h")
    pairs = media.near_duplicate_pairs(rows, "id", "h", 3)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    started = time.time()
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = media._leaders(nodes, spark.range(1, n).selectExpr("id AS node", "id - 1 AS earlier"))
    assert got.filter("keeper = node").count() == n // 2 and got.filter("keeper <> node - node % 2").count() == 0
    assert time.time() - started < 120
