"""Batches under a budget against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from siftweb.operators.batching import batch_by_budget


def plain(sizes, budget):
    batch, used, out = 0, 0, []
    for size in sizes:
        if used and used + size > budget:
            batch, used = batch + 1, 0
        used += size
        out.append(batch)
    return out


@pytest.mark.parametrize("seed,n,budget,most", [(1, 1, 10, 5), (2, 700, 30, 9), (3, 900, 12, 20), (4, 1000, 1, 3), (5, 2000, 60, 60)])
def test_against_the_loop(spark, seed, n, budget, most):
    rng = random.Random(seed)
    sizes = [rng.randint(1, most) for _ in range(n)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, own int").repartition(5)
    got = {r["id"]: r["batch"] for r in batch_by_budget(rows, [F.col("id")], F.col("own"), budget, "id", block_rows=37).collect()}
    assert [got[i] for i in range(n)] == plain(sizes, budget)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "id long, own int")
    assert batch_by_budget(rows, [F.col("id")], F.col("own"), 10, "id").count() == 0
