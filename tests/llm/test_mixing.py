"""Mixing: targets, the least-squares solution, copies, edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftweb.llm import mixing


def narrow(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.6, 0.2, 0.3], n)
    t = rng.integers(1, 400, n)
    return spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p))], "doc_id long, tokens long, posterior array<double>").repartition(4), t, p


def plain(t, p, share, most=None, steps=200_000):
    """The same objective by plain projected gradient in the document metric."""
    r, targets = np.ones(len(t)), share / share.sum() * t.sum()
    inverse = np.linalg.inv((p * t[:, None]).T @ p)
    for _ in range(400):
        r = np.clip(r - (p @ inverse @ (p.T @ (t * r) - targets) + mixing.PULL * (r - 1)) / (1 + mixing.PULL), 0, most)
    return r, targets


@pytest.mark.parametrize("share", [(0.5, 0.25, 0.25), (0.9, 0.1, 0.0), (0.05, 0.05, 0.9)])
def test_rates_meet_the_targets(spark, share):
    rows, t, p = narrow(spark)
    fitted, figures = mixing.fit_rates(rows, dict(zip(mixing.DOMAINS, share)))
    rate = np.array([r["rate"] for r in fitted.orderBy("doc_id").collect()])
    want, targets = plain(t, p, np.array(share))
    assert (rate >= 0).all()
    totals = np.array([figures["totals"][d] for d in mixing.DOMAINS])
    assert np.abs(totals - p.T @ (t * rate)).max() < 1e-6 * t.sum()
    if (want > 0).all():
        assert np.abs(totals - targets).max() < 1e-3 * t.sum()
    assert np.abs(p.T @ (t * rate) - targets).max() <= np.abs(p.T @ (t * want) - targets).max() + 2e-3 * t.sum()
    if (want > 0).all():
        assert np.abs(rate - want).max() < 0.01


def test_a_held_domain_keeps_its_total(spark):
    rows, t, p = narrow(spark)
    fitted, figures = mixing.fit_rates(rows, {"plain": 0.9, "poor": 0.1}, hold="plain", most=1.0)
    rate = np.array([r["rate"] for r in fitted.orderBy("doc_id").collect()])
    assert rate.min() >= 0 and rate.max() <= 1
    assert abs(figures["targets"]["plain"] - (t * p[:, 0]).sum()) < 1e-6 * t.sum()
    assert (t * rate * p[:, 1]).sum() < (t * p[:, 1]).sum()
    # the totals are those of the least-squares solution, which the bound keeps from the targets
    share = np.array([0.9, 0.0, 0.1])
    r, inverse, targets = np.ones(len(t)), np.linalg.inv((p * t[:, None]).T @ p), share * (t * p[:, 0]).sum() / 0.9
    for _ in range(20_000):
        r = np.clip(r - (p @ inverse @ (p.T @ (t * r) - targets) + mixing.PULL * (r - 1)) / (1 + mixing.PULL), 0, 1)
    assert np.abs(p.T @ (t * rate) - p.T @ (t * r)).max() < 1e-3 * t.sum()


def test_report_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other", i, 5, "x", 1) for i in range(50)], "doc_id long, text string, `_ID` long, _copies int, _one string, RATE int")
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    rows, report = mixing.plan(docs, labels, {"plain": 0.5, "poor": 0.5})
    got = {r["domain"]: r for r in report.collect()}
    assert set(got) == set(mixing.DOMAINS) and got["plain"]["met"] and got["poor"]["met"] and rows.count() == 50
    mixed = mixing.mix(docs, labels, {"plain": 1.0, "poor": 0.0}, most=1.0)
    assert mixed.columns == docs.columns and all(r["_copies"] == 5 and r["_ID"] == r["doc_id"] for r in mixed.collect())


def test_copies_follow_the_rates(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), mixing.copies_of(F.lit(1.3), F.col("id")).alias("c"))
    got = [r["c"] for r in rows.collect()]
    assert set(got) == {1, 2} and abs(np.mean(got) - 1.3) < 0.02


def test_documents(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdef", k=4)) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(words), 9))
        labels += [(i, 1, int(toxic))] * (i % 3 != 0)
    docs = spark.createDataFrame([*rows, (900, None, 9), (901, "", 9), (0, rows[0][1], 9), (None, "no id", 9), (902, "long " * 60_000, 9)], "doc_id long, text string, tokens int")
    table = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mixing.rates(docs, table, {"plain": 0.97, "toxic": 0.03}).collect()}
    assert len(got) == 404 and all(abs(sum(r["posterior"]) - 1) < 1e-6 and r["rate"] >= 0 for r in got.values())
    assert np.mean([got[i]["posterior"][1] > 0.5 for i in range(0, 400, 4)]) > 0.95
    assert np.mean([got[i]["posterior"][1] < 0.5 for i in range(400) if i % 4]) > 0.95
    assert got[900]["tokens"] == got[901]["tokens"] == 0
    mixed = mixing.mix(docs, table, {"plain": 0.97, "toxic": 0.03}, hold="plain", most=1.0)
    assert mixed.columns == docs.columns
    kept = {r["doc_id"] for r in mixed.select("doc_id").collect()}
    assert sum(i in kept for i in range(0, 400, 4)) < 40 and sum(i in kept for i in range(400) if i % 4) > 290


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.rates(none, labels, {"plain": 1}).count() == 0 and mixing.mix(none, labels, {"plain": 1}).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r["posterior"] for r in mixing.rates(one, labels, {"plain": 1}).collect()] == [[1 / 3] * 3]
    for weights in ({}, {"plain": -1, "poor": 2}, {"other": 1}):
        with pytest.raises(ValueError):
            mixing.rates(one, labels, weights)
