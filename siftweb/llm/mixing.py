"""Mixing to target weights with soft membership: domain posteriors, then nonnegative document rates by projected gradient.

Features, classifier and every gradient step are columns, aggregates and Spark's own regression; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import free_names, keep, text_of

#: domains of the labelled table, in the order of the posteriors
DOMAINS = ("plain", "toxic", "poor")
#: labelled rows that the classifier uses at most, hashed words, weight of its penalty
LABELLED, WORDS, PENALTY = 20_000, 1 << 15, 1e-4
#: pull of every rate towards 1, largest miss of a domain's total as a share of all tokens, change of the totals at which the loop stalls
PULL, MISS, STALL = 1e-4, 1e-5, 5e-6


def domain_of(quality: Column, toxic: Column) -> Column:
    """Index in DOMAINS of a labelled row, else null."""
    return F.when(toxic == 1, 1.0).when(quality == 0, 2.0).when(quality == 1, 0.0)


def _words(text: Column) -> Column:
    """Runs of letters and runs of other marks, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))


def _features(docs: DataFrame) -> DataFrame:
    worded = docs.withColumn("_words", _words(text_of())).withColumn("tokens", F.size("_words").cast("long"))
    return HashingTF(inputCol="_words", outputCol="_vector", numFeatures=WORDS, binary=True).transform(worded).drop("_words")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> LogisticRegressionModel | None:
    """Multinomial regression on the words of at most ``most`` labelled documents (the lowest by a hash of doc_id).

    ``labels``: doc_id, quality, toxic; rows that name no domain are left out, of several rows of one document the
    greatest domain counts. None without labelled documents.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter(
        "doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    sample = F.broadcast(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = keep(_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")).select("_vector", "domain"), "domains")
    if rows.isEmpty():
        return None
    return LogisticRegression(featuresCol="_vector", labelCol="domain", family="multinomial", regParam=PENALTY, maxIter=60, standardization=False,
                              probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class").fit(rows)


def posteriors(docs: DataFrame, model: LogisticRegressionModel | None) -> DataFrame:
    """doc_id, tokens (words of the whole text) and the posterior of every domain, one array; a written table."""
    rows = _features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if model is None:
        found = F.array(*[F.lit(1.0 / len(DOMAINS))] * len(DOMAINS))
    else:
        rows = model.transform(rows)
        found = F.concat(vector_to_array("_probability"), F.array_repeat(F.lit(0.0), len(DOMAINS) - model.numClasses))
    return keep(rows.select("doc_id", "tokens", found.alias("posterior")), "posteriors")


def _totals(rows: DataFrame, rate: Column) -> np.ndarray:
    got = rows.agg(*[F.sum(F.col("tokens") * rate * F.col("posterior")[k]) for k in range(len(DOMAINS))]).first()
    return np.array([v or 0.0 for v in got])


def fit_rates(rows: DataFrame, weights: Mapping[str, float], hold: str | None = None, most: float | None = None) -> tuple[DataFrame, dict]:
    """Add ``rate`` to rows of (tokens, posterior) so that the expected domain totals meet the targets; also return figures.

    Minimises (S - T)' G^-1 (S - T) + PULL * sum(tokens * (rate - 1)^2) over rates >= 0 (and <= ``most``), where
    S are the expected token totals sum(tokens * rate * posterior), T the targets and G = sum(tokens * posterior * posterior').
    In the metric of the tokens the first term's curvature is 0 or 1, so a step of 1 / (1 + PULL) is the best
    one and few are needed; momentum helps where the targets can't be met. Steps go on until the targets are met or the totals stall, which leaves them within about 1e-4 of all tokens of
    their limit (the rates of single documents, of which many do, vary longer). A step is one aggregate over the
    narrow table, which is written again every few steps; the driver holds the totals.
    ``weights``: share of every domain (missing ones 0). Their sum is scaled to 1. All tokens are wanted, or with ``hold`` so many
    that this domain keeps its total.
    """
    k = len(DOMAINS)
    share = np.array([float(weights.get(d, 0.0)) for d in DOMAINS])
    if share.sum() <= 0 or (share < 0).any() or not set(weights) <= set(DOMAINS):
        raise ValueError(f"weights must be nonnegative shares of {DOMAINS}")
    share = share / share.sum()
    p, t = F.col("posterior"), F.col("tokens")
    sums = rows.agg(F.sum(t), *[F.sum(t * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    everything = float(sums[0] or 0)
    if not everything:
        return rows.withColumn("rate", F.lit(1.0)), {"targets": dict.fromkeys(DOMAINS, 0.0), "totals": dict.fromkeys(DOMAINS, 0.0), "steps": 0}
    gram = np.array(sums[1:], float).reshape(k, k)
    inverse = np.linalg.pinv(gram + 1e-9 * everything * np.eye(k))
    step, totals = 1 / (1 + PULL), _totals(rows, F.lit(1.0))
    wanted = everything
    if hold is not None and share[DOMAINS.index(hold)] > 0:
        wanted = totals[DOMAINS.index(hold)] / share[DOMAINS.index(hold)]
    targets, done, ahead, still = share * wanted, 0, 1.0, 0
    rows = rows.withColumn("rate", F.lit(1.0)).withColumn("_last", F.lit(1.0))
    last = totals
    while np.abs(totals - targets).max() > MISS * everything and still < 2:
        # a step from a point ahead of the last two rates; its totals follow from theirs
        following = (1 + math.sqrt(1 + 4 * ahead * ahead)) / 2
        beta, ahead = (ahead - 1) / following, following
        pull = inverse @ (totals + beta * (totals - last) - targets)
        point = F.col("rate") * F.lit(1 + beta) - F.col("_last") * F.lit(beta)
        slope = sum((F.lit(float(step * pull[i])) * p[i] for i in range(1, k)), F.lit(float(step * pull[0])) * p[0])
        moved = F.greatest(point * F.lit(1 - step * PULL) + F.lit(step * PULL) - slope, F.lit(0.0))
        moved = moved if most is None else F.least(moved, F.lit(float(most)))
        rows = rows.withColumn("_next", moved).withColumns({"_last": F.col("rate"), "rate": F.col("_next")}).drop("_next")
        done += 1
        if done % 8 == 0:
            rows = keep(rows, "rates")  # a bounded plan
        last, totals = totals, _totals(rows, F.col("rate"))
        still = still + 1 if np.abs(totals - last).max() <= STALL * everything else 0  # twice, since momentum may turn round
    return rows.drop("_last"), {"targets": dict(zip(DOMAINS, targets)), "totals": dict(zip(DOMAINS, totals)), "steps": done}


def copies_of(rate: Column, doc_id: Column, seed: int = 7) -> Column:
    """Whole copies, and one more where a hash of doc_id falls below the remaining fraction: the same in every run."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


#: shares of the registered query
WEIGHTS = {"plain": 0.9, "toxic": 0.02, "poor": 0.08}


def plan(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], hold: str | None = None, most: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rates, report): doc_id, tokens, posterior, rate and copies of every row; per domain its target and total of expected tokens,
    whether the total meets the target, and the steps taken.

    Targets that no rates within the bounds can meet are missed by the least amount, in the metric of ``fit_rates``; the report says so.
    A text without words (null, empty) has no tokens: it doesn't count for the totals and gets the rate of its posterior.
    Repeated rows count each; a null doc_id is handled like a value; without labels all posteriors are equal; an empty
    table gives an empty result; other columns are ignored.
    """
    fitted, figures = fit_rates(posteriors(docs, learn(docs, labels)), weights, hold, most)
    everything = sum(figures["targets"].values())
    rows = [(d, float(figures["targets"][d]), float(figures["totals"][d]), bool(abs(figures["targets"][d] - figures["totals"][d]) <= 1e-3 * everything), figures["steps"])
            for d in DOMAINS]
    report = docs.sparkSession.createDataFrame(rows, "domain string, target double, total double, met boolean, steps int")
    return fitted.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"))), report


def rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], hold: str | None = None, most: float | None = None) -> DataFrame:
    """The rates of ``plan``."""
    return plan(docs, labels, weights, hold, most)[0]


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], hold: str | None = None, most: float | None = None) -> DataFrame:
    """``docs`` with every row as often as its copies say, with its columns.

    The copies are decided on the narrow table (``plan``) and joined to the rows by doc_id; rows that repeat a doc_id share the greatest number.
    Columns of any names may be there.
    """
    ident, copies, one = free_names(docs, "_id", "_copies", "_one")
    chosen = rates(docs, labels, weights, hold, most).groupBy(F.col("doc_id").alias(ident)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    rows = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)))
    return rows.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    found = rates(read(spark, folder, "documents"), read(spark, folder, "labels"), WEIGHTS)
    shown = [F.round(F.col("posterior")[k], 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return found.select("doc_id", "tokens", *shown, F.round("rate", 6).alias("rate"), "copies")
