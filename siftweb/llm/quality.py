"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import keep, text_of

#: random features, kernel width in standard deviations of a statistic, ridge weight per labelled row
FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1e-4, 20240
#: calibration works on raw scores rounded to 1/STEPS between -1 and 2
STEPS = 500
#: labelled rows that a fit uses at most
LABELLED = 20_000
#: scores from here on are predicted as good
THRESHOLD = 0.3

STATISTICS = ["log_words", "log_lines", "word_length", "distinct_words", "top_word", "repeated_pairs", "upper", "digits", "blank",
              "marks", "symbols", "symbol_words", "bare_marks", "long_words", "line_length", "repeated_lines", "entropy", "short_words",
              "doubled_marks", "capital_words"]

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
_MARK = re.compile(r"[.,;:'\"()?-]")
_DOUBLED = re.compile(r"([^\w\s])\1")


def statistics(text: str) -> list[float]:
    """The figures named in STATISTICS, from the whole text; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    kinds = Counter(text)
    upper = sum(c for k, c in kinds.items() if k.isupper())
    letters = sum(c for k, c in kinds.items() if k.isalpha())
    digits = sum(c for k, c in kinds.items() if k.isdigit())
    blank = sum(c for k, c in kinds.items() if k.isspace())
    marks = sum(c for k, c in kinds.items() if _MARK.match(k))
    symbols = sum(c for k, c in kinds.items() if _SYMBOL.match(k))
    symbol_words = bare = long = short = capitals = 0
    for word, c in counts.items():
        size = len(word)
        long += c * (size > 20)
        short += c * (size <= 3)
        capitals += c * word[0].isupper()
        if symbols and not word.isalpha():
            symbol_words += c * (_SYMBOL.search(word) is not None)
            bare += c * (not any(k.isalnum() for k in word))
    return [math.log1p(n), math.log1p(len(lines)), (chars - blank) / n, len(counts) / n, max(counts.values()) / n,
            1 - len(pairs) / max(1, n - 1), upper / max(1, letters), digits / chars, blank / chars, marks / n, symbols / n,
            symbol_words / n, bare / n, long / n, math.log1p(chars / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            -sum(c / chars * math.log(c / chars) for c in kinds.values()), short / n,
            len(_DOUBLED.findall(text)) / n if marks + symbols else 0.0, capitals / n]


def _measure(batches):
    for batch in batches:
        values = pa.array([statistics(t) for t in batch.column("_text").to_pylist()], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "stats"])


def measure(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(_measure, "doc_id long, stats array<float>")


def _fold(batch) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 5 if i is not None else -1 for i in batch.column("doc_id").to_pylist()])


def _matrix(batch) -> np.ndarray:
    values = batch.column("stats").flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(batch.num_rows, len(STATISTICS))


@dataclass(frozen=True)
class Model:
    """What a scorer needs: a few thousand numbers, whatever the size of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(np.interp(raw, self.levels, self.values), 0.0, 1.0)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random cosines whose inner products approximate a Gaussian kernel, the statistics themselves and a constant."""
    random = np.random.default_rng(SEED)
    directions = random.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip(x, -8, 8)
    return np.hstack([math.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), x / 8, np.ones((len(x), 1))])


def _sums(mean: np.ndarray, scale: np.ndarray):
    """Per partition: the upper half of the normal matrix, the right side and the row count, one array."""
    size = FEATURES + len(STATISTICS) + 1
    upper = np.triu_indices(size)

    def run(batches):
        matrix, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z = fourier((_matrix(batch) - mean) / scale)
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            matrix, right, n = matrix + z.T @ z, right + z.T @ y, n + len(y)
        if n:
            flat = np.concatenate([matrix[upper], right, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Statistics, label and fold of at most ``most`` labelled rows outside fold 0 (crc32 of doc_id, mod 5).

    ``labels``: doc_id, quality (0/1; other rows are left out; of several labels of one document the lowest counts).
    The sample takes the rows lowest by a hash of doc_id, and its bound makes it safe to broadcast.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int")
    sample = wanted.withColumn("fold", fold).filter("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    return keep(measure(chosen).join(F.broadcast(sample), "doc_id"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Ridge on folds 1 to 3 of the labelled sample, calibration on fold 4.

    Only sums of fixed size leave the partitions: means, the normal equations, and label counts per score step.
    Without usable labels every score is 0.5.
    """
    rows = labelled(docs, labels, most)
    k, size = len(STATISTICS), FEATURES + len(STATISTICS) + 1
    train = rows.filter("fold <> 4")
    figures = train.agg(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)],
                        *[F.stddev_pop(F.col("stats")[i].cast("double")).alias(f"s{i}") for i in range(k)]).first()
    if figures["m0"] is None:
        return Model(np.zeros(k), np.ones(k), np.zeros(size), np.array([0.0]), np.array([0.5]))
    mean = np.array([figures[f"m{i}"] for i in range(k)])
    scale = np.array([figures[f"s{i}"] for i in range(k)])
    scale = np.where(scale < 1e-6, 1.0, scale)
    sums = train.select("stats", "quality").mapInArrow(_sums(mean, scale), "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([r["v"] for r in sums.orderBy("i").collect()])  # size * (size + 3) / 2 + 1 numbers
    matrix, half = np.zeros((size, size)), size * (size + 1) // 2
    matrix[np.triu_indices(size)] = flat[:half]
    matrix = matrix + np.triu(matrix, 1).T
    weights = np.linalg.solve(matrix + RIDGE * flat[-1] * np.eye(size), flat[half:-1])
    plain = Model(mean, scale, weights, np.array([-1.0, 2.0]), np.array([-1.0, 2.0]))

    def steps(batches):
        for batch in batches:
            raw = plain.features(_matrix(batch)) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(raw, -1, 2) * STEPS).astype(np.int64)), batch.column("quality")],
                                             ["step", "quality"])

    counted = (rows.filter("fold = 4").select("stats", "quality").mapInArrow(steps, "step long, quality int")
               .groupBy("step").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("step").collect())
    levels, values = isotonic([(r["step"] / STEPS, r["good"], r["n"]) for r in counted])
    return Model(mean, scale, weights, levels, values)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (level, positives, rows) in ascending level; ends of every block, for interpolation.

    Half a row of either label is added to a block, so that small blocks don't claim certainty.
    """
    if not points:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    blocks: list[list[float]] = []
    for level, good, n in points:
        blocks.append([level, level, float(good), float(n)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, good, n = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + good, blocks[-1][3] + n
    levels, values = [], []
    for first, last, good, n in blocks:
        value = (good + 0.5) / (n + 1)
        levels += [first, last + 1e-9]
        values += [value, value]
    return np.array(levels), np.maximum.accumulate(np.array(values))


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_fold(batch) == 0), pa.array(values),
                                              pa.array((values >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD) for every row of ``docs``.

    Only the text enters a score. Null and empty texts have all statistics 0 and are scored like others;
    repeated rows repeat; a null doc_id stays null and isn't held out; an empty table gives an empty result.
    """
    return score(measure(docs), fit(docs, labels, most))


def accepted(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` predicted as good, with its columns."""
    model = fit(docs, labels, most)

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        values = np.array([statistics(t) for t in texts], np.float32).astype(float).reshape(len(texts), len(STATISTICS))
        return pd.Series(model.score(values))

    return docs.filter(rate(text_of()) >= THRESHOLD)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return classify(read(spark, folder, "documents"), read(spark, folder, "labels"))
