"""Importance resampling towards a target distribution: array-scored weights, then exact selection by weighted medians of medians."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import free_names, keep, ranked, text_of

#: hashed features, longest run of words, seed of the draw, words that a document needs, percent drawn
BUCKETS, LONGEST, SEED, LEAST, PERCENT = 10_000, 1, 2024, 20, 10
#: characters of texts handled together; features up to this many bytes are hashed side by side; keys whose median is taken at once
TOGETHER, SHORT, BLOCK = 1 << 20, 64, 1 << 16

_IN_WORD = np.array([chr(b).isdigit() or "a" <= chr(b) <= "z" or b >= 0x80 for b in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_all(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of many slices of ``data``, byte by byte for all of them at once; long slices one after the other."""
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    first, size = starts[order], lengths[order]
    long = int((size > SHORT).sum())
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    short = size[long:]
    for j in range(int(short[0]) if len(short) else 0):
        some = slice(long, long + int((short > j).sum()))
        crc[some] = _CRC[(crc[some] ^ data[first[some] + j]) & 0xFF] ^ (crc[some] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[first[i]:first[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: list[str], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and bucket of every run of 1 to ``longest`` consecutive words, and the words of every text.

    Only A-Z is lower-cased; a word is a run of digits, a-z and characters beyond ASCII; words of a run are joined by one space.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]).lower(), np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
    inside = _IN_WORD[data]
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(ends_of_texts, starts, side="right")
    if longest > 1:  # words with one space between them
        data, inside = data.copy(), inside.copy()
        data[ends], inside[ends] = 0x20, True
        place = np.cumsum(inside) - 1
        data, starts, ends = data[inside], place[starts], place[ends]
    owners, codes = [], []
    for n in range(1, longest + 1):
        count = max(len(starts) - n + 1, 0)
        whole = owner[:count] == owner[n - 1:n - 1 + count]
        first, last = starts[:count][whole], ends[n - 1:n - 1 + count][whole]
        owners.append(owner[:count][whole])
        codes.append(crc32_all(data, first, last - first) % np.uint32(buckets))
    return np.concatenate(owners), np.concatenate(codes).astype(np.int64), np.bincount(owner, minlength=len(texts))


def _groups(texts: list[str]):
    """Consecutive texts with about TOGETHER characters in all; a longer text is a group of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts per bucket: one array per task, summed up by bucket; the driver sees ``buckets`` numbers."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in _groups(batch.column(0).to_pylist()):
                counts += np.bincount(features(group, buckets, longest)[1], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])

    rows = docs.select(text_of().alias("_text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in rows.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the smoothed log ratio of target and source, per bucket."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def draw_of(seed: int, doc_id: int | None) -> int:
    """Floored thousandths of a Gumbel variate that depends on seed and doc_id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, hash of the text, n_features, n_words, weight, score and a number of its own (``row``) for every row; a written table."""

    def run(batches):
        for batch in batches:
            parts = [np.zeros((3, 0), np.int64)]
            for group in _groups(batch.column("_text").to_pylist()):
                owner, code, words = features(group, len(gain), longest)
                parts.append(np.stack([np.bincount(owner, minlength=len(group)), words, np.bincount(owner, gain[code], len(group)).astype(np.int64)]))
            n, words, total = np.concatenate(parts, axis=1)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.array([draw_of(seed, i) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, pa.int64()) for c in (n, words, weight, score))],
                                             ["doc_id", "text_hash", "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("_text"))
    found = rows.mapInArrow(run, "doc_id long, text_hash long, n_features long, n_words long, weight long, score long")
    return keep(found.withColumn("row", F.monotonically_increasing_id()), "scored")


#: keys in ascending order: greater scores first, then smaller doc_id, none last, then rows of a repeated doc_id
_KEY = ("lead", "none", "id", "row")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select((-F.col("score")).alias("lead"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")


def _compare(key: tuple[int, ...]) -> tuple[Column, Column]:
    """Whether a row's key is less than, and greater than, ``key``."""
    less = more = F.lit(False)
    for name, value in reversed(list(zip(_KEY, key))):
        same = F.col(name) == value
        less, more = (F.col(name) < value) | (same & less), (F.col(name) > value) | (same & more)
    return less, more


def weighted_median(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """The key (a row of ``keys``) at which half of all ``sizes`` is reached, and their sum."""
    order = np.lexsort(keys.T[::-1])
    reached = np.cumsum(sizes[order])
    return keys[order[np.searchsorted(reached, (reached[-1] + 1) // 2)]], int(reached[-1])


def _medians(pivot: tuple[int, ...]):
    """Per task and side of the pivot: the rows there and the weighted median of the medians of its blocks."""

    def run(batches):
        medians, sizes, equal = {-1: [], 1: []}, {-1: [], 1: []}, 0

        def close(block):
            nonlocal equal
            keys = np.concatenate(block)
            side = np.zeros(len(keys), np.int64)
            for i in range(len(_KEY)):
                side = np.where(side == 0, np.sign(keys[:, i] - pivot[i]), side)
            equal += int((side == 0).sum())
            for s in (-1, 1):
                some = keys[side == s]
                if len(some):
                    median, n = weighted_median(some, np.ones(len(some), np.int64))
                    medians[s].append(median)
                    sizes[s].append(n)

        block, held = [], 0
        for batch in batches:
            block.append(np.stack([batch.column(c).to_numpy() for c in _KEY], axis=1))
            held += batch.num_rows
            if held >= BLOCK:
                close(block)
                block, held = [], 0
        if held:
            close(block)
        out = [(0, equal, 0, 0, 0, 0)] if equal else []
        for s in (-1, 1):
            if sizes[s]:
                median, n = weighted_median(np.array(medians[s]), np.array(sizes[s]))
                out.append((s, n, *map(int, median)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], ["side", "n", *_KEY])

    return run


def cutoff(rows: DataFrame, k: int) -> tuple[int, ...] | None:
    """The k-th least key among ``rows`` (_KEY); None if there are fewer.

    Every round a pass over the remaining keys counts them on both sides of a pivot and takes, per task, the median on either
    side; of the side that holds the k-th key, the tasks' medians weighted by their sizes give the next pivot. Half of the
    tasks' weight lies on either side of it, with half of their rows (a quarter with several blocks), so a fixed fraction
    goes in every round. What remains is written again when it has shrunk to a quarter, so all passes together read
    a small multiple of the table. The driver sees a row per task and side.
    """
    wanted, remaining, written = k, rows, None
    pivot: tuple[int, ...] = (0,) * len(_KEY)  # not a key in general: the first pass only takes medians
    while True:
        found = remaining.mapInArrow(_medians(pivot), "side long, n long, " + ", ".join(f"{c} long" for c in _KEY)).collect()
        n = {s: sum(r["n"] for r in found if r["side"] == s) for s in (-1, 0, 1)}
        written = written or sum(n.values())
        if k < 1 or wanted > sum(n.values()):
            return None
        if n[-1] < wanted <= n[-1] + n[0]:
            return pivot
        side = -1 if wanted <= n[-1] else 1
        less, more = _compare(pivot)
        remaining = remaining.filter(less if side < 0 else more)
        wanted -= 0 if side < 0 else n[-1] + n[0]
        here = [r for r in found if r["side"] == side]
        median, left = weighted_median(np.array([[r[c] for c in _KEY] for r in here], np.int64), np.array([r["n"] for r in here]))
        pivot = tuple(map(int, median))
        if 4 * left <= written:
            remaining, written = keep(remaining, "remaining"), left


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
             least: int = LEAST, with_hash: bool = False) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; the ``percent`` of the rows with ``least`` words that score highest are drawn.

    A row's weight is the floored mean of its features' gains, its score adds a Gumbel variate of seed and doc_id, so the drawn rows
    are a sample without replacement by importance. The cut-off key is found exactly; only drawn rows are sorted and numbered.
    A null or empty text has no features and weight 0 and is never drawn; repeated rows take part each, in the order in which they
    are read; a null doc_id counts as an empty one and comes last among equal scores; an empty table gives an empty result and an empty target
    makes all gains alike for equally frequent features; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = scored(docs, gain, longest, seed)
    fit = F.col("n_words") >= least
    drawn = percent * rows.filter(fit).count() // 100
    shown = ["doc_id", *(["text_hash"] if with_hash else []), "n_features", "weight", "score"]
    last = cutoff(_keyed(rows.filter(fit)), drawn)
    if last is None:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    keyed = rows.withColumns({"lead": -F.col("score"), "none": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    out = ~fit | _compare(last)[1]
    winners = ranked(keyed.filter(~out).select(*shown, *_KEY), [F.col(c) for c in _KEY], "rank", "winners")
    return winners.select(*shown, "rank").unionByName(keyed.filter(out).select(*shown, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` themselves, with their columns, in no order.

    Rows that repeat both doc_id and text are told apart by nothing: all of them come if one is drawn.
    """
    names = free_names(docs, "_id", "_none", "_hash")
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").cast("long").isNull(), F.xxhash64(text_of())]
    drawn = resample(docs, target, **settings, with_hash=True).filter("rank IS NOT NULL")
    stay = drawn.select(F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), F.col("text_hash").alias(names[2])).distinct()
    return docs.withColumns(dict(zip(names, keys))).join(stay, names, "left_semi").select(*docs.columns)


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
