"""Winnowing: rolling k-gram hashes, the minimum of every window, positions kept."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import text_of

#: code points in a gram and grams in a window: two texts that share GRAM + WINDOW - 1 code points share a fingerprint
GRAM, WINDOW = 16, 24

_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit polynomial hashes of all grams; a text shorter than a gram is one gram.

    The polynomial of every gram follows from that of its halves, which takes log2(gram) passes.
    """
    if len(codes) == 0:
        return np.empty(0, np.uint64)
    gram = min(gram, len(codes))
    with np.errstate(over="ignore"):
        block, power, size = (codes.astype(np.uint64) + np.uint64(1)) * _BASE, _BASE, 1
        out, done = None, 0
        while True:
            if gram & size:
                n = len(codes) - done - size + 1
                out = block[:n] if out is None else out[:n] * power + block[done:done + n]
                done += size
            if 2 * size > gram:
                break
            block, power, size = block[:-size] * power + block[size:], power * power, 2 * size
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the window minima, of equal ones the rightmost, each position once and in order."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    window = min(window, n)
    best, size = np.arange(n), 1
    while size < window:  # best[i]: rightmost minimum of hashes[i:i + size]
        step = min(size, window - size)
        left, right = best[:-step], best[step:]
        best, size = np.where(hashes[right] <= hashes[left], right, left), size + step
    return best[np.concatenate([[True], best[1:] != best[:-1]])]


def pack(marks: np.ndarray, places: np.ndarray) -> str:
    """Base64 of the 32-bit hashes followed by the 32-bit positions, little-endian."""
    return base64.b64encode(marks.astype("<u4").tobytes() + places.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    return values[:len(values) // 2], values[len(values) // 2:]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _select(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = gram_hashes(codes)
    places = winnow(hashes)
    return (hashes[places] >> np.uint64(32)).astype(np.uint32), places


def fingerprint(text: str) -> str:
    return pack(*_select(_codes(text)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of hashes: twice the intersection over the sum of sizes; 1 for two empty sets."""
    a, b = np.unique(a), np.unique(b)
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def _one(batches):
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row's whole text, in place and without a shuffle.

    A null text counts as empty; an empty text has the empty fingerprint; equal texts have equal fingerprints;
    repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(_one, "doc_id long, fingerprint string")


# --- every document against an edited version of itself and against its successor ---

_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edit(text: str, following: str) -> str:
    """The last half (rounded down) replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(doc_id, text: str, following: str, own, ahead) -> dict:
    changed = edit(text, following)
    marks, places = _select(_codes(changed))
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": pack(*own),
            "edited_fingerprint": pack(marks, places), "near_edited": likeness(own[0], marks), "near_next": likeness(own[0], ahead[0])}


def _stream(batches):
    """Rows of whole ranges in order; each row that isn't a guest is compared with the one behind it. One row is held at a time."""
    before = None
    for batch in batches:
        rows = []
        for doc_id, text, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_text", "_range", "_guest"))):
            own = _select(_codes(text))
            if before is not None and before[3] == part and not before[4]:
                rows.append(_compare(before[0], before[1], text, before[2], own))
            before = (doc_id, text, own, part, guest)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _ranges(bounds: np.ndarray, firsts: np.ndarray):
    """UDF: the ranges a doc_id goes to: its own and, if it is the first of its range, the one before as a guest."""
    taken = np.flatnonzero(firsts != _NONE)
    previous = {int(firsts[r]): int(taken[i - 1]) for i, r in enumerate(taken)}  # the first of all follows the last range

    @F.pandas_udf("array<int>")
    def run(ids):
        import pandas as pd

        own = np.searchsorted(bounds, ids.to_numpy(), side="right")
        return pd.Series([[int(r), previous[i]] if i in previous else [int(r)] for r, i in zip(own, ids.tolist())])

    return run


_NONE = np.iinfo(np.int64).max


def against_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document by doc_id.

    Quantiles of doc_id (a pass over that column alone) cut the ids into ``ranges``, by default as many as Spark has
    shuffle partitions. Rows move once, to the task of their range; the first row of a range is also sent to
    the range before it, as a guest that closes it. In its task every row meets its successor while the rows stream by.
    After the last row comes the first. A null text counts as empty; repeated doc_ids follow each other in the
    order of their texts' hashes; a null doc_id comes first; an only row is its own successor; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("_id"))
    bounds = np.unique(np.array(ids.approxQuantile("_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], float)).astype(np.int64)
    firsts = np.full(len(bounds) + 1, _NONE, np.int64)
    own = F.pandas_udf(lambda s: s.map(lambda i: int(np.searchsorted(bounds, i, side="right"))), "int")
    for row in ids.groupBy(own("_id").alias("r")).agg(F.min("_id").alias("first")).collect():  # one row per range
        firsts[row["r"]] = row["first"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("_id"))
    sent = rows.withColumn("_to", _ranges(bounds, firsts)("_id")).select(
        "doc_id", "_text", "_id", F.posexplode("_to").alias("_pos", "_range")).withColumn("_guest", F.col("_pos") > 0)
    return (sent.repartitionById(n, F.col("_range"))
            .sortWithinPartitions("_range", "_guest", "_id", F.xxhash64("_text"))
            .select("doc_id", "_text", "_range", "_guest").mapInArrow(_stream, _RESULT))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return against_next(read(spark, folder, "documents"))
