"""Features, weights and the selection against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from siftweb.llm import importance
from siftweb.llm.importance import _KEY, bucket_counts, crc32_all, cutoff, features, resample, resampled


def plain_features(text, longest, buckets):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i:i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, buckets, longest, least):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in plain_features(text or "", longest, buckets)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, own = plain_features(text or "", longest, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[:percent * len(order) // 100]
    return [(*r[:4], drawn.index(r) + 1 if r in drawn else None) for r in rows]


WORDS = ["Haus", "été", "x", "a1", "the", "THE", "of", "中文", "k" * 90, "longer", "words", "77"]


def some_docs(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([" ", ", ", "\n-"]).join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 25, 60])))) for i in range(n)]


def test_crc_of_slices():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(5000))
    slices = [(s, rng.choice([0, 1, 3, 63, 64, 65, 300])) for s in (rng.randrange(4000) for _ in range(300))]
    got = crc32_all(np.frombuffer(data, np.uint8), np.array([s for s, _ in slices]), np.array([n for _, n in slices]))
    assert got.tolist() == [zlib.crc32(data[s:s + n]) for s, n in slices]


@pytest.mark.parametrize("longest", [1, 3])
def test_features(longest):
    texts = [t for _, t in some_docs(60, 4)] + ["", "..."]
    owner, code, words = features(texts, 997, longest)
    for i, text in enumerate(texts):
        n, own = plain_features(text, longest, 997)
        assert words[i] == n and sorted(code[owner == i].tolist()) == sorted(own)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 16)
    docs = [*some_docs(400, 1), (None, "the of x " * 10), (7_000_000_000, None), (-3, "")]
    target = ["the of of été", None, "haus THE"]
    for longest, percent in ((1, 10), (2, 55), (1, 100)):
        frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, Score int, lead int").repartition(7)
        got = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=50, longest=longest)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(docs, target, percent, 50, longest, 20), key=str)


def test_repeated_rows_are_drawn_in_number(spark):
    docs = spark.createDataFrame([(5, "the of x " * 10)] * 50 + [(6, "été " * 30)] * 50, "doc_id long, text string")
    rows = resample(docs, docs.limit(0), percent=30).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 31)) and len(rows) == 100
    assert len({r["doc_id"] for r in rows if r["rank"]}) == 1


def test_selection(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 8)
    rng = random.Random(9)
    keys = [(rng.randrange(-5, 5), rng.randrange(2), rng.randrange(20), i) for i in range(600)]
    rows = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in _KEY)).repartition(5)
    for k in (1, 2, 300, 599, 600):
        assert cutoff(rows, k) == sorted(keys)[k - 1]
    assert cutoff(rows, 0) is None and cutoff(rows, 601) is None and cutoff(rows.limit(0), 1) is None


def test_drawn_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, i, "a", "b", 1) for i, t in some_docs(100, 3)], "doc_id long, text string, `_ID` long, _hash string, _none string, rank int")
    target = spark.createDataFrame([("the x",)], "text string")
    drawn = {r["doc_id"] for r in resample(docs, target).collect() if r["rank"]}
    got = resampled(docs, target)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == drawn and drawn
    assert resample(docs.limit(0), target).count() == 0 and resampled(docs.limit(0), target).count() == 0


def test_counts_cover_all_texts(spark):
    docs = some_docs(50, 8)
    want = [0] * 31
    for _, t in docs:
        for b in plain_features(t, 2, 31)[1]:
            want[b] += 1
    assert bucket_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 31, 2).tolist() == want
