"""Winnowing against its definition."""

import hashlib
import random

import numpy as np
import pytest

from siftweb.llm import fingerprints as win


def test_hashes_and_minima():
    rng = random.Random(2)
    for _ in range(150):
        codes = np.array(rng.choices(range(97, 100), k=rng.randint(1, 80)), np.uint32)
        for gram in (1, 3, 5, 16):
            got = win.gram_hashes(codes, gram).tolist()
            g, m, base = min(gram, len(codes)), 1 << 64, 0x9E3779B97F4A7C15
            for i, h in enumerate(got):
                x = 0
                for c in codes[i:i + g].tolist():
                    x = (x * base + (c + 1) * base) % m
                x ^= x >> 29
                x = x * 0xBF58476D1CE4E5B9 % m
                assert h == x ^ (x >> 32)
            assert len(got) == len(codes) - g + 1
        hashes = win.gram_hashes(codes, 1) % np.uint64(5)
        for window in (1, 4, 24):
            w, want = min(window, len(hashes)), []
            for i in range(len(hashes) - w + 1):
                part = hashes[i:i + w].tolist()
                at = i + max(k for k in range(w) if part[k] == min(part))
                want += [at] if not want or want[-1] != at else []
            assert win.winnow(hashes, window).tolist() == want


def test_match_guarantee():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for _ in range(200):
        shared = text(win.GRAM + win.WINDOW - 1)
        a, b = (win.unpack(win.fingerprint(text(rng.randint(0, 90)) + shared + text(rng.randint(0, 90))))[0] for _ in range(2))
        assert set(a) & set(b)


def plain(rows):
    ordered = sorted(rows, key=lambda r: r[0])
    out = {}
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, ahead = (win.unpack(win.fingerprint(t))[0] for t in (text, edited, after))
        like = lambda a, b: 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if len(a) + len(b) else 1.0
        out[doc_id] = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), win.fingerprint(text), win.fingerprint(edited), like(own, changed), like(own, ahead))
    return out


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_against_next(spark, ranges):
    rng = random.Random(5)
    rows = [(i * 7 - 100, "".join(rng.choices("abc dé\n", k=rng.choice([0, 1, 2, 15, 40, 400, 3000])))) for i in range(60)] + [(1000, None), (2000, "same"), (2001, "same")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fingerprint int").repartition(3)
    got = {r["doc_id"]: tuple(r) for r in win.against_next(docs, ranges).collect()}
    assert got == plain(rows)
    own = {r["doc_id"]: r["fingerprint"] for r in win.fingerprints(docs).collect()}
    assert own == {d: v[3] for d, v in got.items()} and own[2000] == own[2001] and own[1000] == ""


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert win.against_next(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r)[5:] for r in win.against_next(spark.createDataFrame([(4, "alone here")], schema)).collect()][0][1] == 1.0
    twice = win.against_next(spark.createDataFrame([(4, "a" * 50), (4, "a" * 50), (None, "b")], schema)).collect()
    assert sorted(str(r["doc_id"]) for r in twice) == ["4", "4", "None"]
