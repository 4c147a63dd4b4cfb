"""Quality scores: held-out accuracy, the parts of the method, edges."""

import random
import zlib

import numpy as np

from siftweb.llm import quality


def made(n=700, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(30, 200))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            words = [w + "###" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [f"{w} |" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = made()
    extra = [(5000, None), (5001, ""), (5002, "word " * 60_000), (None, "no id at all"), (0, rows[0][1])]
    docs = spark.createDataFrame([(d, t, -1.0) for d, t in rows + extra], "doc_id long, text string, score double").repartition(5)
    table = spark.createDataFrame(labels + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, table).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {d: q for d, q, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    flipped = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels], table.schema)
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()}  # held-out labels aren't learned
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    kept = quality.accepted(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in got if r["predicted"])


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.classify(docs, none).collect()] == [0.5]
    assert quality.classify(docs.limit(0), none).count() == 0


def test_ridge_solves_the_normal_equations_of_all_rows(spark):
    rows, labels = made(300, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    fold = np.array([zlib.crc32(str(d).encode()) % 5 for d, _ in rows])
    train = (fold > 0) & (fold < 4)
    x = np.array([quality.statistics(t) for _, t in rows], np.float32).astype(float)[train]
    y = np.array([q for _, q, _ in labels], float)[train]
    z = model.features(x)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_features_approximate_a_gaussian_kernel():
    x = np.random.default_rng(0).normal(size=(40, len(quality.STATISTICS)))
    z = quality.fourier(x)[:, :quality.FEATURES]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH ** 2))
    assert np.abs(z @ z.T - exact).mean() < 0.08


def test_isotonic_never_falls_and_pools():
    levels, values = quality.isotonic([(0.0, 1, 10), (0.1, 0, 10), (0.2, 9, 10), (0.3, 8, 10), (0.4, 10, 10)])
    assert (np.diff(values) >= 0).all() and (np.diff(levels) > 0).all()
    assert np.interp(0.05, levels, values) == np.interp(0.1, levels, values) == 1.5 / 21
    assert np.interp(0.25, levels, values) == 17.5 / 21
