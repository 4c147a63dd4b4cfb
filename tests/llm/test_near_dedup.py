"""Near duplicates against all pairs."""

import random
import re

import numpy as np

from siftweb.llm import near_dedup as near


def sets_of(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out[doc_id] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    return out


def plain(rows):
    sets = sets_of(rows)
    low = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(low[a], low[b])
            changed |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return {d: (len(sets[d]), low[d], low[d] == d) for d in sets}


def made_rows(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, base = [], [word() for _ in range(150)]
    for i in range(70):  # copies of one text, some of them far from it and from each other
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    step = [word() for _ in range(120)]
    for i in range(70, 82):  # a chain: neighbours are linked, ends aren't
        step = step[3:] + [word() for _ in range(3)]
        rows.append((i, " ".join(step)))
    for i in range(82, 90):  # parts of the first text
        rows.append((i, " ".join(base[:rng.randint(100, 149)])))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE  two"), (205, "one two three four five"), (206, "x " * 50_000), (207, "X\t" * 50_000)]
    rows += [(300 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    return rows


def test_classes(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows] + [(3, rows[3][1], 0)], "doc_id long, text string, component_id int")
    got = near.classes(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == plain(rows)
    kept = near.drop_near(docs.dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in plain(rows).items() if v[2])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(none).count() == 0
    assert [tuple(r) for r in near.classes(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()] == [(None, 2, None, True)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(30)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r["u"]: r["v"] for r in near.components(frame).collect()} == {x: y for x, y in low.items() if x != y}


def test_super_minhash_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    for n, shared in ((400, 300), (40, 20), (8, 6)):
        share = []
        for _ in range(150):
            x = rng.integers(0, 1 << 62, 2 * n - shared).astype(np.uint64)
            share.append((near.super_minhash(x[:n]) == near.super_minhash(x[n - shared:])).mean())
        truth, free = shared / (2 * n - shared), np.sqrt(shared / (2 * n - shared) * (1 - shared / (2 * n - shared)) / near.RANKS)
        assert abs(np.mean(share) - truth) < 0.02
        assert np.std(share) < 1.15 * free


def test_early_stop_changes_nothing():
    x = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x1234567)
    whole = near.super_minhash(x)
    again = np.minimum(near.super_minhash(x[:30]), near.super_minhash(x[30:]))
    assert (whole == again).all()


def test_repeated_ids_with_other_texts_and_clashing_columns(spark):
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join(reversed(base))
    docs = spark.createDataFrame([(1, one, 0, 0), (1, two, 0, 0), (2, one + " x", 0, 0), (3, two + " y", 0, 0), (4, "other words entirely here now", 0, 0), (4, one, 0, 0)],
                                 "doc_id long, text string, node int, _kept int")
    from siftweb.llm.near_dedup import classes, drop_near

    got = sorted((r["doc_id"], r["component_id"]) for r in classes(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 4)]
    kept = drop_near(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 4, 4]
