"""Collocations against a plain count of all runs of words, and tiles against a plain count of pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftweb.llm import collocations as module
from siftweb.llm.collocations import collocations, tile_counts


def plain(docs, least, longest, inside, top):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    frequent = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    dropped = set()
    for (lang, words), n in frequent.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * n >= inside * f[lang, words[i:i + size]]:
                    dropped.add((lang, words[i:i + size]))
    found = defaultdict(list)
    for (lang, words), a in frequent.items():
        if (lang, words) not in dropped:
            cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return [(lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
            for lang, rows in found.items() for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top])]


def some_docs(n, seed):
    rng = random.Random(seed)
    words, fixed = ["Ab", "c", "été", "ÉTÉ", "d\x1fe", "中", "f-g", " ", "h"], ["new york city hall", "at the end", "x x x x"]
    out = [(None, None), ("en", ""), ("en", "..."), (None, "ab c")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        out.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]) for p in parts)))
    return out


@pytest.mark.parametrize("block,inside", [(1 << 20, 100), (17, 100), (60, 70)])
def test_against_a_plain_count(spark, monkeypatch, block, inside):
    for name, value in (("BLOCK", block), ("SIDE", 4), ("SQUARE", 3), ("DENSE", 5)):
        monkeypatch.setattr(module, name, value)
    docs = some_docs(250, block)
    frame = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n int, Word string").repartition(3)
    for least, longest, top in ((5, 5, 2000), (9, 3, 7)):
        got = collocations(frame, least, longest, inside, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(plain(docs, least, longest, inside, top))


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(docs).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None)], docs.schema)).count() == 0


def test_tiles():
    rng = np.random.default_rng(1)
    for n, most in ((0, 5), (200_000, 700), (50_000, 10_000), (1000, 10**10)):
        left, right = (rng.integers(0, most, n) * rng.integers(0, 2, n) for _ in range(2))
        a, b, counts, own = tile_counts(left, right)
        want = Counter(zip(left.tolist(), right.tolist()))
        assert dict(zip(zip(a.tolist(), b.tolist()), counts.tolist())) == want and len(a) == len(want)
        assert (a[own] == left).all() and (b[own] == right).all()


def test_products_beyond_64_bits():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [10**12], "n": [10**13], "l": [2 * 10**12], "r": [3 * 10**12]})
    assert next(module._scores([batch])).column("score").to_pylist() == [1000 * 10**25 // (6 * 10**24)]
