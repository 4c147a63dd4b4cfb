"""Counts of the compiled machines against the library's own encoding, and their state maps against a plain run."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftweb.llm import token_counts as counts_of
from siftweb.llm.token_counts import Counter, compose, op12_token_counts, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "r", "v", "l", "e", " ", "  ", "\n", "\t", "\r\n", "　", "a", "B", "é", "ß", "1", "²", "١", "!", "?", "-", "<|endoftext|>", "<|", "中",
         "文", "😀", "'S", "_", "word", " the", "ing", "\x85", "\x00", "​", "é"]


def library(texts):
    tokenizer = Tokenizer.from_file(FILE)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def mixed(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]


def test_counts_of_the_library():
    rng = random.Random(1)
    texts = [*mixed(4000), "", "x" * 30_000, "ab" * 5000, "".join(rng.choices("abcdefgh", k=20_000)), " " * 5000, "\n" * 333 + "x", "a<|endoftext|>", "<|endoftext|>" * 7]
    assert Counter(FILE).count(texts).tolist() == library(texts)


def test_small_chunks_slices_and_few_states(monkeypatch):
    texts = [*mixed(300, 8), "".join(random.Random(2).choices("abcdefghé", k=3000))]
    want = library(texts)
    for name, value in (("WIDTH", 3), ("SLICE", 50), ("TOGETHER", 100), ("STATES", 40), ("FEWEST", 4)):
        monkeypatch.setattr(counts_of, name, value)
    assert Counter(FILE).count(texts).tolist() == want


def test_prefix_scan():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 5, (77, 5))
    want, now = [], np.arange(5)
    for one in maps:
        now = one[now]
        want.append(now)
    assert (compose(maps) == np.array(want)).all()


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello there,  world", 7), (1, "Hello there,  world", 8), (2, "", 0), (3, None, 0), (None, "née " * 300, 0)], "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in token_counts(docs, FILE, limit=500).collect()]
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := library([r["text"] or ""])[0], n > 500) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0), FILE).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op12_token_counts(spark, folder).collect()}
    want = {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(texts.items(), library(texts.values()))}
    assert got == want
