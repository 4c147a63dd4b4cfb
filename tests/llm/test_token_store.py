"""Token files against direct encoding, and what the files hold."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftweb.llm.token_store import digest, read_tokens, write_tokens
from siftweb.llm.word_cache import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", " ", "\n", ".", ",", "7", "\x00", "\x1c", "\xa0", "́", "\t", "'s", "  ", "　", "ß", "İ", "Σ", "<|endoftext|>", "\r", "日", "word", "Wörter."]


def test_encoder_gives_the_ids_of_one_call():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 16))) for _ in range(8000)] + ["x" * 50_000, "ab " * 20_000, ""]
    for path, keep_blank in ((WORD, False), (BYTE, True)):
        encoder = Encoder(path, keep_blank)
        direct = Tokenizer.from_file(path)
        direct.encode_special_tokens = True
        for _ in range(2):  # new and remembered pieces
            got = encoder.encode_all(texts)
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]


def test_marks_behind_words_are_cut_off_only_where_a_match_ends():
    texts = ["one, two. three", "one ,two .three", "é, é. é,", "a.b, 1. 2, x), ..., a,, a.,", ", a", "a,\nb.\nc,", "a\x00, b\x00. \x00,", "ﬁ, ª. Ω, Ж.", "a' b's, c'.", "ab. ab"]
    for path, keep_blank in ((WORD, False), (BYTE, True)):
        direct = Tokenizer.from_file(path)
        direct.encode_special_tokens = True
        got = Encoder(path, keep_blank).encode_all(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]


def test_forgotten_pieces_come_back(monkeypatch):
    from siftweb.llm import word_cache

    monkeypatch.setattr(word_cache, "REMEMBERED", 40)
    monkeypatch.setattr(word_cache, "TOGETHER", 300)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)] + ["y" * 60]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(120)]
    encoder, direct = Encoder(BYTE, True), Tokenizer.from_file(BYTE)
    got = encoder.encode_all(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]
    assert "y" * 60 not in encoder._young


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip(spark, tmp_path, shards):
    texts = ["one two", None, "", "Ünïcode, text.\nline", "long " * 9000] * 30
    rows = [(i * 3 - 40, t, "s") for i, t in enumerate(texts)] + [(6, "again", "s"), (6, "again", "s"), (None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    write_tokens(docs, str(tmp_path / "t"), WORD, end_id=1, shards=shards)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids"], r["ids_crc32"]) for r in
                 read_tokens(spark, str(tmp_path / "t")).select("*", F.lit(0).alias("x")).join(
                     digest(read_tokens(spark, str(tmp_path / "t"))).select("start", "ids_crc32"), "start").collect())
    direct, at = Tokenizer.from_file(WORD), 0
    assert [g[1] for g in got] == [r[0] for r in sorted(rows, key=lambda r: -1e9 if r[0] is None else r[0])]
    texts_of = {r[0]: r[1] for r in rows}
    for start, doc_id, n, ids, crc in got:
        assert ids == [*direct.encode(texts_of[doc_id] or "", add_special_tokens=False).ids, 1]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n


def test_files_allow_selective_reads(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and number "), F.col("id")).alias("text"))
    write_tokens(docs, str(tmp_path / "t"), WORD, shards=2)
    files = sorted(Path(tmp_path / "t").glob("*.parquet"))
    last = -1
    for file in files:
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        ids = next(c for name, c in columns.items() if name.startswith("ids"))
        assert ids.has_dictionary_page
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert columns["doc_id"].statistics.min > last
        last = columns["doc_id"].statistics.max
    some = read_tokens(spark, str(tmp_path / "t"), F.col("doc_id").between(100, 102))
    full = {r["doc_id"]: r["start"] for r in read_tokens(spark, str(tmp_path / "t")).collect()}
    assert {r["doc_id"]: r["start"] for r in some.collect()} == {i: full[i] for i in (100, 101, 102)}
    plan = read_tokens(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan[plan.index("Physical Plan"):]


def test_empty(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), WORD)
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0
