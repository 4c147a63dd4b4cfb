"""Best-fit decreasing one piece after the other, and whole packings of encoded documents."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siftweb.llm.packing import OpenBins, best_fit, pack_documents, sequences

FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        tight = min((r for r in room if r >= n), default=None)
        if tight is None:
            room.append(capacity - n)
        else:
            room[room.index(tight)] -= n
    return sorted(room)


def test_same_bins_as_piece_by_piece():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([7, 16, 31, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan, bins = best_fit(counts, capacity), defaultdict(list)
        for n, c in counts.items():
            for s, o in zip(*plan.place(np.full(c, n), np.arange(c))):
                bins[int(s)].append((int(o), n))
        for inside in bins.values():
            at = 0
            for offset, n in sorted(inside):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == plain(lengths, capacity)


def test_segment_tree_finds_the_tightest():
    rng, bins, there = random.Random(5), OpenBins(64), defaultdict(int)
    for i in range(2000):
        if rng.random() < 0.6 or not any(there.values()):
            room = rng.randint(1, 64)
            bins.add(room, i, 1)
            there[room] += 1
        else:
            length = rng.randint(1, 64)
            best = min((r for r, n in there.items() if n and r >= length), default=None)
            assert bins.tightest(length) == best
            if best:
                bins.take(best, 1)
                there[best] -= 1


def test_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "Théorie,", "xyzzy42.", "a\nb", "  gap"], k=rng.choice([0, 1, 5, 300, 900, 4000]))) for _ in range(60)] + [None, "", "x" * 30_000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "no id", 5)], "doc_id long, text string, offset int")
    rows = pack_documents(docs, FILE, capacity=1024)
    got = rows.collect()
    tokenizer, ids = Tokenizer.from_file(FILE), {}
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids[i] = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    pieces = defaultdict(set)
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert part == r["ids"] and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].add((r["piece"], r["start"], r["length"]))
    for i, own in ids.items():
        k = -(-len(own) // 1024)
        first = len(own) - 1024 * (k - 1)
        assert sorted(pieces[i]) == [(p, 0 if p == 0 else first + 1024 * (p - 1), first if p == 0 else 1024) for p in range(k)]
    lengths = [r["length"] for r in got]
    assert len({r["sequence_id"] for r in got}) == len(plain(lengths, 1024))
    whole = {r["sequence_id"]: r["ids"] for r in sequences(rows).collect()}
    for r in got:
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, whole.values())) == sum(lengths)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_query_and_pipeline_give_the_packed_ids(spark):
    import corpus_pipeline
    from siftweb.llm.packing import op9_packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for packed in (op9_packing(spark, "/root/testdata/sf0.001"), corpus_pipeline.packed(spark, docs, "")):
        rows = packed.collect()
        assert rows and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_many_shards_meet_their_numbers_in_a_shuffle(spark, monkeypatch):
    from siftweb.llm import packing

    monkeypatch.setattr(packing, "RANKS", 3)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["the", "of", "x1"], k=rng.choice([3, 3, 3, 40, 3000])))) for i in range(200)], "doc_id long, text string").repartition(9)
    cut = packing.pieces(docs, FILE)
    for most in (0, 1 << 30):
        rows = packing.pack(cut, 1024, most).collect()
        inside = defaultdict(list)
        for r in rows:
            inside[r["sequence_id"]].append((r["offset"], r["length"]))
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        for parts in inside.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert len(rows) == cut.count() and len(inside) == len(plain([r["length"] for r in rows], 1024))
