"""Phrase collocations by direct-address tiling: frequency-ranked ids, dense tiles for frequent pairs, sorted lists for rare ones.

Texts become blocks of ids. A level counts the pairs of neighbouring ids: a pair of words, then a pair of overlapping
pairs (three words), and so on. Frequent pairs are numbered by falling frequency and become the ids of the next level,
so the pairs that occur most lie close together in a small square, whose tiles are counted by plain addressing.
Only ids of frequent phrases go on: a phrase is never more frequent than its parts.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftweb.llm.common import keep, ranked, text_of

#: bits of the sieve that stands before a join with frequent items: 4 MB when broadcast, whatever the input
SIEVE = 1 << 24
#: words of a block, ids on a side of a tile, tiles on a side of the square that is counted densely, pairs that make a tile dense
BLOCK, SIDE, SQUARE, DENSE = 1 << 21, 512, 8, 1 << 13
#: least frequency, longest phrase, percent of a phrase's occurrences inside a longer one that drop it, rows per language
LEAST, LONGEST, INSIDE, TOP = 100, 5, 100, 2000

#: ends a piece; no text holds this byte
_END = b"\xff"
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")

_WORDS = "block long, seq binary, local int, n long, lang string, word string"
_PAIRS = "block long, seq binary, local int, n long, left long, right long"


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left, right) with their counts, and for every pair the index of its own among them.

    Pairs of ids below SIDE * SQUARE are dealt to tiles of SIDE x SIDE cells; a well-filled tile is counted with ``bincount`` over its
    cells, which also hold the pairs' indexes. The rest is a sorted list of coordinates with run lengths.
    """
    inside = (left < SIDE * SQUARE) & (right < SIDE * SQUARE)
    tile = np.where(inside, left // SIDE * SQUARE + right // SIDE, SQUARE * SQUARE).astype(np.uint8 if SQUARE < 16 else np.int32)
    filled = np.bincount(tile, minlength=SQUARE * SQUARE + 1)
    dense = np.flatnonzero(filled[:-1] >= DENSE)
    own = np.empty(len(left), np.int32)
    lefts, rights, counts, base = [], [], [], 0
    order = np.argsort(tile, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(filled)])
    sparse = np.ones(len(left), bool)
    index = np.empty(SIDE * SIDE, np.int32)
    for t in dense.tolist():
        at = order[bounds[t]:bounds[t + 1]]
        sparse[at] = False
        cell = left[at] % SIDE * SIDE + right[at] % SIDE
        n = np.bincount(cell, minlength=SIDE * SIDE)
        some = np.flatnonzero(n)
        index[some] = np.arange(base, base + len(some), dtype=np.int32)
        own[at] = index[cell]
        lefts.append(t // SQUARE * SIDE + some // SIDE)
        rights.append(t % SQUARE * SIDE + some % SIDE)
        counts.append(n[some])
        base += len(some)
    at = np.flatnonzero(sparse)
    order = at[np.lexsort((right[at], left[at]))]
    a, b = left[order], right[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    own[order] = base + np.cumsum(first, dtype=np.int32) - 1
    starts = np.flatnonzero(first)
    lefts.append(a[starts])
    rights.append(b[starts])
    counts.append(np.diff(np.append(starts, len(order))))
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts), own


def _table(block: int, seq: np.ndarray, n: np.ndarray, columns: dict[str, pa.Array]) -> dict:
    """One row with the block's ids, and a row per distinct item."""
    k = len(n)
    def below(kind, values):
        return pa.concat_arrays([pa.nulls(1, kind), values])

    return {"block": pa.array(np.full(k + 1, block, np.int64)), "seq": pa.array([seq.astype("<i4").tobytes(), *[None] * k], pa.binary()),
            "local": below(pa.int32(), pa.array(np.arange(k, dtype=np.int32))), "n": below(pa.int64(), pa.array(n.astype(np.int64)))} | {
                c: below(v.type, v) for c, v in columns.items()}


def _words(batches):
    """Blocks of about BLOCK words: local word numbers in text order, -1 at the end of every piece."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def fresh():
        nonlocal known, seqs, held
        following = count().__next__
        known, seqs, held = defaultdict(lambda: defaultdict(following, {_END: -1})), [], 0

    known: dict = {}
    seqs: list[np.ndarray] = []
    held = 0
    fresh()

    def close():
        nonlocal number
        seq = np.concatenate(seqs)
        words = [(i, lang, w) for lang, own in known.items() for w, i in own.items() if i >= 0]
        words.sort(key=lambda w: w[0])
        n = np.bincount(seq[seq >= 0], minlength=len(words))
        columns = {"lang": pa.array([w[1] for w in words], pa.string()), "word": pa.array([w[2] for w in words], pa.binary()).cast(pa.string())}
        number += 1
        fresh()
        return pa.RecordBatch.from_pydict(_table(number, seq, n, columns))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_text").to_pylist()):
            words = text.encode().lower().translate(_SPLIT).replace(b"\n", b" " + _END + b" ").split()
            at = 0
            while at < len(words):  # a block may end at the end of any piece, so a long text takes several
                end = min(at + BLOCK - held, len(words))
                if end < len(words):
                    try:
                        end = words.index(_END, end) + 1
                    except ValueError:
                        end = len(words)
                part = words[at:end]
                seqs.append(np.fromiter(map(known[lang].__getitem__, part), np.int32, len(part)))
                held += len(part)
                at = end
                if held >= BLOCK:
                    yield close()
            seqs.append(np.array([-1], np.int32))
    if held:
        yield close()


def _pairs(blocks: pa.Table, named: pa.Table) -> pa.Table:
    """The next level of one block: its sequence in global ids, then the neighbouring pairs of it."""
    block, seq = blocks.column("block")[0].as_py(), np.frombuffer(blocks.column("seq")[0].as_py(), "<i4")
    ids = np.full(int(seq.max(initial=0)) + 2, -1, np.int64)  # the last one answers -1
    if named.num_rows:
        ids[named.column("local").to_numpy()] = named.column("id").to_numpy()
    ids[-1] = -1
    whole = ids[seq]
    at = np.flatnonzero((whole[:-1] >= 0) & (whole[1:] >= 0)) if len(whole) else np.zeros(0, np.int64)
    left, right, n, own = tile_counts(whole[at], whole[at + 1])
    # runs without a pair shrink to one gap, which keeps what stood apart apart
    following = np.full(len(seq), -1, np.int32)
    following[at] = own
    stays = following >= 0
    stays[1:] |= following[:-1] >= 0
    return pa.table(_table(block, following[stays], n, {"left": pa.array(left.astype(np.int64)), "right": pa.array(right.astype(np.int64))}))


def _frequent(items: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """Items with ``least`` occurrences in all and their ids, numbered from 0 by falling frequency; a written table."""
    sums = items.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    found = ranked(sums, [F.col("f").desc(), *map(F.col, keys)], "id", name)
    return keep(found.withColumn("id", F.col("id") - 1), name)


def _sifted(items: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The items whose key's bit is set among those of ``ids``: all frequent ones and few others, without a shuffle.

    The bits lie in SIEVE / 64 cells at most, so the broadcast has a fixed bound; a full sieve would let everything pass.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    cell, place = F.shiftright(bit, 6).alias("_cell"), F.pmod(bit, F.lit(64)).cast("int")
    mask = F.expr("bit_or(shiftleft(1L, _place))")
    cells = keep(ids.select(cell, place.alias("_place")).groupBy("_cell").agg(mask.alias("_bits")), "sieve")
    marked = items.withColumns({"_cell": F.shiftright(bit, 6), "_place": place}).join(F.broadcast(cells), "_cell")
    return marked.filter(F.expr("shiftrightunsigned(_bits, _place) & 1") == 1).drop("_cell", "_place", "_bits")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f, left, right, id) of all phrases with at least ``least`` occurrences, and (lang, n) with the words of each language.

    ``id`` numbers the phrases of one size; ``left`` and ``right`` are the ids of the phrase without its last and its first word.
    Every block's distinct items are counted by a shuffle, one row per block however often they occur in it; those that pass a
    sieve of the frequent ones meet the ids by another; the blocks' sequences and the ids of their items meet by block.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("_text"))
    level = keep(rows.mapInArrow(_words, _WORDS), "words")
    items = level.filter(F.col("local").isNotNull())
    totals = keep(items.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ids = _frequent(items, ["lang", "word"], least, "level1")
    none = F.lit(None).cast("long")
    phrases = [ids.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f", none.alias("left"), none.alias("right"), "id", F.col("word").alias("last"))]
    keys = ["lang", "word"]
    for size in range(2, longest + 1):
        named = _sifted(items.select("block", "local", *keys), ids, keys).join(ids.select("id", *keys), keys).select(F.col("block").alias("of"), "local", "id")
        blocks = level.filter(F.col("seq").isNotNull()).select("block", "seq")
        level = keep(blocks.groupBy("block").cogroup(named.groupBy("of")).applyInArrow(_pairs, _PAIRS), f"pairs{size}")
        items, keys = level.filter(F.col("local").isNotNull()), ["left", "right"]
        ids = _frequent(items, keys, least, f"level{size}")
        before = phrases[-1]
        first = before.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_head"))
        second = before.select(F.col("id").alias("right"), "last")
        found = ids.join(first, "left").join(second, "right")
        phrases.append(keep(found.select("lang", F.concat_ws(" ", "_head", "last").alias("phrase"), F.lit(size).alias("size"), "f", "left", "right", "id", "last"), f"phrases{size}"))
    every = phrases[0]
    for one in phrases[1:]:
        every = every.unionByName(one)
    return every.drop("last"), totals


def _scores(batches):
    """Exact scores of cuts: floor(1000 * a * n / (l * r)) in whole numbers of any size."""
    for batch in batches:
        a, n, left, right = (batch.column(c).to_pylist() for c in ("a", "n", "l", "r"))
        score = [1000 * x * m // (p * q) for x, m, p, q in zip(a, n, left, right)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.int64())], [*batch.schema.names, "score"])


def _outer(phrases: DataFrame, inside: int) -> Column:
    return F.lit(100) * F.col("_longer") >= F.lit(inside) * F.col("f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least over its cuts in two of floor(1000 * a * n / (l * r)); of equal scores the first cut counts.
    A phrase goes if a longer frequent one around it has ``inside`` percent of its occurrences; it is enough to look one word
    further, since a phrase between the two is at least as frequent as the longer one. ``top`` is the length of the report.

    A null or empty text has no words; a null language is ``und``; repeated rows count each; equal phrases of two
    languages are apart; an empty table gives an empty result; other columns are ignored. Texts are read whole, in blocks that end
    between pieces; one piece is never cut.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    longer = (phrases.filter("size > 2").select("size", "f", F.explode(F.array("left", "right")).alias("id"))
              .groupBy((F.col("size") - 1).alias("size"), "id").agg(F.max("f").alias("_longer")))
    own = phrases.filter("size > 1").join(longer, ["size", "id"], "left")
    candidates = own.filter(~F.coalesce(_outer(own, inside), F.lit(False))).select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({
        "_first": F.concat_ws(" ", F.slice(words, F.lit(1), F.col("cut"))), "_rest": F.concat_ws(" ", F.slice(words, F.col("cut") + 1, F.col("size")))})
    known = phrases.select("lang", "phrase", "f")
    parted = (cuts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
              .join(known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
              .join(totals, "lang").select("lang", "phrase", "cut", "a", "l", "r", "n"))
    scored = parted.mapInArrow(_scores, "lang string, phrase string, cut int, a long, l long, r long, n long, score long")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_best")).select(
        "lang", "phrase", "a", "n", "_best.l", "_best.r", "_best.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    found = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return collocations(read(spark, folder, "documents"))
