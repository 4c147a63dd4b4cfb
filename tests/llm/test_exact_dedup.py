"""Exact dedup against a plain version."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from siftweb.llm.exact_dedup import _frequent, classes, drop_copies

ROWS = [(1, "a b", "x"), (2, "a  b", "y"), (3, "ab\n", "z"), (4, None, "x"), (5, "", "x"), (6, " \t\x0b", "x"), (7, "other", "x"), (8, "other", "x"), (8, "other", "x"),
        (9, "c" * 200_000, "x"), (10, "c" * 199_999 + " c", "x"), (11, "é", "x"), (12, " é", "x")] + [(100 + i, "hot  copy" if i == 7 else "hot copy", "x") for i in range(40)]


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id))
    out = []
    for body, members in groups.items():
        keep = min(members)[1]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(body.encode()).hexdigest()) for _, d in members]
    return sorted(out)


def test_classes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    for share in (0.001, 0.2, 0.9):
        assert sorted(map(tuple, classes(docs, share).collect())) == plain(ROWS)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    got = drop_copies(docs, 0.2)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({r[0] for r in plain(ROWS) if r[3]})


def test_empty_and_unnamed(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert classes(none).count() == 0 and drop_copies(none).count() == 0
    unnamed = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in classes(unnamed).collect()) == [
        ("1", "1", True), ("None", "1", False), ("None", "None", True)]
    assert sorted(str(r["doc_id"]) for r in drop_copies(unnamed).collect()) == ["1", "None"]


def test_a_frequent_digest_at_the_start_of_the_partitions_is_named(spark):
    text = F.when(F.col("id") % 5000 < 1600, "hot").otherwise(F.col("id").cast("string"))
    facts = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.lit(3).cast("long").alias("size"))
    got = _frequent(facts, 0.01).collect()
    assert [(bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in got] == [(hashlib.sha256(b"hot").digest(), 0, 6400)]


def test_clashing_columns_and_extreme_ids(spark):
    from siftweb.llm.exact_dedup import classes, drop_copies

    least = -(1 << 63)
    docs = spark.createDataFrame([(1, "a b", 1, "n", 2, 3), (2, "ab", 1, "n", 2, 3), (least, "c", 1, "n", 2, 3), (5, " c", 1, "n", 2, 3), (None, None, 1, "n", 2, 3)],
                                 "doc_id long, text string, _id int, `_NONE` string, _digest int, _keep int")
    got = drop_copies(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 1), (False, 5), (True, None)]
    assert {r["doc_id"]: r["keep_id"] for r in classes(docs).collect()} == {1: 1, 2: 1, least: 5, 5: 5, None: None}
