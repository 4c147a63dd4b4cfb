"""Exact duplicates with a heavy-hitter split: frequent digests map-side, the others by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import free_names, keep, text_of

#: a digest with more than this share of the rows is frequent; so at most 1/SHARE digests are broadcast
SHARE = 0.001

def _digest() -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", "").cast("binary"), 256))


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normalised text and code points of the original: the only pass over the texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.length(text_of()).cast("long").alias("size"))


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays and the group's size; partial sums are formed before the shuffle."""
    best = F.max(F.struct(F.col("size"), F.bitwise_not("doc_id").alias("negative")))
    return rows.groupBy("digest").agg(F.bitwise_not(best["negative"]).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _frequent(facts: DataFrame, share: float) -> DataFrame:
    """Digests of more than ``share`` of all rows, exactly counted, with the rows that stay: at most 1/share rows."""
    named = facts.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], share)  # as text: binary keys would count by reference
    found = named.select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest")).distinct()
    counted = _winners(facts.join(F.broadcast(found), "digest", "left_semi"))
    return keep(counted.filter(F.col("group_size") > share * facts.count()), "frequent")


def classes(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after removal of blanks, tabs and line ends; null counts as empty.
    The row with the most code points stays, then the smallest doc_id.

    1. Misra-Gries counters (``freqItems``: at most 1/share per task, merged as partial aggregates)
       name every digest with more than ``share`` of all rows, and maybe some others.
    2. Exact counts verify the candidates; at most 1/share digests remain, with the rows that stay.
    3. Their broadcast answers the rows of frequent digests in place, without a shuffle.
    4. No remaining digest has more than ``share`` of the rows, so an ordinary aggregation and join follow.

    Repeated rows with one doc_id form a group like others and have the same ``kept``; rows without doc_id
    stay only in a group in which no row has one. An empty table gives an empty result. Extra columns are ignored.
    """
    facts = keep(_facts(docs), "digests")
    hot, cold = _split(facts, _frequent(facts, share))
    own = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    return (hot.select(*cold.columns).unionByName(cold)
            .select("doc_id", "keep_id", "group_size", own.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def _split(facts: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    rest = facts.join(F.broadcast(frequent), "digest", "left_anti")
    return facts.join(F.broadcast(frequent), "digest"), rest.join(_winners(rest), "digest")


def drop_copies(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; of repeated rows with one doc_id and text one stays.

    Copies of frequent texts go before the shuffle. The other texts move once, by (doc_id, digest),
    to meet the identifiers of the rows that stay. A null text counts as empty; a row without doc_id stays only in a group in which no row has
    one; an empty table gives an empty result; further columns may have any names.
    """
    facts = keep(_facts(docs), "digests")
    frequent = _frequent(facts, share)
    hot, cold = _split(facts, frequent)
    own = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    keys = free_names(docs, "_id", "_none", "_digest", "_keep")
    ident, none, digest, chosen = keys
    stay = hot.select(*cold.columns).unionByName(cold).filter(own).select(
        F.coalesce("doc_id", F.lit(0)).alias(ident), F.col("doc_id").isNull().alias(none), F.col("digest").alias(digest))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumns({ident: F.coalesce(doc_id, F.lit(0)), none: doc_id.isNull(), digest: _digest()})
    mapside = rows.join(F.broadcast(frequent.select(F.col("digest").alias(digest), F.col("keep_id").alias(chosen))), digest, "left").filter(
        F.col(chosen).isNull() | (F.col(chosen) == F.col(ident)))
    return mapside.dropDuplicates(keys[:3]).join(stay, keys[:3], "left_semi").select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return classes(read(spark, folder, "documents"))
