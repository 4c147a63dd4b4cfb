"""From raw documents to packed sequences: every stage reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftweb.llm import exact_dedup, mixing, near_dedup, packing, quality
from siftweb.llm.common import read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: rows as they are, repeated ones too.

    Null and empty texts are scored like others; without labels every document is accepted or none, as the classifier says;
    an empty table stays empty; further columns may have any names, here and in the other stages.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts; null counts as empty, so one document without text stays; repeated rows fall together."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies; documents without words or without doc_id stay."""
    return near_dedup.drop_near(docs)


#: Shares of the mixture: plain text is to keep its amount, which fixes the others, and no document comes twice. Posteriors are soft, so a document
#: that is partly poor is partly plain: no rates up to 1 meet these targets, and the stage comes as near as it can (``mixing.plan`` reports
#: targets and totals; on the documents of sf0.01 plain ends 2 % below its amount, poor at 1 % of all tokens instead of none).
WEIGHTS = {"plain": 0.98, "toxic": 0.02}


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains nearest to WEIGHTS; documents without words have the rate of their posterior, rows that repeat a doc_id share one."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"), WEIGHTS, hold="plain", most=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids and their places in sequences of 1024 tokens; an empty text is its end token."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("mixing", to_target_weights), ("packing", packed)]

#: classifiers, signatures and packing have no SQL counterpart; the operators of the stages are tested against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table in the shared folder and read again."""
    from siftweb.llm.common import keep

    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
