"""Token ids as Parquet list columns in document order, with selective reads.

File format: a folder of Parquet files, one per shard, in ascending document order. Columns
``doc_id, shard, n_tokens, start_in_shard, ids`` (``ids`` a list of int). Ids are dictionary encoded
(a page of 16-bit codes for vocabularies below 65,536); the counters are delta encoded (Parquet
version 2 pages). Row groups and pages are small enough that, with the column and offset indexes that
the writer adds, a reader that wants some documents or only the counters skips the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siftweb.llm.common import shared_folder, text_of
from siftweb.llm.word_cache import encoder

#: bytes of a row group and of a page, rows of a page at most
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 4096
#: bytes of text that one shard holds, roughly
SHARD_BYTES = 64 << 20

_ENCODED = "doc_id long, shard int, n_tokens long, start_in_shard long, ids array<int>"


def _encode(path: str, end_id: int, keep_blank: bool):
    def run(batches):
        from pyspark import TaskContext

        encode, shard, start = encoder(path, keep_blank).encode_all, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            parts = [ids + end for ids in encode(batch.column("text").to_pylist())]
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(parts), shard, np.int32)), pa.array(sizes),
                 pa.array(start + bounds[:-1]), ids], ["doc_id", "shard", "n_tokens", "start_in_shard", "ids"])
            start += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, keep_blank: bool = False,
                 shards: int | None = None) -> None:
    """Encode ``text`` of every row, append ``end_id`` and write the token files in ascending ``doc_id`` order.

    Rows are dealt by ranges of (doc_id, hash of the text), so a document id that repeats many times is
    split over shards. A null text counts as empty (its only id is ``end_id``); a null doc_id sorts
    first; repeated rows are kept; an empty table gives an empty folder of files. Other columns are ignored.
    ``shards``: number of files; by default Spark's shuffle partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order)
    (dealt.mapInArrow(_encode(tokenizer, end_id, keep_blank), _ENCODED)
     .write.option("compression", "snappy")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true")
     .option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .option("parquet.dictionary.page.size", str(PAGE_BYTES * 4))
     .parquet(folder))


def read_tokens(spark: SparkSession, folder: str, wanted: Column | None = None) -> DataFrame:
    """The token files with ``start``, the number of ids before the document in the whole corpus.

    ``start`` is the shard's base plus the position in the shard. The bases come from the counters alone:
    one short row per shard meets in one task. ``wanted`` is pushed to the files, where the indexes skip
    the pages it excludes; it doesn't change ``start``.
    """
    rows = spark.read.parquet(folder)
    bases = (rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
             .select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
                                         F.lit(0)).alias("_base")))
    chosen = rows if wanted is None else rows.filter(wanted)
    return (chosen.join(F.broadcast(bases), "shard")  # one row per file
            .select("doc_id", (F.col("_base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids"))


@F.pandas_udf(LongType())
def ids_crc32(ids):
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda one: zlib.crc32(np.asarray(one).astype("<u4").tobytes()))


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))


def op2_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Encode all documents, write the token files, read them back and digest what was read."""
    import public_tokenizers

    from siftweb.llm.common import drop_at_end, read

    out = shared_folder(spark, "tokens")
    write_tokens(read(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    drop_at_end(spark, out)
    return digest(read_tokens(spark, out))
