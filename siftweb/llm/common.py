"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftweb.session import checkpoint_root

#: rows in one Arrow batch; with documents of 120 kB a batch stays near 60 MB
ARROW_ROWS = 512


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder; Arrow batches are kept small because a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete a written folder when it ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: ends the lineage there.

    Written tables survive lost executors and, unlike checkpoints, are compressed and read by column.
    They go when the driver ends.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_own(df: DataFrame, names) -> DataFrame:
    """Drop the columns an operator is about to add, whatever their case, so that clashing extra columns are replaced."""
    own = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in own])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` bears, whatever the case: the wanted ones, with a number behind where they are taken."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        number, one = 0, name
        while one.lower() in taken:
            number, one = number + 1, f"{name}{number}"
        taken.add(one.lower())
        found.append(one)
    return found


def ranked(rows: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """``rows`` with their number from 1 on in a total ``order``, as a written table sorted by it.

    Rows are dealt by ranges of ``order`` and numbered in their range; the ranges' sizes, one number each, are added.
    """
    at, shard, base = free_names(rows, "_at", "_shard", "_base")
    table = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)
    table = table.withColumns({shard: F.shiftright(at, 33), at: F.col(at).bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    bases = table.groupBy(shard).agg(F.count(F.lit(1)).alias(base)).select(shard, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    return table.join(F.broadcast(bases), shard).withColumn(out, (F.col(base) + F.col(at) + 1).cast("long")).drop(at, shard, base)  # one row per written file
