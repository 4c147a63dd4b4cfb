"""Helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: a table is broadcast only below this many rows, checked at build time
BROADCAST_ROWS = 100_000
#: a key with more rows than this may be treated as hot
HOT_ROWS = 1_000_000
#: so many hot keys at most are broadcast
HOT_KEYS = 1_000


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column | str, value: str, pos: str = "_pos") -> DataFrame:
    """One row per array element with its position.

    The outer form plus a test on the generated position: with the plain form the optimizer adds a
    size test on the array expression itself, which is then computed twice and copied down the plan.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def only(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a costly ``condition`` holds; it is computed once, while a filter would be pushed down with a copy of all it is made of."""
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_only"))
    return marked.filter(F.col("_only").isNotNull()).drop("_only")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan with fewer splits than cores; a larger scan is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows dealt out by ``keys`` to all cores, however few bytes they have.

    Without a number, adaptive execution joins the parts of a shuffle by their bytes, which say nothing of the rows that a step
    makes of them. No more parts than cores: a task that starts with long expressions takes a fraction of a second for them alone.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the table has at most ``max_rows`` rows (reads no more than that plus one)."""
    return df.limit(max_rows + 1).count() <= max_rows


def number_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                     block: Column, out: str) -> DataFrame:
    """1-based row number per key without holding a key in one task.

    ``block`` must not decrease along ``order``. Rows are numbered inside (keys, block); the block
    sizes, one short row per block, are summed up per key and added.
    """
    keyed = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    return (keyed.withColumn("_inside", F.row_number().over(inside))
            .join(offsets, [*keys, "_block"])
            .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
            .drop("_block", "_inside", "_offset"))


def number_all(df: DataFrame, order: Sequence[Column | str], block: Column, out: str) -> DataFrame:
    """Global 1-based row number; only the block sizes meet in one task."""
    return number_in_groups(df.withColumn("_all", F.lit(0)), ["_all"], order, block, out).drop("_all")


def numbered_by_range(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """0-based number in a total ``order``: rows are dealt by ranges of it, numbered in their range, and the ranges' sizes, one number each, are added."""
    from siftweb.session import cut_lineage

    table = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    table = table.withColumns({"_shard": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = table.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n")).select("_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return table.join(F.broadcast(bases), "_shard").withColumn(out, F.col("_base") + F.col("_at")).drop("_shard", "_at", "_base")  # one row per range


def _split_join(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str, spread: Column) -> DataFrame:
    values = [c for c in table.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))),
                       key, "left")
    # rows of a hot key have their values already and rows without a key have none: a salt that no table row bears spreads both
    apart = F.coalesce("_hot", F.lit(False)) | F.col(key).isNull()
    marked = marked.withColumns({"_join": F.coalesce(F.col(key).cast("string"), F.lit("")),
                                 "_salt": F.when(apart, F.shiftrightunsigned(F.xxhash64(spread), 2) + 1).otherwise(F.lit(0).cast("long"))})
    cold = table.select(F.col(key).cast("string").alias("_join"), F.lit(0).cast("long").alias("_salt"), *values)
    joined = marked.join(cold, ["_join", "_salt"], "left")
    for c in values:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_hot_{c}"), F.col(c)))
    return joined.drop("_join", "_salt", "_hot", *[f"_hot_{c}" for c in values])


def lookup_by_key(rows: DataFrame, summary: DataFrame, key: str, size: str,
                  spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of many ``rows`` to a per-key ``summary`` that knows each key's row count.

    The HOT_KEYS largest keys above ``hot_rows`` are broadcast, which bounds that side; any further key
    holds at most 1/HOT_KEYS of the rows and goes through the shuffle join.
    """
    hot = summary.filter(F.col(size) > hot_rows).orderBy(F.col(size).desc(), key).limit(HOT_KEYS).drop(size)
    return _split_join(rows, summary.drop(size), hot, key, spread)


def join_by_hot_key(rows: DataFrame, table: DataFrame, key: str, spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` to a ``table`` with one row per key; the hot keys are counted in ``rows``."""
    top = rows.groupBy(key).count().filter(F.col("count") > hot_rows).orderBy(F.col("count").desc(), key).limit(HOT_KEYS)
    return _split_join(rows, table, table.join(F.broadcast(top.select(key)), key, "left_semi"), key, spread)
