"""Keyed tables on Parquet: append-only folders per write, the current row picked on read.

A writer replaces only the folder of its own ``write_seq``, so repeating a write (a stream batch after a
restart, a retried job) changes nothing, and no reader's files are rewritten under it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.functions import urls
from siftweb.operators.audit import last_write_wins

TEXT_DEFAULTS = ["kind", "source_page", "album", "title", "origin"]
NUMBER_DEFAULTS = ["seq", "width", "height", "duration", "size"]


def append(df: DataFrame, path: str, write_seq: int, partitions: Sequence[str] = ()) -> None:
    (df.withColumn("write_seq", F.lit(write_seq).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("write_seq", *partitions).parquet(path))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def current(spark: SparkSession, path: str, keys: Sequence[str], first: bool = False) -> DataFrame:
    """Newest row per key, or the first one ever written."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    order = (-F.col("write_seq")) if first else F.col("write_seq")
    return last_write_wins(rows.withColumn("_order", order), keys, ["_order"]).drop("write_seq", "_order")


def _snapshot(spark: SparkSession, path: str) -> int | None:
    """The write up to which the newest finished snapshot of a table goes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_snapshots/upto=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=None)


def _rows_since(spark: SparkSession, path: str, snapshot: int | None) -> DataFrame:
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows if snapshot is None else rows.filter(F.col("write_seq") > snapshot)


def _with_snapshot(spark: SparkSession, path: str, keep=None) -> DataFrame:
    """Rows of the newest snapshot (those that ``keep`` wants) and of all later writes."""
    snapshot = _snapshot(spark, path)
    later = _rows_since(spark, path, snapshot)
    if snapshot is None:
        return later
    old = spark.read.parquet(f"{path}/_snapshots/upto={snapshot}")
    return (old if keep is None else old.filter(keep)).unionByName(later, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, keys: Sequence[str], partitions: Sequence[str] = ()) -> int:
    """Write the current row of every key, by ``partitions``, as a snapshot beside the writes; returns the write up to which it goes.

    A snapshot counts from the moment its folder is finished, and no file that a reader may have open is touched: readers that
    planned before go on with what they planned. The next compaction starts from the last one. Writes up to a snapshot may be repeated, not changed.
    """
    upto = spark.read.parquet(path).agg(F.max("write_seq")).first()[0]
    if upto is not None and _snapshot(spark, path) != upto:
        newest = last_write_wins(_with_snapshot(spark, path).filter(F.col("write_seq") <= upto), keys, ["write_seq"])
        newest.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(f"{path}/_snapshots/upto={upto}")
    return upto


def compact_media_items(spark: SparkSession, path: str) -> int:
    return compact(spark, path, ["url_hash"], ["task_id"])


def upsert_media_items(items: DataFrame, path: str, write_seq: int) -> None:
    """Replace by address; rows without one are dropped, gaps become '' and 0."""
    rows = items.filter(F.coalesce("url", F.lit("")) != "").withColumnRenamed("index", "seq")
    for name in TEXT_DEFAULTS:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit(""))
    for name in NUMBER_DEFAULTS:
        kind = "double" if name == "duration" else "long"
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast(kind) if name in rows.columns else F.lit(0).cast(kind))
    append(rows.select("task_id", urls.url_hash_raw(F.col("url")).alias("url_hash"), "url", *TEXT_DEFAULTS, *NUMBER_DEFAULTS), path, write_seq, ["task_id"])


def read_media_items(spark: SparkSession, path: str, task_id: int | None = None, limit: int = 0) -> DataFrame:
    """Current items of all tasks or of one, whose own folder of the snapshot is read, and the writes since: an address may have moved on to another task there."""
    own = None if task_id is None else F.col("task_id") == task_id
    rows = last_write_wins(_with_snapshot(spark, path, own), ["url_hash"], ["write_seq"]).drop("write_seq")
    rows = rows if own is None else rows.filter(own)
    rows = rows.withColumnRenamed("seq", "index").orderBy("album", "index", "url")
    return rows.limit(limit) if limit else rows


def count_media_items(spark: SparkSession, path: str, task_id: int | None = None) -> DataFrame:
    return read_media_items(spark, path, task_id).agg(F.count(F.lit(1)).alias("items"))


def record_downloads(rows: DataFrame, path: str, write_seq: int) -> None:
    append(rows.withColumn("url_hash", urls.url_hash_raw(F.col("url"))), path, write_seq)


def record_crawled(rows: DataFrame, path: str, write_seq: int) -> None:
    """First write wins per task and address; ``current(..., first=True)`` reads it back.

    Of several rows of one write the least stays, compared column by column.
    """
    keyed = rows.withColumn("url_hash", urls.url_hash_raw(F.col("url")))
    least = keyed.groupBy("task_id", "url_hash").agg(F.min(F.struct(*rows.columns)).alias("r"))
    append(least.select("r.*", "url_hash"), path, write_seq)


def visited(spark: SparkSession, path: str, task_id: int) -> DataFrame:
    return current(spark, path, ["task_id", "url_hash"], first=True).filter(F.col("task_id") == task_id)


def resume_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks whose last known state is running."""
    return current(spark, path, ["id"]).filter(F.col("status") == "running")


def append_reports(reports: DataFrame, path: str, write_seq: int) -> None:
    """``reports`` as built by the screening, body as JSON, partitioned by site."""
    body = reports.withColumn("report_json", F.to_json(F.struct(*reports.columns)))
    found = F.size("findings").cast("long")
    append(body.select("site", "start_url", "scan_time", "engine", F.size("pages").cast("long").alias("pages"), found.alias("hits"), "report_json"), path, write_seq, ["site"])


def list_reports(spark: SparkSession, path: str, site: str | None = None, limit: int = 20) -> DataFrame:
    """Newest first, without the bodies: those columns are never read."""
    rows = spark.read.parquet(path).select("write_seq", "site", "start_url", "scan_time", "engine", "pages", "hits")
    rows = rows if site is None else rows.filter(F.col("site") == site)
    return rows.orderBy(F.col("write_seq").desc(), "site", "start_url").limit(limit)


def load_report(spark: SparkSession, path: str, write_seq: int, site: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("write_seq") == write_seq) & (F.col("site") == site)).select("site", F.parse_json("report_json").alias("report"))


def count_reports(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return (rows if site is None else rows.filter(F.col("site") == site)).agg(F.count(F.lit(1)).alias("reports"))
