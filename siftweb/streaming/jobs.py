"""Continuous versions of the log operators. Offsets and state live in the query's checkpoint folder.

Sinks write one folder per batch number, so a batch repeated after a restart replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.functions import urls
from siftweb.operators.extract import extract_media_network
from siftweb.sources import tables


def read_event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop_duplicates("url_hash")


def new_urls(stream: DataFrame, url: str = "url", watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Each address once, ever; with a watermark once within it, with bounded state.

    Repeats inside an Arrow batch go before the shuffle, so an address that fills a third of the stream
    reaches its state partition about once per ten thousand rows.
    """
    keyed = stream.select(url, *([ts] if watermark else [])).withColumn("url_hash", urls.url_hash_raw(F.col(url)))
    thin = keyed.mapInPandas(_thin, keyed.schema)
    if watermark:
        return thin.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url_hash"])
    return thin.dropDuplicates(["url_hash"])


def run_first_seen(stream: DataFrame, path: str, checkpoint: str, url: str = "url") -> None:
    """Each address once, ever, with the table at ``path`` as memory: the stream itself keeps no state and needs no Python.

    A batch's distinct addresses are those that no earlier batch has written; of the table only the hashes are read. A batch repeated
    after a restart leaves its own earlier result out of account and replaces it.
    """
    def sink(batch: DataFrame, number: int) -> None:
        fresh = batch.select(url).withColumn("url_hash", urls.url_hash_raw(F.col(url))).groupBy("url_hash").agg(F.min(url).alias(url))
        if tables.exists(batch.sparkSession, path):
            known = batch.sparkSession.read.parquet(path).filter(F.col("write_seq") < number).select("url_hash")
            fresh = fresh.join(known, "url_hash", "left_anti")
        tables.append(fresh, path, number)

    _run(stream, sink, checkpoint, "append")


def media_events(stream: DataFrame) -> DataFrame:
    """Stateless: the source offsets are the marks."""
    return extract_media_network(stream)


def progress(stream: DataFrame, task: str = "task_id") -> DataFrame:
    """Running counts per task; aggregated map-side first."""
    return stream.groupBy(task).agg(F.count(F.lit(1)).alias("pages"), F.sum("media").cast("long").alias("media"), F.max("ts").alias("last_seen"))


def rate_windows(stream: DataFrame, per_minute: int, ts: str = "ts", host: str = "host", late: str = "10 minutes") -> DataFrame:
    """Hosts and sixty-second windows (every five seconds) above the quota."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, "60 seconds", "5 seconds"), host).agg(F.count(F.lit(1)).alias("requests"))
            .filter(F.col("requests") > per_minute)
            .select(host, F.col("window.start").alias("window_start"), "requests"))


def _run(stream: DataFrame, sink, checkpoint: str, mode: str) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; another call goes on from the checkpoint."""
    _run(stream, lambda batch, number: tables.append(batch, path, number), checkpoint, mode)
