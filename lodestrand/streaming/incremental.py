"""Incremental operators: micro-batches with mergeable state, event-time windows, stateful progress.

Every function takes a streaming or a batch DataFrame; a file source with ``availableNow`` reads a table in micro-batches.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A parquet table as a stream of files, so many a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if not path.endswith(".parquet") else path[: -len(".parquet")] + "*.parquet")


def merge_batches(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], stopped: Callable[[], bool] = lambda: False) -> DataFrame:
    """The partial aggregates of all micro-batches, each tagged with its ``batch_id``, as one table.

    A batch is written once under its id, so a batch that runs again after a lost executor replaces itself. ``stopped`` is asked
    before each batch; once it says so, later batches are skipped.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        if not stopped():
            partial(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("b")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Extension: events of each type by window; rows later than the watermark are dropped by a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Extension: distinct users and events of overlapping windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top")).select(F.col("window.start").alias("start"), "n", "top")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Extension: sessions of each user, which end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def progress(updates: DataFrame) -> DataFrame:
    """Percent done of each document from ``doc``, ``processed`` (chunks of a batch) and ``total``; stateful on a stream.

    A document is Completed once as many chunks are done as it has, else Processing; percent is rounded down.
    """

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, total = state.get if state.exists else (0, 0)
        for b in batches:
            done += int(b["processed"].fillna(0).sum())
            total = max(total, int(b["total"].fillna(0).max() if len(b) else 0))
        state.update((done, total))
        percent = min(100, 100 * done // total) if total else 0
        yield pd.DataFrame({"doc": [key[0]], "done": [done], "percent": [percent], "status": ["Completed" if total and done >= total else "Processing"]})

    return updates.groupBy("doc").applyInPandasWithState(fold, "doc string, done long, percent long, status string", "done long, total long", "update", "NoTimeout")


def drop_repeats(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Extension: one event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def table_path(d: str, name: str) -> str:
    return os.path.join(d, f"{name}.parquet")
