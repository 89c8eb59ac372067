"""A stream shipped key by key to a sink that may refuse keys.

State is a table of watermarks by key and an outbox of rows not taken yet, committed together once a batch with the batch's
number. What the sink took is recorded before that, so a batch that is run again sends nothing that is on record, and one
that was committed does nothing. A sink that is lost between taking rows and their record gets them again with the same
batch number, by which it can tell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill import sinks
from lawmill.session import materialise
from lawmill.streaming.state import run_available

Send = Callable[[DataFrame], DataFrame]


def _kinds(rows: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def shipped_state(spark: SparkSession, path: str, marks: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """(watermarks, outbox) as last committed; empty ones of the given schemas before."""
    where = sinks.current_version(spark, path)
    if where is None:
        return spark.createDataFrame([], marks), spark.createDataFrame([], rows)
    return spark.read.schema(marks).parquet(where), spark.read.schema(rows).parquet(f"{where}-outbox")


def ship_batch(batch: DataFrame, number: int, keys: Sequence[str], order: str, send: Send, path: str) -> None:
    """Send a batch's rows that are newer than their key's watermark, with what waits in the outbox; move the watermarks of the
    keys that ``send`` (rows with ``batch``, the number) gives back, keep the rows of all others in the outbox."""
    spark, version = batch.sparkSession, f"batch-{number:012d}"
    if version in sinks.committed_versions(spark, path):
        return
    keys = list(keys)
    marks, outbox = shipped_state(spark, path, f"{_kinds(batch, keys)}, watermark {batch.schema[order].dataType.simpleString()}", _kinds(batch, batch.columns))
    newer = batch.join(marks, keys, "left").filter(F.col("watermark").isNull() | (F.col(order) > F.col("watermark"))).select(*batch.columns)
    # a repeated batch may meet an outbox row again: rows equal in all columns are one
    fresh = materialise(outbox.unionByName(newer).distinct())
    record = f"{path}/taken/{version}"
    files, folder = sinks.file_system(spark, f"{record}/_SUCCESS")
    if not files.exists(folder):
        send(fresh.withColumn("batch", F.lit(number))).select(*keys).distinct().write.mode("overwrite").parquet(record)
    taken = spark.read.schema(_kinds(batch, keys)).parquet(record)
    moved = fresh.join(taken, keys, "left_semi").groupBy(*keys).agg(F.max(order).alias("watermark"))
    kept = marks.join(moved.select(*keys), keys, "left_anti").unionByName(moved)
    fresh.join(taken, keys, "left_anti").write.mode("overwrite").parquet(f"{path}/{version}-outbox")
    sinks.commit_state(kept, path, version)


def ship_stream(rows: DataFrame, keys: Sequence[str], order: str, send: Send, path: str, checkpoint: str) -> None:
    """Ship all there is of a stream; rows of a key come in rising ``order``."""
    run_available(rows, lambda batch, number: ship_batch(batch, number, keys, order, send, path), checkpoint)
