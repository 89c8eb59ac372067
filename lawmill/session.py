"""Session and storage settings shared by every module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "lawmill") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LAWMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A temporary one stands in on a local master only (tests): on a
    cluster a machine's own folder is lost with the machine, so there it is an error to name none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage and compute once: a reliable checkpoint in the shared folder, which survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_unsized(df: DataFrame) -> DataFrame:
    """``materialise`` for loops that join what they made before: the plan's estimate of its size is cut as well.

    Spark's estimate for a join is the product of both sides', and a checkpoint keeps it; where each round joins the one
    before, its digits double from round to round until they fill the driver."""
    done = materialise(df)._jdf
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(done.javaRDD(), done.schema()), df.sparkSession)
