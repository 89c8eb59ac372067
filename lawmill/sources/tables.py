"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files give tasks for less than half of them (a single row group, say), for work that
    costs more than moving the rows; any larger scan as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() < cores else scan
