"""Incremental harvest of run logs and cursors. State moves on only after the sink took a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lawmill import sinks
from lawmill.operators import runlogs
from lawmill.operators.filters import bad_label
from lawmill.session import materialise

WORKFLOW = ("org", "repo", "workflow")


def harvest(runs: DataFrame, lines: DataFrame, watermarks: DataFrame, now: Column, now_ns: Column, n_tail: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lines to ship, new watermarks): runs after the watermark up to the first that isn't done; the tail of good
    runs and a bounded tail of failed ones; collection stamps in event order."""
    fresh = runlogs.select_runs(runs, watermarks, WORKFLOW, now)
    ready = runlogs.contiguous_prefix(fresh, WORKFLOW, "id", (F.col("status") == "completed") & ~bad_label(F.col("workflow")))
    marks = ready.groupBy(*WORKFLOW).agg(F.max("id").alias("watermark"))
    named = runlogs.without_noise(lines.join(ready.select(*WORKFLOW, F.col("id").alias("run_id"), "conclusion"), "run_id"))
    good = runlogs.tail(named.filter(F.col("conclusion") == "success"), ["run_id"], "line_no", n_tail).withColumn("dropped", F.lit(0).cast("bigint"))
    bad = runlogs.byte_tail(named.filter(~F.col("conclusion").eqNullSafe("success")), ["run_id"], "line_no")
    return runlogs.collection_stamps(good.unionByName(bad), WORKFLOW, ["run_id", "line_no"], now_ns), marks


def ship(batches: DataFrame, marks: DataFrame, before: DataFrame, keys: Sequence[str], send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New watermarks: those of the keys that ``send`` reports as taken; other keys keep theirs."""
    taken = send(batches).select(*keys).distinct()
    moved = marks.join(taken, list(keys), "left_semi")
    return before.join(moved.select(*keys), list(keys), "left_anti").unionByName(moved)


def advance_cursors(cursors: DataFrame, rows: DataFrame, category: str, ts: str) -> DataFrame:
    """The larger of each category's cursor and its newest row."""
    newest = rows.groupBy(F.col(category).alias("category")).agg(F.max(ts).alias("_new"))
    both = cursors.join(newest, "category", "full_outer")
    return both.select("category", F.greatest(F.coalesce("cursor", F.lit("1900-01-01").cast("timestamp_ntz")), F.coalesce("_new", "cursor")).alias("cursor"))


def new_versions(inputs: DataFrame, processed: DataFrame, keys: Sequence[str], version: str = "version", force: bool = False) -> DataFrame:
    """Inputs whose version isn't one that was processed for their key. An input without a version always goes on, and with
    ``force`` all do."""
    return inputs if force else inputs.join(processed.select(*keys, version).distinct(), [*keys, version], "left_anti")


def run_gated(inputs: DataFrame, path: str, run: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], version: str = "version", force: bool = False) -> DataFrame:
    """One run over the inputs (keys, version) that are new; gives its result row: ``status`` (ok, also for nothing new;
    degraded; failed), ``total`` and ``failed`` rows.

    ``work`` gives rows with the keys, the version and an ``error``, null or empty where it went well. Good rows are written for
    ``outputs``; a key's version counts as processed if none of its rows failed, so the others come again. Both become visible
    with one commit, named ``run``; a run that was committed before does nothing and a lost one can be repeated.
    """
    spark = inputs.sparkSession
    if run in sinks.committed_versions(spark, path):
        return spark.read.json(f"{path}/{run}-result")
    before = sinks.current_version(spark, path)
    kinds = ", ".join(f"`{k}` {inputs.schema[k].dataType.simpleString()}" for k in (*keys, version))
    processed = spark.read.schema(kinds).parquet(before) if before else spark.createDataFrame([], kinds)
    made = materialise(work(new_versions(inputs, processed, keys, version, force)))
    bad = F.coalesce("error", F.lit("")) != ""  # not a test for null, which would fold away for a column that has none
    counts = Observation()
    seen = made.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failed"))
    seen.filter(~bad).drop("error").write.mode("overwrite").parquet(f"{path}/{run}-output")
    total, failed = counts.get["total"], counts.get["failed"]
    status = "ok" if not failed else "failed" if failed >= total else "degraded"
    result = spark.createDataFrame([(run, status, total, failed)], "run string, status string, total long, failed long")
    result.write.mode("overwrite").json(f"{path}/{run}-result")
    done = made.groupBy(*keys, version).agg(F.count_if(bad).alias("_bad")).filter(f"_bad = 0 AND `{version}` IS NOT NULL").drop("_bad")
    kept = processed.join(done.select(*keys), list(keys), "left_anti")
    sinks.commit_state(kept.unionByName(done), path, run)
    return result


def outputs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The good rows of all committed runs."""
    folders = [f"{path}/{run}-output" for run in sinks.committed_versions(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
