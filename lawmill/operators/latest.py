"""Latest, first, best and ranked rows. Every choice has an explicit order, so shuffled input gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row of the largest order value per key, as an aggregate: one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def first_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row of the smallest order value per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def latest_row_asof(df: DataFrame, keys: Sequence[str], day: str, position: str, today: Column) -> DataFrame:
    """The latest row of each key not after today; of equal days the one of the smallest position."""
    rest = [c for c in df.columns if c not in keys]
    past = df.filter(F.col(day) <= today)
    return past.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(day, -F.col(position))).alias("_row")).select(*keys, "_row.*")


def latest_past_action(actions: Column, today: Column) -> Column:
    """The latest action not after today; of equal dates the first in the list."""
    dated = F.transform(actions, lambda a, i: F.struct(a["date"].alias("day"), (-i).alias("back")))
    best = F.array_max(F.filter(dated, lambda x: F.substring(x["day"], 1, 10) <= today))
    return F.get(actions, -best["back"])


def limit_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps at most n of a key per task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """Ordered rows, the first n or all."""
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


def rename_collisions(df: DataFrame, keys: Sequence[str], name: str, owner: str) -> DataFrame:
    """``name`` with the owner appended from the second holder of a name on."""
    rank = F.row_number().over(W.partitionBy(*keys, name).orderBy(owner))
    return df.withColumn(name, F.when(rank > 1, F.concat_ws("_", name, owner)).otherwise(F.col(name)))


def latest_runs(runs: DataFrame, keys: Sequence[str], run_id: str = "id", look_back: int = 3) -> DataFrame:
    """Per workflow: conclusion of the latest completed run among the last few, and the last success."""
    recent = runs.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(run_id)))).filter(F.col("_rank") <= look_back)
    done = F.col("status") == "completed"
    return recent.groupBy(*keys).agg(
        F.max_by(F.when(done, F.col("conclusion")), F.when(done, F.col(run_id))).alias("latest_conclusion"),
        F.max(F.when(done & (F.col("conclusion") == "success"), F.col("created_at"))).alias("last_success"),
    )


def ends(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Earliest and latest value per key by position."""
    return df.groupBy(*keys).agg(F.min_by(value, position).alias("earliest"), F.max_by(value, position).alias("latest"))


def sample_last_session(bills: DataFrame, n: int) -> DataFrame:
    """The first n bills of the lexicographically last session of each state."""
    last = bills.groupBy("state").agg(F.max("session_id").alias("session_id"))
    return limit_per_key(bills.join(last, ["state", "session_id"], "left_semi"), ["state"], n, F.col("bill_id"))


def sort_logs(logs: DataFrame, newest_first: bool = True, stamp: str = "log_ts", path: str = "path") -> DataFrame:
    """By stamp, unstamped last either way, then by path."""
    by = F.desc_nulls_last(stamp) if newest_first else F.asc_nulls_last(stamp)
    return logs.orderBy(by, F.asc(path))
