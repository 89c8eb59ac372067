"""Run logs: noise, stamps, tails, islands, digests and failure classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawmill.functions.text import log_noise

#: Failure codes in the order they are tried, with the pattern that a log must show. Fixed values.
FAILURES = (
    ("N1_ACTIVE_BLOCK", r"ConnectionRefusedError|Errno 111"),
    ("N3_ACTIVE_BLOCK", r"ConnectionResetError"),
    ("H1_ACTIVE_BLOCK", r"403.*(Forbidden|forbidden)|Forbidden.*403"),
    ("N4_DNS_FAILURE", r"Name or service not known|nodename nor servname provided|EAI_NONAME"),
    ("H3_RATE_LIMITED", r"(?:^|[^0-9])429(?:[^0-9]|$)|Too Many Requests"),
    ("N2_CONNECTIVITY", r"TimeoutError|ConnectTimeoutError|timed out|Errno 110|RemoteDisconnected|Connection aborted"),
    ("H4_SERVER_DOWN", r"(?:^|[^0-9])503(?:[^0-9]|$)|Service Unavailable"),
    ("S6_VALIDATION", r"ScrapeValueError|validation.*failed|failed.*validation"),
    ("H2_AUTH_FAILURE", r"401|Unauthorized"),
    ("S1_OUT_OF_SESSION", r"no objects returned"),
    ("S2_OUT_OF_SESSION", r"contains no matching files"),
    ("S3_SESSION_CONFIG", r"AssertionError.*[Ss]ession"),
    ("S4_SITE_STRUCTURE", r"KeyError"),
    ("S5_SITE_STRUCTURE", r"ValueError|IndexError"),
)
ACTIVE_BLOCKS = ("N1_ACTIVE_BLOCK", "N3_ACTIVE_BLOCK", "H1_ACTIVE_BLOCK", "N4_DNS_FAILURE")
TAIL_BYTES = 256 * 1024


def without_noise(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.filter(~log_noise(F.col(line)))


def fill_stamps(lines: DataFrame, keys: Sequence[str], order: str, ts: str, fallback: Column) -> DataFrame:
    """A line without a stamp takes the last one before it, else the fallback."""
    seen = F.last(ts, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn(ts, F.coalesce(seen, fallback))


def tail(lines: DataFrame, keys: Sequence[str], order: str, n: int = 100) -> DataFrame:
    """The last n lines of each run."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return lines.withColumn("_back", rank).filter(F.col("_back") <= n).drop("_back")


def byte_tail(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line", limit: int = TAIL_BYTES) -> DataFrame:
    """The longest end of each run whose lines and line ends fit the limit, at least one line, with ``dropped``: how
    many lines of the run are left out."""
    back = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    all_rows = W.partitionBy(*keys)
    sized = lines.withColumn("_sum", F.sum(F.octet_length(line) + 1).over(back)).withColumn("_back", F.count(F.lit(1)).over(back))
    kept = (F.col("_sum") <= limit) | (F.col("_back") == 1)
    return sized.withColumn("dropped", F.count_if(~kept).over(all_rows)).filter(kept).drop("_sum", "_back")


def contiguous_prefix(runs: DataFrame, keys: Sequence[str], run_id: str, ok: Column) -> DataFrame:
    """Runs in id order up to the first that is not ok."""
    fine = F.bool_and(ok).over(W.partitionBy(*keys).orderBy(run_id).rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("_fine", fine).filter("_fine").drop("_fine")


def collection_stamps(lines: DataFrame, keys: Sequence[str], order: Sequence[str], now_ns: Column) -> DataFrame:
    """Nanosecond stamps from now on, one apart in event order; the event time stays as it is."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return lines.withColumn("collected_ns", now_ns + rank - 1)


def islands(lines: DataFrame, keys: Sequence[str], order: str, kind: str) -> DataFrame:
    """Runs of consecutive lines of one kind: an island's number, first and last place and size."""
    by = W.partitionBy(*keys).orderBy(order)
    starts = (~F.col(kind).eqNullSafe(F.lag(kind).over(by))).cast("int")
    numbered = lines.withColumn("island", F.sum(starts).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(
        F.first(kind).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_lines")
    )


def failure_class(lines: DataFrame, keys: Sequence[str], line: str = "line", exit_code: str = "exit_code", shrunk: str | None = None) -> DataFrame:
    """The first failure code, in order, that a run's log shows; NONE for exit code 0."""
    flags = [F.bool_or(F.col(line).rlike(pattern)).alias(f"_{code}") for code, pattern in FAILURES]
    over = [F.bool_or(shrunk).alias("_shrunk")] if shrunk else []
    seen = lines.groupBy(*keys).agg(F.max(exit_code).alias("_exit"), *over, *flags)
    code = F.when(F.col("_shrunk"), "P1_SHRINKING_OUTPUT").when(F.col("_exit") == 0, "NONE") if shrunk else F.when(F.col("_exit") == 0, "NONE")
    for name, _ in FAILURES:
        code = code.when(F.col(f"_{name}"), name)
    out = seen.withColumn("failure_class", code.otherwise("UNKNOWN"))
    return out.select(*keys, "failure_class", F.col("failure_class").isin(*ACTIVE_BLOCKS).alias("is_active_block"))


def error_digest(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line", n: int = 10, context: int = 10, traceback_lines: int = 30) -> DataFrame:
    """The error lines of each run with their ``rank``: tracebacks with the lines after them (1), if there are none
    exceptions (2), else other errors (3); retried and informational lines don't count. Skipped items: ``skipped_items``."""
    text = F.col(line)
    by = W.partitionBy(*keys).orderBy(order)
    place = F.row_number().over(by)
    start = F.last(F.when(text.startswith("Traceback (most recent call last):"), F.col("_place")), ignorenulls=True).over(by)
    settled = text.rlike(r"retry|retrying|resolved|recovered|succeeded after")
    other = text.rlike(r"ERROR|EXCEPTION|TRACEBACK|AssertionError|TimeoutError|ConnectionError|HTTPError")
    noise = text.rlike(r"(?i) INFO |scrape attempt|retry|retrying|resolved|recovered|succeeded|SKIPPED BILL")
    rank = (
        F.when(F.col("_place") - F.col("_start") <= context, 1)
        .when(text.rlike(r"(?i)^\w+(?:Error|Exception|Warning):") & ~settled, 2)
        .when(other & ~noise, 3)
    )
    ranked = lines.withColumn("_place", place).withColumn("_start", start).withColumn("rank", rank).filter(F.col("rank").isNotNull())
    best = ranked.withColumn("_best", F.min("rank").over(W.partitionBy(*keys))).filter(F.col("rank") == F.col("_best"))
    limit = F.when(F.col("rank") == 1, traceback_lines).otherwise(n)
    return best.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= limit).drop("_place", "_best", "_start")


def skipped_items(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """How many items each run says it skipped."""
    return lines.filter(F.col(line).contains("SKIPPED BILL:")).groupBy(*keys).agg(F.count(F.lit(1)).alias("skipped"))


def counters(lines: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], line: str = "line") -> DataFrame:
    """The last ``name: N`` of each name in a run's log."""
    found = []
    for name in names:
        value = F.nullif(F.regexp_extract(line, rf"\b{name}: (\d+)", 1), F.lit("")).cast("bigint")
        found.append(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name))
    return lines.groupBy(*keys).agg(*found)


def select_runs(runs: DataFrame, watermarks: DataFrame, keys: Sequence[str], now: Column, hours: int = 24) -> DataFrame:
    """Runs after their workflow's watermark and created within the look-back."""
    out = runs.join(watermarks, list(keys), "left")
    recent = F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    return out.filter((F.col("id") > F.coalesce("watermark", F.lit(0))) & recent)
