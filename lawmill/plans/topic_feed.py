"""logs -> tags -> feed as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.records import canonical_classes, feed_description, feed_link, feed_title, guid
from lawmill.functions.times import parse_ts, rfc2822
from lawmill.operators.filters import has_tags
from lawmill.operators.joins import join_datasets
from lawmill.operators.latest import first_row, limit_per_key, top
from lawmill.operators.rules import RuleSet, default_rule_sets, filter_noise


def log_rows(logs: DataFrame, datasets: dict[str, DataFrame], joins: Sequence[str] = ("bill", "tags"), rule_sets: Mapping[str, RuleSet] | None = None,
             alias: str = "default", limit: int | None = None, strict_legacy: bool = False) -> DataFrame:
    """Logs with bill and tags, without noise, at most ``limit`` per state, newest first. Noise goes before the joins; its
    rules are those of the package unless others are given."""
    kept = filter_noise(logs, default_rule_sets() if rule_sets is None else rule_sets, alias=alias, strict_legacy=strict_legacy)
    if limit is not None:
        kept = limit_per_key(kept, ["state"], limit, F.desc_nulls_last("log_ts"), F.asc("path"))
    return join_datasets(kept, datasets, joins)


def select_default(rows: DataFrame) -> DataFrame:
    """id, log{action, bill_id}, bill{six fields}, tags, sources{log, bill}, timestamp, and the repository and first source of the bill."""
    bill = F.struct(*(F.col(f"bill.{n}").alias(n) for n in ("title", "abstracts", "subject", "identifier", "legislative_session", "from_organization")))
    sources = F.map_filter(F.create_map(F.lit("log"), F.col("path"), F.lit("bill"), F.col("bill.path")), lambda _, path: path.isNotNull())
    return rows.select(
        F.col("bill_id").alias("id"),
        F.struct(F.col("log.action").alias("action"), F.col("bill_id")).alias("log"),
        F.when(F.col("bill").isNotNull(), bill).alias("bill"),
        "tags",
        sources.alias("sources"),
        F.nullif(F.regexp_extract("path", r"([^/]+-legislation)/", 1), F.lit("")).alias("repo"),
        F.get("bill.sources", 0)["url"].alias("bill_url"),
        F.col("log_ts").alias("timestamp"),
    )


def feed(rows: DataFrame, names: Sequence[str] = (), limit: int | None = 100, base_url: Column | None = None) -> DataFrame:
    """Feed items: tagged rows, one per guid, newest first, the first ``limit``."""
    tagged = rows.filter(has_tags(F.col("tags"), names)).withColumn("guid", guid(F.element_at("sources", "log"), F.col("timestamp"), F.col("id")))
    one = first_row(tagged, ["guid"], F.struct("timestamp", "id"))
    picked = top(one, limit, F.desc_nulls_last("timestamp"), F.asc("guid"))
    no_base = F.lit(None).cast("string")
    return picked.select(
        feed_title(F.map_keys("tags"), F.col("repo"), F.col("bill.title"), F.col("id")).alias("title"),
        feed_description(F.col("id"), F.col("log.action"), F.col("log.bill_id"), F.col("bill"), canonical_classes(F.col("log.action"))).alias("description"),
        feed_link(no_base if base_url is None else base_url, F.element_at("sources", "bill"), F.col("bill_url")).alias("link"),
        rfc2822(parse_ts(F.col("timestamp"))).alias("pub_date"),
        "guid",
        F.monotonically_increasing_id().alias("order"),
    )
