"""Raw objects to normalised tables, for all states in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.keys import bill_id
from lawmill.operators.filters import changed_by_count, changed_by_hash, require, session_gate
from lawmill.operators.joins import link_events, merge_state
from lawmill.functions.records import content_hash

KEYS = ("state", "session_id", "bill_id")


def normalise_bills(
    raw: DataFrame, sessions: DataFrame, stored: DataFrame | None = None, mode: str = "count", expected_session: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) bills; with stored bills only new and changed ones, by action count or by content."""
    good, missing = require(raw, ["identifier", "title", "session_id"], "bill_missing_fields")
    gated = session_gate(good.withColumn("bill_id", bill_id(F.col("identifier"))), sessions, expected=expected_session)
    bad = gated.filter(F.col("gate") != "ok").withColumn("category", F.col("gate")).drop("gate")
    kept = gated.filter(F.col("gate") == "ok").drop("gate")
    if stored is not None:
        if mode == "count":
            kept = changed_by_count(kept, stored, KEYS)
        else:
            now, before = (df.withColumn("content_hash", content_hash("title", "actions", schema=df.schema)) for df in (kept, stored))
            kept = changed_by_hash(now, before, KEYS).drop("content_hash")
    return kept, missing.unionByName(bad, allowMissingColumns=True)


def bill_sessions(bills: DataFrame) -> DataFrame:
    """(state, bill_id, session_id): the latest session of each bill."""
    return bills.groupBy("state", "bill_id").agg(F.max("session_id").alias("session_id"))


def orphans(votes: DataFrame, events: DataFrame, bills: DataFrame) -> DataFrame:
    """Bills that votes or linked events name and that aren't stored, with counts of both."""
    refs = votes.select(*KEYS, F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(events.select(*KEYS, F.lit(0).alias("v"), F.lit(1).alias("e")))
    return refs.groupBy(*KEYS).agg(F.sum("v").alias("votes"), F.sum("e").alias("events")).join(bills.select(*KEYS), list(KEYS), "left_anti")


def track_orphans(now: DataFrame, before: DataFrame, key: str = "bill_key", seen: str = "seen_at") -> DataFrame:
    return merge_state(now, before, key, seen)


def linked_events(events: DataFrame, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked, unlinked) events."""
    links = link_events(events, bills)
    return links, events.join(links.select("state", "event_id"), ["state", "event_id"], "left_anti")
