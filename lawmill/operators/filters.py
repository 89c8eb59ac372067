"""Predicates and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lawmill.session import small


def has_tags(tags: Column, names: Sequence[str] = ()) -> Column:
    """The tag map has an entry and, if names are given, one of them."""
    some = F.coalesce(F.size(tags) > 0, F.lit(False))
    return some & F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, names))) if names else some


def require(df: DataFrame, fields: Sequence[str], category: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): rows whose named fields are all present and non-empty, and the others with their category."""
    ok = F.lit(True)
    for name in fields:
        ok = ok & F.col(name).isNotNull() & (F.col(name).cast("string") != "")
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), n) for n in fields))), ",")
    return df.filter(ok), df.filter(~ok).withColumn("category", F.lit(category)).withColumn("missing", missing)


def session_gate(
    df: DataFrame, sessions: DataFrame, keys: Sequence[str] = ("state", "session_id"), expected: Column | None = None, broadcast_rows: int = 100_000
) -> DataFrame:
    """``df`` with ``gate``: ok, missing_session, unknown_session, and wrong_session for a known one other than the
    ``expected`` (where that isn't null). Sessions are a dimension; the hint is given under a counted size."""
    known = small(sessions.select(*keys).distinct().withColumn("_known", F.lit(True)), broadcast_rows)
    gated = df.join(known, list(keys), "left")
    gate = F.when(F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == "", "missing_session").when(F.col("_known").isNull(), "unknown_session")
    if expected is not None:
        gate = gate.when(F.col(keys[-1]) != expected, "wrong_session")
    gate = gate.otherwise("ok")
    return gated.withColumn("gate", gate).drop("_known")


def newer_than(df: DataFrame, cursors: DataFrame, category: str, ts: str, observation: Observation | None = None) -> DataFrame:
    """Rows strictly after their category's cursor; without a cursor all rows with a time pass.

    An observation counts all ``rows`` and the ``dropped`` ones as the result is computed."""
    out = df.join(cursors.select(F.col("category").alias(category), F.col("cursor").alias("_cursor")), category, "left")
    fresh = F.coalesce(F.col(ts) > F.coalesce(F.col("_cursor"), F.lit("1900-01-01").cast("timestamp_ntz")), F.lit(False))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if(~fresh).alias("dropped"))
    return out.filter(fresh).drop("_cursor")


#: Quarantine category of a row without a date, by what it is. Fixed values.
UNDATED = {"events": "from_is_newer_than_latest_missing_event_date", "vote_events": "from_is_newer_than_latest_missing_vote_date"}
UNDATED_OTHER = "from_is_newer_than_latest_unknown_category"


def undated(df: DataFrame, kind: str, ts: str) -> DataFrame:
    """Rows that ``newer_than`` can't compare: those without a time, or of a kind that has none, with their quarantine ``category``."""
    category = F.lit(UNDATED_OTHER)
    for name, value in UNDATED.items():
        category = F.when(F.col(kind) == name, value).otherwise(category)
    return df.filter(F.col(ts).isNull() | ~F.coalesce(F.col(kind).isin(*UNDATED), F.lit(False))).withColumn("category", category)


def changed_by_count(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], n_actions: Column | None = None) -> DataFrame:
    """New bills and bills whose number of actions differs from the stored one; both sides hold the list ``actions`` or ``n_actions``."""
    n = F.size("actions") if n_actions is None else n_actions
    now, old = incoming.withColumn("_has", n), stored.select(*keys, n.alias("_had"))
    return now.join(old, list(keys), "left").filter(F.col("_had").isNull() | (F.col("_has") != F.col("_had"))).drop("_has", "_had")


def changed_by_hash(incoming: DataFrame, ledger: DataFrame, keys: Sequence[str], content_hash: str = "content_hash") -> DataFrame:
    """Rows that the ledger lacks or has with another hash."""
    old = ledger.select(*keys, F.col(content_hash).alias("_old"), F.lit(True).alias("_there"))
    out = incoming.join(old, list(keys), "left")
    return out.filter(F.col("_there").isNull() | ~F.col(content_hash).eqNullSafe(F.col("_old"))).drop("_old", "_there")


def past_actions(actions: Column, today: Column) -> Column:
    return F.filter(actions, lambda a: F.substring(a["date"], 1, 10) <= today)


def looks_like_bill(identifier: Column, title: Column, jurisdiction: Column) -> Column:
    return (F.coalesce(identifier, F.lit("")) != "") & title.isNotNull() & jurisdiction.isNotNull()


def pick_repos(df: DataFrame, wanted: str | Sequence[str] = "all", column: str = "repo") -> DataFrame:
    """``all``, a list, or a comma list of repositories."""
    if wanted == "all":
        return df
    names = [x.strip() for x in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    return df.filter(F.col(column).isin([n for n in names if n]))


def needs_extraction(today: Column, updated: Column, extracted: Column, has_text: Column, unavailable_at: Column, recheck_days: int = 15) -> Column:
    """Whether a bill's text must be fetched. An unavailable one is tried again once it changed or the days are over;
    any other if it was never read, changed since, or has no text."""
    changed_while_away = F.coalesce(updated > unavailable_at, F.lit(False))
    again = changed_while_away | (F.datediff(today, unavailable_at) >= recheck_days)
    current = has_text & extracted.isNotNull() & ~F.coalesce(updated > extracted, F.lit(False))
    return F.when(unavailable_at.isNotNull(), again).otherwise(~F.coalesce(current, F.lit(False)))


def bad_label(value: Column) -> Column:
    return value.rlike(r"[\r\n]")


def slice_rows(df: DataFrame, state=None, session=None, chamber=None, topic=None, text: str | None = None) -> DataFrame:
    """One slice for all facets of the dashboard."""
    for name, value in (("state", state), ("session", session), ("chamber", chamber)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    if topic is not None:
        df = df.filter(F.array_contains("tags", topic))
    return df.filter(F.col("title").ilike(f"%{text}%")) if text else df


def match_labels(df: DataFrame, **patterns: str) -> DataFrame:
    """Rows whose labels match all patterns in full, as series matchers do."""
    for label, pattern in patterns.items():
        df = df.filter(F.col(label).rlike(f"^(?:{pattern})$"))
    return df


def check_tag(tag_defs: DataFrame, name: str) -> str:
    """The name, or an error if no definition has it."""
    if not tag_defs.filter(F.col("name") == name).limit(1).count():
        raise ValueError(f"unknown tag {name!r}")
    return name
