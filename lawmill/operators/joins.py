"""Joins between logs, bills, tags, sessions, events and state tables. All are equi joins unless said."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.operators.folding import running
from lawmill.session import materialise

BILL_KEY = ("state", "session_id", "bill_id")


def join_bills(logs: DataFrame, bills: DataFrame, keys: Sequence[str] = BILL_KEY, field: str | None = None) -> DataFrame:
    """Logs with ``bill``: the whole bill, or one dotted field of it; a missing bill keeps the log."""
    payload = F.struct(*(c for c in bills.columns if c not in keys)) if field is None else F.col(field)
    return logs.join(bills.select(*keys, payload.alias("bill")), list(keys), "left")


def join_tags(logs: DataFrame, tags: DataFrame, keys: Sequence[str] = BILL_KEY, score: str = "score") -> DataFrame:
    """Logs with ``tags``: map of tag to score; of repeated tags the highest score counts."""
    best = tags.groupBy(*keys, "tag").agg(F.max(score).alias("_score"))
    maps = best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "_score")))).alias("tags"))
    return logs.join(maps, list(keys), "left")


def join_datasets(logs: DataFrame, datasets: dict[str, DataFrame], joins: Sequence[str], keys: Sequence[str] = BILL_KEY) -> DataFrame:
    """Join specs ``bill``, ``bill.title``, ``tags``; an unknown data set is warned of and left out."""
    for spec in joins:
        name, _, field = spec.partition(".")
        if name not in datasets:
            warnings.warn(f"unknown dataset {name!r} is not joined", stacklevel=2)
            continue
        logs = join_tags(logs, datasets[name], keys) if name == "tags" else join_bills(logs, datasets[name], keys, field or None)
    return logs


def link_events(events: DataFrame, bills: DataFrame, state: str = "state") -> DataFrame:
    """(event_id, bill_id, session_id): the first bill of an event's agenda, by position, whose session is known."""
    items = events.select(state, "event_id", F.posexplode("agenda").alias("item", "entry"))
    refs = items.select(state, "event_id", "item", F.posexplode("entry.related_entities").alias("place", "entity"))
    named = refs.filter(F.col("entity.entity_type") == "bill").withColumn(
        "bill_id", F.replace(F.coalesce("entity.name", "entity.entity_id"), F.lit(" "), F.lit(""))
    )
    known = bills.groupBy(state, "bill_id").agg(F.max("session_id").alias("session_id"))
    return (
        named.join(known, [state, "bill_id"])
        .groupBy(state, "event_id")
        .agg(F.min_by(F.struct("bill_id", "session_id"), F.struct("item", "place")).alias("first"))
        .select(state, "event_id", "first.*")
    )


def first_match(refs: DataFrame, known: DataFrame, owner: str, key: str, position: str) -> DataFrame:
    """For each owner its first reference, by position, that is known."""
    return refs.join(known.select(key).distinct(), key, "left_semi").groupBy(owner).agg(F.min_by(key, position).alias(key))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key no existing row has; null parts of a key equal each other."""
    old = existing.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & incoming[k].eqNullSafe(old[f"_{k}"])
    return incoming.join(old, same, "left_anti")


def merge_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows, each replaced by the existing row of its key where there is one."""
    columns = [c for c in incoming.columns if c not in keys]
    old = existing.select(*keys, F.struct(*columns).alias("_old"))
    new = incoming.select(*keys, F.struct(*columns).alias("_new"))
    return new.join(old, list(keys), "left").select(*keys, F.coalesce("_old", "_new").alias("_row")).select(*keys, "_row.*")


def tags_or_keywords(bills: DataFrame, tags: DataFrame, keyword_tags: Column, keys: Sequence[str] = BILL_KEY) -> DataFrame:
    """Bills with ``tags``: the scored tags, or those by keywords where there are none."""
    scored = tags.groupBy(*keys).agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    none = F.array().cast("array<string>")
    out = bills.join(scored, list(keys), "left").withColumn("tags", F.when(F.size("_tags") > 0, F.col("_tags")).otherwise(F.coalesce(keyword_tags, none)))
    return out.drop("_tags")


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top, with the path itself."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def nearest_ancestor(items: DataFrame, owners: DataFrame, path: str, owner_path: str) -> DataFrame:
    """(path, owner): the deepest folder above each path that owners list. Longest-prefix join as explode and equi join."""
    above = items.select(path).distinct().withColumn("_up", F.explode(ancestors(F.col(path))))
    return (
        above.join(owners.select(F.col(owner_path).alias("_up")).distinct(), "_up", "left_semi")
        .groupBy(path)
        .agg(F.max_by("_up", F.length("_up")).alias("owner"))
    )


def same_title(bills: DataFrame, title: str, state: str, row_id: str) -> DataFrame:
    """Per title that several states use, its states and how many rows: the pairs' classes, not all pairs."""
    return (
        bills.groupBy(title)
        .agg(F.array_sort(F.collect_set(state)).alias("states"), F.count(F.lit(1)).alias("n_rows"), F.min(row_id).alias("first_row"))
        .filter(F.size("states") > 1)
    )


def same_title_pairs(bills: DataFrame, title: str, state: str) -> DataFrame:
    """(title, state_a, state_b) with state_a < state_b, once per title and pair of states."""
    one = bills.select(title, state).distinct()
    a, b = one.withColumnRenamed(state, "state_a"), one.withColumnRenamed(state, "state_b")
    return a.join(b, title).filter(F.col("state_a") < F.col("state_b"))


def merge_state(now: DataFrame, before: DataFrame, key: str, seen: str) -> DataFrame:
    """Orphan state: ``status`` new, continuing, resolved or untouched, with first and last seen and occurrences.

    ``now`` holds (key, seen, touched, orphan); ``before`` holds (key, first_seen, last_seen, occurrences).
    """
    both = now.join(before, key, "full_outer")
    orphan = F.coalesce(F.col("orphan"), F.lit(False))
    status = (
        F.when(orphan & F.col("occurrences").isNull(), "new")
        .when(orphan, "continuing")
        .when(F.col("occurrences").isNotNull() & F.col("orphan").isNotNull(), "resolved")
        .when(F.col("occurrences").isNotNull(), "untouched")
        .otherwise("fine")
    )
    return both.withColumn("status", status).select(
        key,
        "status",
        F.coalesce("first_seen", seen).alias("first_seen"),
        F.when(orphan, F.col(seen)).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("occurrences", F.lit(0)) + orphan.cast("int")).cast("bigint").alias("occurrences"),
    )


def in_session(rows: DataFrame, sessions: DataFrame, state: str, day: str, bin_days: int = 128) -> DataFrame:
    """Rows with the sessions of their state that hold their day: start <= day <= end or an open end.

    Sessions are cut to the days there are and filed in bins of ``bin_days``; a row looks in its day's bin only, so that
    neither a long list of sessions nor a state with most of the rows meets in one task. Rows without a day and sessions
    without a start join nothing."""
    number = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / bin_days)
    low, high = rows.agg(F.min(day), F.max(day)).first()
    kind = rows.schema[day].dataType
    first = F.greatest(F.col("start_date"), F.lit(low).cast(kind))
    last = F.least(F.coalesce(F.col("end_date"), F.lit(high).cast(kind)), F.lit(high).cast(kind))
    bins = F.sequence(number(first), number(last))
    filed = sessions.filter((F.col("start_date") <= F.lit(high).cast(kind)) & (first <= last)).withColumn("_bin", F.explode(bins))
    held = (F.col("start_date") <= F.col(day)) & (F.col("end_date").isNull() | (F.col(day) <= F.col("end_date")))
    return rows.withColumn("_bin", number(F.col(day))).join(filed, [state, "_bin"]).filter(held).drop("_bin")


def count_in_sessions(rows: DataFrame, sessions: DataFrame, state: str, day: str) -> DataFrame:
    """Sessions that hold some row of their state, with ``n``, the number of those rows, and ``first``, the first of their days.

    The same rows and sessions meet as in ``in_session``, but as sums: rows are folded by state and day, carried sums count those up to
    each day on which a session begins or ends, and the difference of two is a session's. So the work is in proportion to rows
    and sessions, not to their pairs. Days, begins and ends are dates."""
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    cells = rows.filter(F.col(day).isNotNull()).groupBy(F.col(state).alias("_state"), number(F.col(day)).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.filter(F.col("_state").isNotNull())
    begin, end = number(F.col("start_date")) - 1, F.coalesce(number(F.col("end_date")), F.lit(2**31 - 1))
    asked = sessions.filter(F.col("start_date").isNotNull() & F.col(state).isNotNull()).withColumns({"_begin": begin, "_end": end})
    points = asked.select(F.col(state).alias("_state"), F.explode(F.array("_begin", "_end")).alias("_at"), F.lit(0).cast("long").alias("_n"))
    folded = materialise(cells.unionByName(points).groupBy("_state", "_at").agg(F.sum("_n").alias("_n")))
    summed = running(folded, "_state", "_at", counts={"_sum": F.col("_n")})
    # the first day with rows behind a point: the reverse of a running last value
    turned = summed.withColumn("_back", -F.col("_at").cast("long"))
    known = running(turned, "_state", "_back", before={"_next": F.when(F.col("_n") > 0, F.col("_at"))})
    at = lambda name: known.select("_state", F.col("_at").alias(f"_{name}"), F.col("_sum").alias(f"_{name}_sum"), *([F.col("_next")] if name == "begin" else []))
    found = asked.withColumn("_state", F.col(state)).join(at("begin"), ["_state", "_begin"]).join(at("end"), ["_state", "_end"])
    counted = found.withColumns({"n": F.col("_end_sum") - F.col("_begin_sum"), "first": F.date_add(F.lit("1970-01-01").cast("date"), F.col("_next"))})
    return counted.filter("n > 0").select(*sessions.columns, "n", "first")


def overlapping(marks: DataFrame, chars: DataFrame, keys: Sequence[str], slack: float = 2.0, band: float | None = None) -> DataFrame:
    """Marks with ``hit``: whether some character of the same page overlaps it sideways and stands within ``slack`` of it.

    Equi join on the page and on bands of ``band`` units that both reach into, so that a full page isn't paired with
    itself; unless given, a band is twice as high as characters are on the average. Thin marks (narrower than 3, or than three times their height) never hit.
    """
    if band is None:
        band = 2 * max(1.0, float(chars.agg(F.avg(F.col("c_bottom") - F.col("c_top"))).first()[0] or 1.0))
    flat = (F.col("x1") - F.col("x0") >= 3) & (F.col("x1") - F.col("x0") >= 3 * (F.col("bottom") - F.col("top")))
    near = (F.col("c_x0") < F.col("x1")) & (F.col("c_x1") > F.col("x0")) & (F.col("c_top") - slack <= F.col("bottom")) & (F.col("c_bottom") + slack >= F.col("top"))

    def bands(top: Column, bottom: Column) -> Column:
        return F.explode(F.sequence(F.floor(top / band), F.floor(F.greatest(top, bottom) / band)))

    banded = marks.filter(flat).withColumn("_band", bands(F.col("top") - slack, F.col("bottom") + slack))
    placed = chars.withColumn("_band", bands(F.col("c_top"), F.col("c_bottom")))
    hits = banded.join(placed, [*keys, "_band"]).filter(near).select("mark_id").distinct().withColumn("_hit", F.lit(True))
    return marks.join(hits, "mark_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
