"""Folding routine lines of run logs into groups, without walking a run line by line.

What a line belongs to depends on the lines before it, back to the run's start. Here each such dependence is a join or a
sum, so that one run may be spread over many tasks:

* sums and last values up to a line are taken inside blocks of ``BLOCK`` lines and carried over blocks (``running``);
* where a group or a warning block would end, if it began at a line, is a pointer to a later line (a range search);
* the groups that do begin are those that the first one leads to along the pointers (``reachable``, by pointer doubling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawmill.functions.text import routine_line
from lawmill.session import materialise_unsized as materialise

BLOCK = 4096


def running(
    lines: DataFrame, key: str, order: str, counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None
) -> DataFrame:
    """``lines`` with, up to each line of its run: how often a condition held (``counts``), the last value that isn't null
    (``lasts``), or that value without the line itself (``before``). ``order`` numbers a run's lines."""
    counts, lasts, before = counts or {}, lasts or {}, before or {}
    values = {f"_v_{n}": c.cast("long") for n, c in counts.items()} | {f"_v_{n}": c for n, c in (lasts | before).items()}
    rows = lines.withColumn("_b", F.floor(F.col(order) / BLOCK)).withColumns(values)
    latest = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in lasts | before}
    totals = rows.groupBy(key, "_b").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in counts), *latest.values())
    blocks = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        key, "_b", *(F.sum(f"_t_{n}").over(blocks).alias(f"_t_{n}") for n in counts), *(F.last(f"_t_{n}", ignorenulls=True).over(blocks).alias(f"_t_{n}") for n in latest)
    )
    inside = W.partitionBy(key, "_b").orderBy(order)
    here, ahead = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    made = {n: F.coalesce(F.sum(f"_v_{n}").over(here), zero) + F.coalesce(f"_t_{n}", zero) for n in counts}
    made |= {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here if n in lasts else ahead), f"_t_{n}") for n in latest}
    return rows.join(carried, [key, "_b"]).withColumns(made).select(*lines.columns, *made)


def reachable(roots: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes (``keys``) that roots lead to along ``pointers`` (keys and ``to``), roots included, in as many rounds as the
    logarithm of the longest way: each round goes twice as far as the one before."""
    *same, node = keys
    found, jump = materialise(roots.select(*keys).distinct()), materialise(pointers.filter(F.col("to").isNotNull()).select(*keys, "to"))
    while True:
        more = materialise(found.join(jump, keys).select(*same, F.col("to").alias(node)).distinct().join(found, keys, "left_anti"))
        if more.isEmpty():
            return found
        found = materialise(found.unionByName(more))
        onward = jump.select(*same, F.col(node).alias("to"), F.col("to").alias("_to"))
        jump = materialise(jump.join(onward, [*same, "to"]).select(*keys, F.col("_to").alias("to")))


def _warning_lines(lines: DataFrame, key: str, block: int) -> DataFrame:
    """(key, _n) of the lines of all warning blocks: from the warning to a line indented by just two blanks, at most ``block``
    lines further; a warning inside a block begins none."""
    warning = F.col("kind") == "warning"
    starts = lines.filter(warning).select(key, "_n")
    tried = starts.select(key, "_n", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + block)).alias("stop"))
    ended = tried.join(lines.filter("ends").select(key, F.col("_n").alias("stop")), [key, "stop"]).groupBy(key, "_n").agg(F.min("stop").alias("stop"))
    blocks = materialise(starts.join(ended, [key, "_n"], "left").withColumn("stop", F.coalesce("stop", F.col("_n") + block)))
    # the first warning behind a block's last line: the reverse of a running last value
    turned = lines.select(key, "_n", (-F.col("_n")).alias("_m"), F.when(warning, F.col("_n")).alias("_w"))
    behind = running(turned, key, "_m", before={"to": F.col("_w")}).select(key, F.col("_n").alias("stop"), "to")
    pointers = blocks.join(behind, [key, "stop"]).select(key, "_n", "to")
    begun = reachable(starts.groupBy(key).agg(F.min("_n").alias("_n")), pointers, [key, "_n"])
    return begun.join(blocks, [key, "_n"]).select(key, F.explode(F.sequence("_n", "stop")).alias("_n"))


def _first_after(cells: DataFrame, probes: DataFrame, same: list[str], span: int) -> DataFrame:
    """``probes`` (same, start) with ``to``: the first line of their rising stretch whose time is ``span`` or more after start."""
    by = W.partitionBy(*same).orderBy("_at").rangeBetween(W.currentRow, W.unboundedFollowing)
    asked = probes.select(*same, (F.col("start") + span).alias("_at"), F.lit(None).cast("long").alias("_n"), "start")
    known = cells.select(*same, F.col("clock").alias("_at"), "_n", F.lit(None).cast("int").alias("start"))
    return known.unionByName(asked).withColumn("to", F.min("_n").over(by)).filter(F.col("start").isNotNull()).select(*same, "start", "to")


def _leave(cells: DataFrame, probes: DataFrame, island: list[str], span: int) -> DataFrame:
    """``probes`` (island, stretch, start) with ``to``: the first line from that stretch on whose time is before start or ``span``
    or more after it. Stretches that hold no such line are passed by doubling: tables of 1, 2, 4, ... stretches together."""
    runs = materialise(cells.groupBy(*island, "stretch").agg(F.min("clock").alias("low"), F.max("clock").alias("high"), F.min("_n").alias("head")))
    most = runs.groupBy(*island).agg((F.max("stretch") - F.min("stretch") + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    tables, size = [runs.select(*island, "stretch", "low", "high")], 1
    while 2 * size <= most:
        far = tables[-1].select(*island, (F.col("stretch") - size).alias("stretch"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        both = tables[-1].join(far, [*island, "stretch"])
        tables.append(materialise(both.select(*island, "stretch", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))))
        size *= 2
    at = probes.select(*island, F.col("stretch").alias("begin"), "start", "stretch").distinct()
    for table in reversed(tables):
        held = (F.col("low") >= F.col("start")) & (F.col("high") < F.col("start") + span)
        at = at.join(table, [*island, "stretch"], "left").withColumn("stretch", F.when(held, F.col("stretch") + size).otherwise(F.col("stretch"))).drop("low", "high")
        size //= 2
    at = materialise(at.join(runs, [*island, "stretch"]))
    same = [*island, "stretch"]
    late = _first_after(cells, at.filter("low >= start").select(*same, "start").distinct(), same, span)
    out = at.join(late, [*same, "start"], "left").withColumn("to", F.when(F.col("low") < F.col("start"), F.col("head")).otherwise(F.col("to")))
    return out.select(*island, F.col("begin").alias("stretch"), "start", "to")


def fold_routine(lines: DataFrame, key: str, order: str, line: str = "line", span: int = 300, block: int = 20) -> DataFrame:
    """``lines`` of each run with ``fold``: the place of the first line of their group, null outside of groups.

    A group holds routine lines and warning blocks that follow each other. A routine line starts a new group if its
    time of day is before the group's start or ``span`` seconds or more after it; a group that a warning opens starts at the
    time of the last routine line before it. A warning block runs from the warning to the line that is indented by just two
    blanks, at most ``block`` further lines.

    Defined results: a null line is no routine line; a run without lines has none; runs and places are not null, and places
    not repeated in a run; other columns are not read.
    """
    text = F.coalesce(line, F.lit(""))
    clock = F.substring(text, 1, 2).cast("int") * 3600 + F.substring(text, 4, 2).cast("int") * 60 + F.substring(text, 7, 2).cast("int")
    kind = routine_line(text)
    marked = lines.select(key, order, kind.alias("kind"), F.when(kind == "routine", clock).alias("clock"), text.rlike(r"^  [^ ]").alias("ends"))
    numbered = materialise(running(marked, key, order, counts={"_n": F.lit(1)}))
    if numbered.filter("kind = 'warning'").isEmpty():
        kinds = numbered
    else:
        covered = _warning_lines(numbered, key, block).withColumn("_in", F.lit(True))
        kinds = numbered.join(covered, [key, "_n"], "left").withColumn("kind", F.when(F.col("_in"), "warning").otherwise(F.col("kind"))).drop("_in")
        kinds = kinds.withColumn("clock", F.when(F.col("kind") == "routine", F.col("clock")))
    placed = running(kinds, key, "_n", counts={"island": F.col("kind") == "other"}, before={"past": F.col("clock")})
    # time goes on within a stretch
    placed = materialise(running(placed, key, "_n", counts={"stretch": F.coalesce(F.col("clock") < F.col("past"), F.lit(False))}))
    folded = placed.filter("kind <> 'other'")
    island = [key, "island"]
    # lines of one second of a stretch have one pointer; a group can begin at the first of them only
    cells = materialise(folded.filter("kind = 'routine'").groupBy(*island, "stretch", "clock").agg(F.min("_n").alias("_n")))
    opened = folded.groupBy(*island).agg(F.min("_n").alias("_n"), F.min_by(F.struct("kind", "past"), "_n").alias("f"))
    opened = materialise(opened.select(*island, "_n", F.when(F.col("f.kind") == "warning", F.coalesce("f.past", F.lit(-1))).alias("start")))
    same = [*island, "stretch"]
    later = W.partitionBy(*same).orderBy("clock").rangeBetween(span, W.unboundedFollowing)
    own = materialise(cells.withColumn("to", F.min("_n").over(later)).withColumnRenamed("clock", "start"))
    onward = own.filter(F.col("to").isNull()).select(*island, (F.col("stretch") + 1).alias("stretch"), "start", "_n")
    first = cells.groupBy(*island).agg(F.min("stretch").alias("stretch"))
    begun = opened.filter(F.col("start").isNotNull()).join(first, island).select(*island, "stretch", "start", "_n")
    asked = materialise(onward.unionByName(begun))
    left = asked.join(_leave(cells, asked, island, span), [*same, "start"]).select(*island, "_n", "to")
    pointers = own.filter(F.col("to").isNotNull()).select(*island, "_n", "to").unionByName(left)
    starts = reachable(opened, pointers, [*island, "_n"]).select(key, "_n", F.lit(True).alias("_start"))
    flagged = placed.join(starts, [key, "_n"], "left")
    named = running(flagged, key, "_n", lasts={"fold": F.when(F.col("_start"), F.col(order))})
    fold = F.when(F.col("kind") != "other", F.col("fold")).cast("long")
    return lines.select(key, order, line).join(named.select(key, order, fold.alias("fold")), [key, order])
