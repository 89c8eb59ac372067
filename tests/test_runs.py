"""Interval joins, evaluation grids, gated runs, shards and shipping beyond what the queries' tables hold."""

import datetime as dt
import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from lawmill import registry, sinks
from lawmill.operators import health, joins
from lawmill.plans import sweep
from lawmill.streaming import shipping
from lawmill.streaming import state as streams

DAY = dt.date(2020, 1, 1)


def test_in_session_against_all_pairs(spark):
    rng = random.Random(1)
    day = lambda n: DAY + dt.timedelta(days=n)
    sessions = [("a" if k % 3 else "b", k, day(rng.randrange(-900, 900)) if k % 19 else None, None if k % 7 == 0 else day(rng.randrange(-900, 1500))) for k in range(80)]
    sessions += [("a", 900, dt.date(1, 1, 1), dt.date(9999, 12, 31)), ("c", 901, DAY, None)]
    rows = [("a" if k % 2 else "b", k, day(rng.randrange(0, 600)) if k % 11 else None) for k in range(300)] + [("zz", 999, DAY)]
    found = joins.in_session(spark.createDataFrame(rows, "state string, row int, day date"), spark.createDataFrame(sessions, "state string, session int, start_date date, end_date date"), "state", "day")
    want = {(r, s) for st, r, d in rows for state, s, a, b in sessions if d and a and st == state and a <= d and (b is None or d <= b)}
    assert {(r["row"], r["session"]) for r in found.collect()} == want and found.count() == len(want) > 1000
    none = spark.createDataFrame([], "state string, row int, day date")
    assert joins.in_session(none, spark.createDataFrame(sessions, "state string, session int, start_date date, end_date date"), "state", "day").count() == 0


def test_counts_in_sessions_against_all_pairs(spark):
    rng = random.Random(4)
    day = lambda n: DAY + dt.timedelta(days=n)
    sessions = [(None if k % 23 == 0 else "a" if k % 3 else "b", k, day(rng.randrange(-900, 900)) if k % 19 else None, None if k % 7 == 0 else day(rng.randrange(-900, 1500))) for k in range(120)]
    sessions += [("a", 900, dt.date(1, 1, 1), dt.date(9999, 12, 31)), ("c", 901, DAY, None), ("a", 902, day(5), day(5)), ("a", 902, day(5), day(5)), ("d", 903, day(40), day(40)), ("d", 904, day(41), None)]
    rows = [(None if k % 29 == 0 else "a" if k % 2 else "b", day(rng.randrange(0, 600)) if k % 11 else None) for k in range(300)] + [("zz", DAY), ("a", day(5)), ("d", day(40)), ("d", day(40))]
    made = spark.createDataFrame(rows, "state string, day date"), spark.createDataFrame(sessions, "state string, session int, start_date date, end_date date")
    found = joins.count_in_sessions(*made, "state", "day").select("session", "n", "first").collect()
    want = []
    for state, session, a, b in sessions:
        held = [d for st, d in rows if st and st == state and d and a and a <= d and (b is None or d <= b)]
        want += [(session, len(held), min(held))] if held else []
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 50
    assert joins.count_in_sessions(made[0].limit(0), made[1], "state", "day").count() == 0


def _joined(plan):
    """Rows that each join of an executed plan has made."""
    if "Join" in plan.nodeName():
        yield plan.metrics().get("numOutputRows").get().value()
    inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else None
    for k in range(plan.children().size()):
        yield from _joined(plan.children().apply(k))
    if inner is not None:
        yield from _joined(inner)


def test_sessions_and_orders_are_not_paired(spark, tmp_path):
    """A thousand sessions that all hold ten thousand orders: no join makes rows by their product."""
    spark.range(1000).selectExpr("id * 2400 AS c_custkey", "1 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(10_000).selectExpr("id * 3 AS o_custkey", "TIMESTAMP_NTZ '1992-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.all_queries()["sessions_of_orders"](spark, str(tmp_path))
    got = [(r["n"], r["first"]) for r in found.collect()]
    made = list(_joined(found._jdf.queryExecution().executedPlan()))
    assert got == [(10_000, "1992-01-01")] * 1000 and made and max(made) <= 1000


def test_grid_against_every_evaluation(spark):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    samples = [(s, base + dt.timedelta(seconds=rng.randrange(0, 40_000)), rng.random() if k % 9 else None) for s in "abc" for k in range(30)] + [("d", base + dt.timedelta(seconds=600), 1.0), ("e", base + dt.timedelta(days=30), 1.0)]
    until = base + dt.timedelta(seconds=45_123)
    grid = health.on_grid(spark.createDataFrame(samples, "series string, ts timestamp_ntz, value double"), ["series"], F.lit(until), 300, 2000)
    states = {(r["series"], r["at"]): (r["value"], r["state"]) for r in health.alert_states(grid, ["series"], F.col("value") > 0.4, 900).collect()}
    start, want = int((base - dt.datetime(1970, 1, 1)).total_seconds()), {}
    for s in "abcde":
        since = None
        for at in range(start, start + 45_123 + 1, 300):
            seen = [(t, v) for n, ts, v in samples if n == s and v is not None and (t := int((ts - dt.datetime(1970, 1, 1)).total_seconds())) <= at and at - t < 2000]
            value = max(seen)[1] if seen else None
            since = (at if since is None else since) if value is not None and value > 0.4 else None
            if seen:
                want[s, at] = (value, "normal" if since is None else "firing" if at - since >= 900 else "pending")
    assert states == want and {x for _, x in want.values()} == {"normal", "pending", "firing"}


def test_force_and_unversioned_inputs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", None)], "key string, version string")
    fine = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    path = str(tmp_path / "runs")
    results = [tuple(sweep.run_gated(rows, path, name, ["key"], fine, force=force).select("run", "status", "total", "failed").first()) for name, force in (("1", False), ("2", False), ("3", True), ("3", True))]
    assert results == [("1", "ok", 2, 0), ("2", "ok", 1, 0), ("3", "ok", 2, 0), ("3", "ok", 2, 0)]
    assert sweep.outputs(spark, path, "key string, version string").count() == 5
    all_bad = sweep.run_gated(rows, path, "4", ["key"], lambda df: df.withColumn("error", F.lit("x")), force=True).first()
    assert (all_bad["status"], sweep.outputs(spark, path, "key string, version string").count()) == ("failed", 5)


@pytest.mark.parametrize("limit", [1, 200, 10**9])
def test_shards_joined_are_the_sorted_list(spark, tmp_path, limit):
    rng = random.Random(limit)
    bills = [(f"id{k:03d}", rng.choice(["ak", "wy", None, "é"]), rng.choice(["1", "2"]), ["t"] * (k % 4)) for k in range(150)]
    files, manifest = sinks.dashboard_shards(spark.createDataFrame(bills, "id string, state string, session string, tags array<string>").repartition(5), limit)
    sinks.write_tree(files, str(tmp_path))
    listed = manifest.orderBy("shard").collect()
    parts = [(tmp_path / r["path"]).read_text() for r in listed]
    assert [len(p.encode()) for p in parts] == [r["bytes"] for r in listed] and [len(json.loads(p)) for p in parts] == [r["n_bills"] for r in listed]
    found = [b["id"] for p in parts for b in json.loads(p)]
    assert found == [b[0] for b in sorted(bills, key=lambda b: (b[1] or "", b[2], b[0]))]
    assert all(r["bytes"] < limit + 300 for r in listed) and len(listed) == {1: 150, 10**9: 1}.get(limit, len(listed))
    assert sinks.dashboard_shards(spark.createDataFrame([], "id string, state string, session string, tags array<string>"))[1].count() == 0


def test_a_batch_run_again_sends_nothing_twice(spark, tmp_path):
    path, sent = str(tmp_path / "state"), []

    def send(rows):
        sent.extend(sorted((r["key"], r["n"], r["batch"]) for r in rows.collect()))
        return rows.filter("key <> 'b'")

    batch = lambda *rows: spark.createDataFrame(rows, "key string, n long")
    commit = sinks.commit_state
    try:
        sinks.commit_state = lambda *_: (_ for _ in ()).throw(RuntimeError("killed before the commit"))
        with pytest.raises(RuntimeError):
            shipping.ship_batch(batch(("a", 1), ("b", 1)), 0, ["key"], "n", send, path)
    finally:
        sinks.commit_state = commit
    for number, rows in ((0, [("a", 1), ("b", 1)]), (0, [("a", 1), ("b", 1)]), (1, [("a", 1), ("a", 2), ("b", 2)])):
        shipping.ship_batch(batch(*rows), number, ["key"], "n", send, path)
    assert sent == [("a", 1, 0), ("b", 1, 0), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1)]
    marks, outbox = shipping.shipped_state(spark, path, "key string, watermark long", "key string, n long")
    assert [tuple(r) for r in marks.collect()] == [("a", 2)] and sorted(tuple(r) for r in outbox.collect()) == [("b", 1), ("b", 2)]


def test_silence_by_batch_equals_the_stream_rule(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    beats = spark.createDataFrame([("a", at(0)), ("a", at(7)), ("a", at(8)), ("b", at(20)), ("c", at(14))], "key string, at timestamp")
    got = sorted((r["key"], r["at"], r["state"]) for r in streams.silences(beats, 6).collect())
    assert got == [("a", at(6), "dead"), ("a", at(7), "back"), ("a", at(14), "dead"), ("c", at(20), "dead")]


def test_unknown_dataset_is_warned_of(spark):
    logs = spark.createDataFrame([(1,)], "bill_id int")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert joins.join_datasets(logs, {}, ["nothing.title"], ["bill_id"]).count() == 1
    assert any("nothing" in str(w.message) for w in caught)
