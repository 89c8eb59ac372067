import random

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from lawmill import registry
from lawmill.functions import records
from lawmill.operators import documents, folding, health, joins, latest, quality, runlogs, tagging
from lawmill.plans import sweep


def shuffled(spark, rows, schema, seed):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_wins_whatever_the_order(spark, seed):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), ("b", 3, "w"), (None, 1, "n")]
    df = shuffled(spark, rows, "k string, pos int, v string", seed)
    assert {r["k"]: r["v"] for r in latest.first_row(df, ["k"], F.col("pos")).collect()} == {"a": "x", "b": "w", None: "n"}
    assert {r["k"]: r["v"] for r in latest.best_row(df, ["k"], F.col("pos")).collect()} == {"a": "y", "b": "z", None: "n"}
    named = latest.rename_collisions(shuffled(spark, [("s", "f", "b1"), ("s", "f", "b2")], "s string, f string, b string", seed), ["s"], "f", "b")
    assert sorted(r["f"] for r in named.collect()) == ["f", "f_b2"]


def test_latest_past_action_ties_keep_the_first(spark):
    df = spark.sql("SELECT array(named_struct('date','2024-01-02','n',1), named_struct('date','2024-01-02T09','n',2), named_struct('date','2030-01-01','n',3)) AS a, array() AS e")
    got = df.select(latest.latest_past_action(F.col("a"), F.lit("2024-12-31"))["n"].alias("n")).collect()
    assert got[0]["n"] == 2
    tied = spark.sql("SELECT array(named_struct('date','2024-01-02','n',1), named_struct('date','2024-01-02','n',2)) AS a")
    assert tied.select(latest.latest_past_action(F.col("a"), F.lit("2024-12-31"))["n"].alias("n")).collect()[0]["n"] == 1


def test_byte_tail_keeps_one_line_and_counts(spark):
    df = spark.createDataFrame([("r", i, "x" * n) for i, n in enumerate([10, 10, 100])] + [("s", 0, "y" * 500)], "run string, i int, line string")
    out = {(r["run"], r["i"]): r["dropped"] for r in runlogs.byte_tail(df, ["run"], "i", limit=112).collect()}
    assert out == {("r", 1): 1, ("r", 2): 1, ("s", 0): 0}


def test_fold_counts_from_the_islands_start(spark):
    at = lambda s: f"10:{s // 60:02d}:{s % 60:02d} INFO x"
    lines = [at(0), at(200), at(300), at(599), "/a/b.py:3: FutureWarning: old", "    more", "  last()", at(600), at(550), "Traceback", at(560), "other"]
    rows = [("r", i, line) for i, line in enumerate(lines)]
    out = folding.fold_routine(spark.createDataFrame(rows, "run string, i int, line string").repartition(3), "run", "i").orderBy("i").collect()
    assert [r["fold"] for r in out] == [0, 0, 2, 2, 2, 2, 2, 7, 8, None, 10, None]


def test_failure_order(spark):
    df = spark.createDataFrame([("a", "KeyError", 1), ("a", "ConnectionResetError", 1), ("b", "fine", 0), ("c", "code 1503x", 1), ("d", "HTTP 503 now", 1)], "k string, line string, exit_code int")
    got = {r["k"]: (r["failure_class"], r["is_active_block"]) for r in runlogs.failure_class(df, ["k"]).collect()}
    assert got == {"a": ("N3_ACTIVE_BLOCK", True), "b": ("NONE", False), "c": ("UNKNOWN", False), "d": ("H4_SERVER_DOWN", False)}


def test_keyword_rules(spark):
    df = spark.sql("SELECT 'Clean Energy and LGBTQ+ rights' AS t, array('lgbtq', 'clean energy', 'right', 'c++') AS k")
    assert df.select(tagging.match_keywords(F.col("t"), F.col("k")).alias("m")).collect()[0]["m"] == ["lgbtq", "clean energy"]
    assert df.select(tagging.dashboard_keywords(F.col("t"), ["energy  and"]).alias("m")).collect()[0]["m"] is True


def test_score_falls_back_to_keywords(spark):
    texts = spark.createDataFrame([(1, "solar power", [1.0, 0.0]), (2, "solar power", None), (3, "none", [0.0, 1.0])], "id int, text string, vector array<float>")
    defs = tagging.tag_defs(spark, {"energy": {"include_keywords": ["solar"], "threshold": 0.5}})
    defs = defs.withColumn("base_vector", F.array(F.lit(1.0), F.lit(0.0))).withColumn("example_vectors", F.array(F.array(F.lit(1.0), F.lit(0.0)))).withColumn("negative_vectors", F.array().cast("array<array<double>>"))
    got = {r["id"]: round(r["score"], 4) for r in tagging.score_tags(texts, defs).collect()}
    assert got == {1: 1.0, 2: 0.6}
    vectors = tagging.embed(texts.select("id", "text"), "text", lambda xs: [[float(len(x)), 1.0] for x in xs])
    assert {r["id"]: r["vector"] for r in vectors.collect()}[3] == [4.0, 1.0]


def test_extract_takes_the_first_usable(spark):
    links = spark.createDataFrame([("b", "v1", "u1", "text/html", 0), ("b", "v1", "u2", "application/pdf", 1), ("b", "v1", "u3", "text/html", 2), ("c", "v1", "u4", "text/html", 0)], "bill_id string, note string, url string, media_type string, position int")
    fetched = spark.createDataFrame([("u1", "<p>enable javascript</p>"), ("u2", "pdf text")], "url string, content string")
    got = {r["bill_id"]: (r["url"], r["reason"], r["tried"]) for r in documents.extract(documents.candidates(links), fetched).collect()}
    assert got == {"b": ("u2", None, 2), "c": (None, "download_failed", 1)}


def test_events_link_to_the_first_known_bill(spark):
    kind = "array<struct<related_entities:array<struct<entity_type:string,entity_id:string,name:string>>>>"
    events = spark.createDataFrame([("wy", "e1", [([("bill", None, "HB 9"), ("bill", None, "HB 1")],), ([("bill", None, "HB 2")],)]), ("wy", "e2", [])], f"state string, event_id string, agenda {kind}")
    bills = spark.createDataFrame([("wy", "HB1", "2024"), ("wy", "HB1", "2025"), ("wy", "HB2", "2025")], "state string, bill_id string, session_id string")
    assert [tuple(r) for r in joins.link_events(events, bills).collect()] == [("wy", "e1", "HB1", "2025")]


def test_coverage_gap_is_silent_without_heartbeat(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    rows = spark.sql("SELECT * FROM VALUES ('wy', 'a', TIMESTAMP_NTZ '2024-01-01 23:00:00'), ('wy', 'b', TIMESTAMP_NTZ '2024-01-01 02:00:00') AS t(state, repo, ts)")
    assert health.coverage_gap(rows, ["state"], "repo", now, F.lit(True)).collect()[0]["gap"] == 1
    assert health.coverage_gap(rows, ["state"], "repo", now, F.lit(False)).count() == 0


def _events(tmp_path, rows):
    """A folder with these events (ts, user_id, event_type, value) and DuckDB's view of them."""
    import duckdb

    listed = ", ".join(f"({k}::BIGINT, TIMESTAMP '{ts}', {user}::BIGINT, '{kind}', {'NULL' if value is None else value}::DOUBLE)" for k, (ts, user, kind, value) in enumerate(rows))
    connection = duckdb.connect()
    connection.sql(f"COPY (SELECT * FROM (VALUES {listed}) t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    return connection


LATE = [
    ("2024-01-30 11:59:59.2", 1, "click", 10.0), ("2024-01-30 12:00:00.4", 1, "click", 70.0),  # less than a second after the evaluation
    ("2024-01-30 12:00:00", 2, "click", 3.125), ("2024-01-30 12:00:00.000001", 3, "click", 4.0), ("2024-01-30 07:00:00", 3, "error", 90.0),
    ("2024-01-30 11:00:00.1", 4, "error", 60.0), ("2024-01-30 11:00:00.9", 4, "error", 2.0), ("2024-01-30 06:00:00.9", 5, "error", 2.0), ("2024-01-30 06:00:01", 6, "error", 2.0),
    ("2024-01-30 11:00:00", 7, "error", 19.5), ("2024-01-30 11:30:00", 7, "error", None), ("2024-01-30 11:30:00", 8, "error", None), ("2024-01-29 12:00:00.5", 9, "click", 1.0), ("2024-01-30 10:00:00", 10, "click", 1.0),
]


@pytest.mark.parametrize("name", ["last_over_time", "stale", "run_failed", "coverage_gap"])
def test_samples_around_the_evaluation(spark, tmp_path, name):
    """A sample later than the evaluation by a part of a second doesn't count, nor does one without a value."""
    connection = _events(tmp_path, LATE)
    ours, theirs = same_rows(registry.all_queries()[name](spark, str(tmp_path)), connection, registry.all_sql()[name])
    assert ours == theirs and theirs


def test_coverage_gap_ends_at_now(spark):
    """What came less than a second after the evaluation closes no gap."""
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    rows = spark.sql("SELECT * FROM VALUES ('wy', 'a', TIMESTAMP_NTZ '2024-01-01 12:00:00'), ('wy', 'a', TIMESTAMP_NTZ '2024-01-02 00:00:00.3'), ('wy', 'b', TIMESTAMP_NTZ '2024-01-02 00:00:00') AS t(state, repo, ts)")
    assert health.coverage_gap(rows, ["state"], "repo", now).collect()[0]["gap"] == 1


def test_harvest(spark):
    runs = spark.sql("""SELECT 'o' AS org, 'r' AS repo, 'w' AS workflow, id, status, conclusion, TIMESTAMP_NTZ '2024-01-01 20:00:00' AS created_at FROM VALUES
        (1L, 'completed', 'success'), (2L, 'completed', 'failure'), (3L, 'in_progress', NULL), (4L, 'completed', 'success') AS t(id, status, conclusion)""")
    lines = spark.createDataFrame([(i, n, f"line {n}") for i in (1, 2, 3, 4) for n in range(3)] + [(1, 9, "##[group]x")], "run_id long, line_no int, line string")
    marks = spark.createDataFrame([("o", "r", "w", 0)], "org string, repo string, workflow string, watermark long")
    out, new = sweep.harvest(runs, lines, marks, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit(100).cast("long"), n_tail=2)
    assert [r["watermark"] for r in new.collect()] == [2]
    assert sorted((r["run_id"], r["line_no"], r["collected_ns"]) for r in out.collect()) == [(1, 1, 100), (1, 2, 101), (2, 0, 102), (2, 1, 103), (2, 2, 104)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, id string, title string, state string, value double")
    assert latest.best_row(none, ["k"], F.col("value")).count() == 0
    assert quality.reconcile(none, none, ["k"], "id").count() == 0
    assert joins.same_title_pairs(none, "title", "state").count() == 0
    assert none.select(records.content_hash("k", "id")).count() == 0
