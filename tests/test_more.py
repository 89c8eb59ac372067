import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from lawmill import sinks
from lawmill.functions import records
from lawmill.operators import documents, filters
from lawmill.session import small
from lawmill.streaming import state as streams


def test_prune_json(spark):
    rows = [('{"a": "", "b": [null, {"c": []}, 0, false], "d": {"e": "x"}}',), ("bad",), (None,), ("{}",)]
    got = [r["p"] for r in spark.createDataFrame(rows, "j string").select(records.prune_json("j").alias("p")).collect()]
    assert [g and json.loads(g) for g in got] == [{"b": [0, False], "d": {"e": "x"}}, None, None, None]


def test_parse_html(spark):
    page = "<title>T &amp; x</title><script>var t='</p>'</script><p>a<b>b</b> &lt;c&gt;<!-- no --></p>"
    rows = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(documents.parse_html("h").alias("d")).collect()
    assert [(r["d"]["title"], r["d"]["text"]) for r in rows] == [("T & x", "a b <c>"), (None, None), (None, "")]


def test_late_rows_are_counted(spark):
    rows = spark.sql("SELECT * FROM VALUES ('v', TIMESTAMP_NTZ '2024-01-02 00:00:00'), ('v', TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('e', TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('e', CAST(NULL AS TIMESTAMP_NTZ)) AS t(kind, ts)")
    cursors = spark.sql("SELECT 'v' AS category, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS cursor")
    seen = Observation("late")
    assert filters.newer_than(rows, cursors, "kind", "ts", seen).count() == 2
    assert seen.get == {"rows": 4, "dropped": 2}


def test_small_hints_only_what_it_counted(spark):
    df = spark.range(100)
    assert small(df, 99) is df and small(df, 100) is not df


def test_stream_ledger_twice(spark, tmp_path):
    """A second batch emits only new and changed keys, as the batch ledger does."""
    spark.conf.set(streams.PROVIDER, streams.ROCKS)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "key long, content_hash string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key long, content_hash string").parquet(source)
        streams.run_available(streams.stream_ledger(stream), out, checkpoint)
    got = sorted((r["key"], r["content_hash"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]


def test_dashboard_and_summary(spark):
    bills = spark.createDataFrame([("wy", ["a", "b"]), ("ca", ["a"])], "state string, tags array<string>")
    defs = spark.createDataFrame([("a", "about a")], "name string, description string")
    places = spark.createDataFrame([("wy",), ("ca",), ("tx",)], "state string")
    doc = json.loads(sinks.dashboard(bills, defs, F.lit("now"), "src", places).collect()[0]["document"])
    assert doc["states"] == [{"code": "ca", "name": "California"}, {"code": "wy", "name": "Wyoming"}] and doc["empty_jurisdictions"] == [{"code": "tx", "name": "Texas"}]
    assert doc["tags"] == [{"name": "a", "description": "about a"}, {"name": "b", "description": ""}]
    objects = spark.createDataFrame([("bill", "1"), ("bill", "2"), ("event", "3")], "kind string, name string")
    row = sinks.run_summary(objects, objects.filter("kind = 'event'"), "wy").collect()[0]
    assert row["objects"] == {"bill": 2, "event": 1} and row["error_count"] == 1


def test_quarantine_once(spark):
    bad = spark.createDataFrame([("c", "x"), ("c", "y")], "category string, name string")
    assert sinks.quarantine(bad, bad.filter("name = 'x'")).collect()[0]["name"] == "y"


def test_log_streams_in_spans(spark):
    from lawmill.operators import health

    lines = spark.createDataFrame([("a", 5, "x"), ("a", 1, "w"), ("a", 12, "y"), ("b\n", 1, "z")], "label string, ns long, line string")
    whole = health.log_streams(lines, ["label"], "ns", "line").collect()
    assert len(whole) == 1 and [v["line"] for v in json.loads(whole[0]["values"])] == ["w", "x", "y"]
    parts = health.log_streams(lines, ["label"], "ns", "line", span_ns=10).orderBy("span").collect()
    assert [(r["span"], r["n_values"]) for r in parts] == [(0, 2), (1, 1)]
