import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lawmill import schemas, sinks
from lawmill.functions import keys, records, text, times
from lawmill.plans import normalise, sweep, topic_feed
from lawmill.sources import listing
from lawmill.sources import records as src


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).collect()[0]
    return row.asDict()


def test_times(spark):
    ts = lambda s: times.compact_ts(F.lit(s))
    got = one(spark, a=ts("2025-01-31T00:14:23-05:00"), b=ts("2025-01-31"), c=ts("20250131T001423Z"), d=ts("not a date"), e=times.log_timestamp(F.lit("x/logs/20250131T001423Z.vote_event.pass.upper.json")), f=times.legacy_timestamp(F.lit("x/20250131T001423Z.vote_event.pass.json")))
    assert got == {"a": "20250131T001423Z", "b": "20250131T000000Z", "c": "20250131T001423Z", "d": None, "e": "20250131T001423Z", "f": "20250131T001423Z.vote"}
    end = lambda name, e: times.corrected_end_date(F.lit(name), F.lit("2025"), F.lit(e).cast("date")).cast("string")
    assert one(spark, a=end("2025-2026 Session", "2025-05-01"), b=end("2025 Session", "2025-05-01"), c=end("2025-2027", "2025-05-01")) == {"a": "2026-12-31", "b": "2025-05-01", "c": "2025-05-01"}
    assert one(spark, n=times.to_ns(F.lit("2024-01-01T00:00:00.5Z")))["n"] == 1704067200500000000


def test_keys(spark):
    org = '~{"classification": "upper"}'
    key = lambda date, desc, cls: keys.action_log_key(F.lit(date), F.lit(desc), F.array(*map(F.lit, cls)), F.lit(org))
    got = one(
        spark, a=key("2025-01-31T00:14:23", "x", ["introduction"]), b=key("2025-01-29", "Bill Number Assigned!", ["other"]), c=key(None, "A b", ["x"]),
        d=keys.org_classification(F.lit("bad"), "unknown"), e=keys.jurisdiction_code(F.lit("ocd-jurisdiction/country:us/state:wy/government")),
        f=keys.jurisdiction_code(F.lit("ocd-jurisdiction/country:us/government")), g=keys.bill_key(F.lit("WY"), F.lit("2025"), F.lit("HB 1")),
        h=keys.vote_log_key(F.lit("2025-02-05T17:21:10"), F.lit("pass"), F.lit(org)), i=keys.vote_result(F.lit("x.vote_event.fail.json")),
    )
    assert got["a"] == "20250131T001423Z.classification.introduction.upper" and got["b"] == "20250129T000000Z_bill_number_assigned"
    assert got["c"] == "unknown_a_b" and got["d"] == "unknown" and got["e"] == "wy" and got["f"] == "usa" and got["g"] == "wy/2025/HB1"
    assert got["h"] == "20250205T172110Z.vote_event.pass.upper" and got["i"] == "fail"


def test_text(spark):
    page = "<html><head><title> T </title><script>x<y</script></head><body>a&amp;b <b>c</b><!-- no --></body></html>"
    got = one(spark, a=text.html_text(F.lit(page)), b=text.html_title(F.lit(page)), c=text.html_placeholder(F.lit("Please ENABLE JavaScript"), F.lit("x" * 300)),
              d=text.sniff(F.lit(""), F.lit("<?xml version='1.0'?>")), e=text.metric_escape(F.lit("a b,c=d")), f=text.metric_number(F.lit(3.0)), g=text.metric_number(F.lit(3.5)),
              h=text.session_slug(F.lit("2025 Regular")), i=text.session_slug(F.lit("a/b")))
    assert got == {"a": "T a&b c", "b": "T", "c": True, "d": "xml", "e": "a\\ b\\,c\\=d", "f": "3", "g": "3.5", "h": "2025-regular", "i": None}


def test_prune_and_drop_keys(spark):
    df = spark.createDataFrame([(1, "", ["", "a"], {"k": "", "m": "v"}, (("", 1), []))], "n int, s string, a array<string>, m map<string,string>, t struct<x:struct<s:string,i:int>,e:array<string>>")
    row = records.prune_rows(df).collect()[0].asDict(recursive=True)
    assert row == {"n": 1, "s": None, "a": ["a"], "m": {"m": "v"}, "t": {"x": {"s": None, "i": 1}, "e": None}}
    nested = spark.createDataFrame([((1, [("a", "b")]),)], "o struct<_id:int,list:array<struct<_id:string,v:string>>>")
    kept = nested.select(records.drop_keys(F.col("o"), nested.schema["o"].dataType).alias("o")).collect()[0].asDict(recursive=True)
    assert kept == {"o": {"list": [{"v": "b"}]}}


BILL = {
    "legislative_session": "2025", "identifier": "HB 1", "title": "A bill", "jurisdiction": {"id": "x"},
    "actions": [{"description": "Introduced", "date": "2025-01-02", "classification": ["introduction"], "organization_id": '~{"classification": "lower"}'},
                {"description": "Signed", "date": "2025-03-02", "classification": ["other"]}],
}


def _tree(root):
    bill = root / "country:us/state:wy/sessions/2025/bills/HB1"
    (bill / "logs").mkdir(parents=True)
    (bill / "metadata.json").write_text(json.dumps(BILL))
    (bill / "logs/20250102T000000Z.classification.introduction.lower.json").write_text(json.dumps({"action": BILL["actions"][0], "bill_id": "HB1"}))
    (bill / "logs/20250302T000000Z_signed.json").write_text(json.dumps({"action": BILL["actions"][1], "bill_id": "HB1"}))
    (bill / "logs/broken.json").write_text("{")
    return str(root)


def test_read_tree_to_feed(spark, tmp_path):
    root = _tree(tmp_path)
    bills, logs = src.read_bills(spark, root), src.read_logs(spark, root)
    assert [(r["state"], r["session_id"], r["bill_id"], r["title"]) for r in bills.collect()] == [("wy", "2025", "HB1", "A bill")]
    assert logs.count() == 2
    assert src.discover_log_files(spark, root).count() == 3
    assert src.list_tree(spark, root).collect()[0]["n_files"] == 4
    tags = spark.createDataFrame([("wy", "2025", "HB1", "trade", 0.7)], "state string, session_id string, bill_id string, tag string, score double")
    from lawmill.operators.rules import RuleSet

    rows = topic_feed.log_rows(logs, {"bill": bills, "tags": tags}, rule_sets={"wy": RuleSet(("introduction",))})
    feed = topic_feed.feed(topic_feed.select_default(rows), ["trade"], base_url=F.lit("https://x.example/")).collect()
    assert len(feed) == 1 and feed[0]["title"] == "trade - unknown - A bill" and "    description: Signed" in feed[0]["description"] and feed[0]["link"].startswith("https://x.example/file:")
    xml = sinks.feed_xml(topic_feed.feed(topic_feed.select_default(rows)), "T", "L").collect()[0]["rss"]
    assert xml.count("<item>") == 1


@pytest.mark.parametrize("walk", [1, 3, 100])
def test_tasks_list_what_spark_lists(spark, tmp_path, walk):
    top = tmp_path / "a b%20c"
    for name in ("x.json", "d/x.json", "d/e/f/g/y z.json", "d/e/é%.json", "country:us/state:wy/logs/1.json", "_h/x.json", ".h/x.json", "d/_x.json", "d/.x.json", "_k=1/x.json", "d/x.txt", "d/x.json.txt", "d/e/x.json._COPYING_", "_metadata/x.json", *(f"many/{k}/logs/{k}.json" for k in range(40))):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("{}")
    (top / "empty").mkdir()
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    found = listing.files_below(spark, str(top), ".json", walk)
    assert sorted(r["path"] for r in found.collect()) == sorted(r["path"] for r in read.load(str(top)).select("path").collect())
    assert found.count() > 40 and listing.files_below(spark, str(top / "empty"), ".json", walk).count() == 0
    assert [r["path"].rsplit("/", 1)[1] for r in listing.files_below(spark, f"{top}/d/e/f/g/*", ".json").collect()] == ["y z.json"]
    with pytest.raises(AnalysisException):
        listing.files_below(spark, str(top / "none"), ".json").count()


def test_log_files_are_not_listed_on_the_driver(spark, tmp_path):
    found = src.discover_log_files(spark, _tree(tmp_path))
    assert found.inputFiles() == [] and found.count() == 3


def test_action_logs_and_summary_views(spark, tmp_path):
    bills = src.read_bills(spark, _tree(tmp_path))
    keys_ = sorted(r["log_key"] for r in sinks.action_log_rows(bills).collect())
    assert keys_ == ["20250102T000000Z.classification.introduction.lower", "20250302T000000Z_signed"]
    sinks.load_tables(bills)
    assert spark.sql("SELECT actions_count FROM bills_summary").collect()[0][0] == 2
    sinks.write_partitioned(sinks.action_log_rows(bills), str(tmp_path / "out"))
    sinks.write_partitioned(sinks.action_log_rows(bills), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_raw_objects(spark, tmp_path):
    (tmp_path / "bill_1.json").write_text(json.dumps(BILL))
    (tmp_path / "vote_event_1.json").write_text("{}")
    (tmp_path / "event_1.json").write_text("not json")
    good, bad = src.read_raw_objects(spark, str(tmp_path))
    assert sorted(r["kind"] for r in good.collect()) == ["bill", "vote_event"] and [r["name"] for r in bad.collect()] == ["event_1.json"]
    assert src.typed_objects(good, "bill").collect()[0]["identifier"] == "HB 1"


def test_jsonl_and_archives(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\nbad\n{"id": "b"}\n')
    assert [r["id"] for r in src.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string").collect()] == ["a", "b"]
    assert src.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string", "pass").count() == 3
    with zipfile.ZipFile(tmp_path / "7.zip", "w") as z:
        z.writestr("b.txt", "1\n2")
        z.writestr("a.txt", "0")
        z.writestr("sub/c.txt", "no")
    (tmp_path / "8.zip").write_bytes(b"no zip")
    rows = src.read_run_archives(spark, str(tmp_path)).orderBy("run", "file", "line_no").collect()
    assert [(r["run"], r["file"], r["line"]) for r in rows] == [("7", "a.txt", "0"), ("7", "b.txt", "1"), ("7", "b.txt", "2"), ("8", None, None)]


def test_sessions_and_gates(spark):
    j = spark.createDataFrame([([("2025", "2025 Session", "2025-01-01", "2025-05-01", None, True), ("x", "", "", "", None, None)],)], "legislative_sessions array<struct<identifier:string,name:string,start_date:string,end_date:string,classification:string,active:boolean>>")
    sessions = src.read_sessions(j)
    assert [(r["session_id"], r["date_folder"]) for r in sessions.collect()] == [("2025", "2025-2025")]
    raw = spark.createDataFrame([("wy", "2025", "HB 1", "t", []), ("wy", "1999", "HB 2", "t", []), ("wy", "2025", "", "t", [])], f"state string, session_id string, identifier string, title string, actions array<{schemas.ACTION}>")
    good, bad = normalise.normalise_bills(raw, sessions.withColumn("state", F.lit("wy")))
    assert [r["bill_id"] for r in good.collect()] == ["HB1"]
    assert sorted(r["category"] for r in bad.collect()) == ["bill_missing_fields", "unknown_session"]
    again, _ = normalise.normalise_bills(raw, sessions.withColumn("state", F.lit("wy")), stored=good)
    assert again.count() == 0


def test_cursors_and_state_commit(spark, tmp_path):
    cursors = spark.sql("SELECT 'votes' AS category, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS cursor")
    rows = spark.sql("SELECT 'votes' AS kind, TIMESTAMP_NTZ '2024-02-01 00:00:00' AS ts UNION ALL SELECT 'events', TIMESTAMP_NTZ '2023-02-01 00:00:00'")
    moved = {r["category"]: str(r["cursor"]) for r in sweep.advance_cursors(cursors, rows, "kind", "ts").collect()}
    assert moved == {"votes": "2024-02-01 00:00:00", "events": "2023-02-01 00:00:00"}
    path = str(tmp_path / "state")
    assert sinks.current_version(spark, path) is None
    sinks.commit_state(cursors, path, "v1")
    sinks.commit_state(cursors, path, "v2")
    assert sinks.current_version(spark, path).endswith("/v2")
    marks = spark.createDataFrame([("a", 5), ("b", 6)], "k string, watermark long")
    old = spark.createDataFrame([("b", 1)], "k string, watermark long")
    taken = sweep.ship(marks, marks, old, ["k"], lambda df: df.filter("k = 'a'"))
    assert sorted((r["k"], r["watermark"]) for r in taken.collect()) == [("a", 5), ("b", 1)]
    assert sinks.committed_versions(spark, path) == ["v1", "v2"]
