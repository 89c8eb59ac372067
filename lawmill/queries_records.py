"""Registered queries: files written from the tables and read again, logs and quarantine, feed text, rules of real locales, tag vectors."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lawmill import sinks
from lawmill.functions import keys, records, text, times
from lawmill.operators import documents as docs_ops
from lawmill.operators import filters, joins, latest, rules, tagging
from lawmill.plans import normalise, sweep, topic_feed
from lawmill.plans import sql as stock
from lawmill.registry import query
from lawmill.session import checkpoint_dir
from lawmill.sources import records as src
from lawmill.sources.tables import table

CODES = ["al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo"]
SQL_STATE = "([" + ", ".join(f"'{c}'" for c in CODES) + "])[s_nationkey + 1]"


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _suppliers(spark, sf):
    """Suppliers as bills: a state code, a session of five and a bill id."""
    state = F.get(F.array(*map(F.lit, CODES)), F.col("s_nationkey").cast("int"))
    session = (F.lit(2020) + F.col("s_suppkey") % 5).cast("string")
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", state.alias("state"), session.alias("session"), F.concat(F.lit("HB"), "s_suppkey").alias("bill"))


def _bill_folder():
    return F.concat(F.lit("x-legislation/country:us/state:"), "state", F.lit("/sessions/"), "session", F.lit("/bills/"), "bill")


def _written(spark, rows, name):
    root = _folder(spark, name)
    sinks.write_tree(rows, root)
    return root


def _bill_tree(spark, sf):
    """A metadata.json per supplier, every seventh of them no JSON, and a file beside it where the balance is high."""
    rows = _suppliers(spark, sf)
    body = F.to_json(F.struct(F.col("s_name").alias("title"), F.concat(F.lit("HB "), "s_suppkey").alias("identifier"), F.when(F.col("s_acctbal") > 0, F.col("session")).alias("legislative_session"), F.struct(F.lit("j").alias("name")).alias("jurisdiction")))
    bills = rows.select(F.concat(_bill_folder(), F.lit("/metadata.json")).alias("path"), F.when(F.col("s_suppkey") % 7 == 0, "{broken").otherwise(body).cast("binary").alias("body"))
    files = rows.filter("s_acctbal > 5000").select(F.concat(_bill_folder(), F.lit("/files/a.txt")).alias("path"), F.lit("text").cast("binary").alias("body"))
    return _written(spark, bills.unionByName(files), "bills")


@query("tree_bills", f"SELECT {SQL_STATE} AS state, (2020 + s_suppkey % 5)::VARCHAR AS session_id, 'HB' || s_suppkey AS bill_id, s_name AS title FROM supplier WHERE s_suppkey % 7 <> 0")
def tree_bills(spark, sf):
    return src.read_bills(spark, _bill_tree(spark, sf)).select("state", "session_id", "bill_id", "title")


@query("any_layout", "SELECT s_name AS title, 'HB ' || s_suppkey AS identifier FROM supplier WHERE s_suppkey % 7 <> 0 AND s_acctbal <= 5000 UNION ALL SELECT s_name, 'HB ' || s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0 AND s_acctbal > 5000")
def any_layout(spark, sf):
    """Bills as metadata.json in folders and as bill_*.json in the open; what isn't a bill goes."""
    rows = _suppliers(spark, sf)
    body = F.to_json(F.struct(F.col("s_name").alias("title"), F.concat(F.lit("HB "), "s_suppkey").alias("identifier"), F.struct(F.lit("j").alias("name")).alias("jurisdiction")))
    path = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("raw/bill_"), "s_suppkey", F.lit(".json"))).otherwise(F.concat(_bill_folder(), F.lit("/metadata.json")))
    good = rows.select(path.alias("path"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("{}")).otherwise(body).cast("binary").alias("body"))
    hidden = rows.select(F.concat(F.lit(".git/bill_"), "s_suppkey", F.lit(".json")).alias("path"), body.cast("binary").alias("body"))
    read = src.read_any_layout(spark, _written(spark, good.unionByName(hidden), "layout"))
    return read.filter(filters.looks_like_bill(F.col("identifier"), F.col("title"), F.col("jurisdiction"))).select("title", "identifier")


@query("tree_listing", f"SELECT {SQL_STATE} AS state, (2020 + s_suppkey % 5)::VARCHAR AS session_id, 'HB' || s_suppkey AS bill_id, CASE WHEN s_acctbal > 5000 THEN 2 ELSE 1 END::BIGINT AS n_files, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS has_files FROM supplier")
def tree_listing(spark, sf):
    return src.list_tree(spark, _bill_tree(spark, sf)).withColumn("has_files", F.col("has_files").cast("int"))


LOGS_SQL = f"""SELECT {SQL_STATE} AS state, (2020 + s_suppkey % 5)::VARCHAR AS session_id, 'HB' || s_suppkey AS bill_id, s_name AS description,
  '2024010' || (s_suppkey % 9 + 1) || 'T000000Z' AS log_ts FROM supplier WHERE s_suppkey % 7 <> 0"""


def _log_tree(spark, sf):
    """A log per supplier; every seventh no JSON, and a JSON file outside of the logs."""
    rows = _suppliers(spark, sf)
    stamp = F.concat(F.lit("2024010"), F.col("s_suppkey") % 9 + 1, F.lit("T000000Z"))
    body = F.to_json(F.struct(F.struct(F.col("s_name").alias("description"), F.lit("2024-01-01").alias("date")).alias("action"), F.when(F.col("s_acctbal") > 0, F.col("bill")).alias("bill_id")))
    logs = rows.select(F.concat(_bill_folder(), F.lit("/logs/"), stamp, F.lit("_x.json")).alias("path"), F.when(F.col("s_suppkey") % 7 == 0, "[1").otherwise(body).cast("binary").alias("body"))
    others = rows.select(F.concat(_bill_folder(), F.lit("/other.json")).alias("path"), body.cast("binary").alias("body"))
    return _written(spark, logs.unionByName(others), "logs")


@query("tree_logs", LOGS_SQL)
def tree_logs(spark, sf):
    logs = src.read_logs(spark, _log_tree(spark, sf), ["x-legislation"])
    return logs.select("state", "session_id", "bill_id", F.col("log.action.description").alias("description"), "log_ts")


@query("log_files", f"""SELECT 'country:us/state:' || {SQL_STATE} || '/sessions/' || (2020 + s_suppkey % 5) || '/bills/HB' || s_suppkey || '/logs/' || '2024010' || (s_suppkey % 9 + 1) || 'T000000Z_x.json' AS relative,
       '2024010' || (s_suppkey % 9 + 1) || 'T000000Z' AS log_ts FROM supplier WHERE s_suppkey % 9 < 5""")
def log_files(spark, sf):
    """Log files by listing, then those that a list of paths names."""
    files = src.discover_log_files(spark, _log_tree(spark, sf))
    wanted = files.filter(F.col("log_ts") <= "20240105T000000Z").select("path")
    return src.logs_from_paths(files, wanted.unionByName(wanted)).select("relative", "log_ts")


@query("raw_objects", """SELECT kind, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad, count(*) FILTER (WHERE ok AND kind = 'event') AS archived, max(s_name) FILTER (WHERE ok AND kind = 'event') AS last_event FROM (
         SELECT s_name, (['bill', 'vote_event', 'event', 'jurisdiction', 'organization', 'other'])[s_suppkey % 6 + 1] AS kind, s_suppkey % 7 <> 0 AS ok FROM supplier) GROUP BY 1""")
def raw_objects(spark, sf):
    """Scraper files by prefix: those that are JSON, the quarantined ones, and the archive of events."""
    rows = _suppliers(spark, sf)
    kind = F.get(F.array(*(F.lit(k) for k in ("bill_", "vote_event_", "event_", "jurisdiction_", "organization_", "notes_"))), (F.col("s_suppkey") % 6).cast("int"))
    body = F.when(F.col("s_suppkey") % 7 == 0, "{").otherwise(F.to_json(F.struct(F.col("s_name").alias("name"))))
    root = _written(spark, rows.select(F.concat(kind, "s_suppkey", F.lit(".json")).alias("path"), body.cast("binary").alias("body")), "raw")
    good, bad = src.read_raw_objects(spark, root)
    events = src.event_archive(good).select(F.lit("event").alias("kind"), records.json_path(F.col("body"), "name").alias("event_name"))
    archived = events.groupBy("kind").agg(F.count(F.lit(1)).alias("archived"), F.max("event_name").alias("last_event"))
    counts = good.select("kind", F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.select("kind", F.lit(0).alias("g"), F.lit(1).alias("b")))
    counts = counts.groupBy("kind").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))
    return counts.join(archived, "kind", "left").select("kind", "good", "bad", F.coalesce("archived", F.lit(0)).cast("long").alias("archived"), "last_event")


@query("json_lines", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS name FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT NULL, NULL FROM supplier WHERE s_suppkey % 7 = 0")
def json_lines(spark, sf):
    """JSON lines with blank and malformed ones, the latter passed through."""
    line = F.when(F.col("s_suppkey") % 7 == 0, "no json").otherwise(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))
    root = _folder(spark, "jsonl")
    table(spark, sf, "supplier").select(F.concat(line, F.lit("\n\n")).alias("value")).write.text(root)
    return src.read_jsonl(spark, root, "id long, name string", "pass").select("id", "name")


@query("tag_results", "SELECT 'HB' || s_suppkey AS bill_id, 'tag' || s_nationkey AS tag, round(s_acctbal, 2) AS score FROM supplier WHERE s_nationkey <> 3")
def tag_results(spark, sf):
    """One file per tag; one of them broken."""
    score = F.struct(F.struct(F.round("s_acctbal", 2).alias("final_score")).alias("score"), F.lit("h").alias("text_hash"))
    one = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("HB"), "s_suppkey"), score))).alias("bills"))
    body = F.when(F.col("s_nationkey") == 3, "{").otherwise(F.to_json(F.struct("bills")))
    root = _written(spark, one.select(F.concat(F.lit("tags/tag"), "s_nationkey", F.lit(".json")).alias("path"), body.cast("binary").alias("body")), "tags")
    return src.read_tag_results(spark, root).select("bill_id", "tag", "score")


@query("sessions", "SELECT s_suppkey::VARCHAR AS session_id, s_name AS name, '2024-01-0' || (s_suppkey % 9 + 1) AS start_date, '2024-2025' AS date_folder FROM supplier WHERE s_acctbal > 0")
def sessions(spark, sf):
    """Sessions nested in jurisdictions; those without a start are left out."""
    one = F.struct(
        F.col("s_suppkey").cast("string").alias("identifier"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("2024-01-0"), F.col("s_suppkey") % 9 + 1)).otherwise("").alias("start_date"), F.lit("2025-05-31").alias("end_date"),
    )
    nested = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(one).alias("legislative_sessions"))
    return src.read_sessions(nested).select("session_id", "name", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), "date_folder")


@query("poll_records", "SELECT s_name AS repo, 'w' || (s_suppkey % 3) AS workflow, round(s_acctbal, 2) AS hours FROM supplier")
def poll_records(spark, sf):
    root = _folder(spark, "poll")
    work = F.array(F.struct(F.concat(F.lit("w"), F.col("s_suppkey") % 3).alias("workflow"), F.round("s_acctbal", 2).alias("hours_since_success")))
    table(spark, sf, "supplier").select(F.col("s_name").alias("repo"), work.alias("workflows")).write.json(root)
    return src.read_poller_records(spark, root).select("repo", F.explode("workflows").alias("w")).select("repo", "w.workflow", F.col("w.hours_since_success").alias("hours"))


@query("run_listings", "SELECT 'org' || s_nationkey AS org, 'r' AS repo, 'w.yml' AS workflow, s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN 'success' ELSE 'failure' END AS conclusion FROM supplier")
def run_listings(spark, sf):
    run = F.struct(F.col("s_suppkey").alias("id"), F.lit("completed").alias("status"), F.when(F.col("s_acctbal") > 0, "success").otherwise("failure").alias("conclusion"))
    one = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(run).alias("workflow_runs"))
    root = _written(spark, one.select(F.concat(F.lit("org"), "s_nationkey", F.lit("__r__w.yml.json")).alias("path"), F.to_json(F.struct("workflow_runs")).cast("binary").alias("body")), "runs")
    return src.read_runs(spark, root).select("org", "repo", "workflow", "id", "conclusion")


@query("run_archives", """SELECT s_suppkey::VARCHAR AS run, file, line_no::BIGINT AS line_no, line FROM (
         SELECT s_suppkey, 'a.txt' AS file, 0 AS line_no, s_name AS line FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'b.txt', 0, 'x' FROM supplier WHERE s_suppkey % 5 <> 0
         UNION ALL SELECT s_suppkey, 'b.txt', 1, 'y' FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0)""")
def run_archives(spark, sf):
    """Zipped logs; every fifth archive is cut off, which leaves the others alone."""

    @F.pandas_udf("binary")
    def zipped(numbers: pd.Series, names: pd.Series) -> pd.Series:
        found = []
        for number, name in zip(numbers, names):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("b.txt", "x\ny")
                z.writestr("a.txt", name)
                z.writestr("sub/c.txt", "no")
            found.append(buffer.getvalue()[: 40 if number % 5 == 0 else None])
        return pd.Series(found)

    rows = table(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".zip")).alias("path"), zipped("s_suppkey", "s_name").alias("body"))
    return src.read_run_archives(spark, _written(spark, rows, "zips"))


@query("calendar", "SELECT s_name AS state, '2024-01-0' || (s_suppkey % 9 + 1) AS start_date, CASE WHEN s_acctbal > 0 THEN '2024-06-30' END AS end_date FROM supplier")
def calendar(spark, sf):
    root = _folder(spark, "calendar")
    rows = table(spark, sf, "supplier").select(
        F.col("s_name").alias("state"), F.lit("1").alias("session"), F.concat(F.lit("2024-01-0"), F.col("s_suppkey") % 9 + 1).alias("start_date"),
        F.when(F.col("s_acctbal") > 0, "2024-06-30").alias("end_date"), F.lit("open").alias("status"), F.lit("").alias("notes"),
    )
    sinks.export(rows, root, "csv")
    return src.read_calendar(spark, root).select("state", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start_date", "end_date")))


@query("sql_on_file", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def sql_on_file(spark, sf):
    """A table written and asked straight from its folder."""
    root = _folder(spark, "export")
    sinks.export(table(spark, sf, "part").select("p_brand", "p_size"), root)
    return stock.query_file(spark, root, "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("state_versions", "SELECT user_id, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1")
def state_versions(spark, sf):
    """A state table committed twice: readers get the newer version."""
    path = _folder(spark, "state")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))
    sinks.commit_state(rows.filter("user_id < 0"), path, "v1")
    sinks.commit_state(rows, path, "v2")
    return spark.read.schema(rows.schema).parquet(sinks.current_version(spark, path))


@query("bills_view", "SELECT p_type AS state, p_name AS title, p_size % 4 AS actions_count FROM part")
def bills_view(spark, sf):
    actions = F.slice(F.array(*(F.lit(n) for n in range(4))), 1, (F.col("p_size") % 4).cast("int"))
    bills = table(spark, sf, "part").select(
        F.col("p_type").alias("state"), F.lit("s").alias("session_id"), F.lit("i").alias("identifier"), F.col("p_name").alias("title"), actions.alias("actions"), F.array(F.lit(1)).alias("sponsorships")
    )
    sinks.load_tables(bills)
    return spark.sql("SELECT state, title, actions_count FROM bills_summary")


# --- logs, quarantine, summaries

ACTIONS_SQL = """WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, strftime(l_shipdate, '%Y%m%dT%H%M%SZ') || CASE WHEN l_returnflag = 'A' THEN '.classification.passage.lower' ELSE '_' || lower(l_linestatus) || '_sent' END AS log_key, l_shipdate, l_returnflag, l_linestatus FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, log_key ORDER BY l_linenumber DESC, l_suppkey DESC) AS back FROM a)"""


@query("action_log_rows", f"""{ACTIONS_SQL} SELECT l_orderkey::VARCHAR AS bill_id, log_key, l_linestatus || ' sent' AS description, l_linenumber::VARCHAR AS entity, '~{{"classification": "lower"}}' AS jurisdiction_id, CASE WHEN l_returnflag = 'A' THEN 'passage' ELSE '' END AS classes FROM n WHERE back = 1""")
def action_log_rows(spark, sf):
    """Orders as bills with nested actions; of equal file keys the last action stays; related entities are kept."""
    line = F.struct(
        "l_linenumber", "l_suppkey",
        F.struct(
            F.concat("l_linestatus", F.lit(" sent")).alias("description"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
            F.lit(None).cast("string").alias("occurred_at"), F.lit('~{"classification": "lower"}').alias("organization_id"),
            F.when(F.col("l_returnflag") == "A", F.array(F.lit("passage"))).alias("classification"), F.lit(None).cast("array<string>").alias("classifications"),
            F.array(F.struct(F.lit("bill").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"), F.col("l_linenumber").cast("string").alias("name"), F.lit("").alias("note"))).alias("related_entities"),
        ).alias("action"),
    )
    bills = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    bills = bills.select(F.lit("x").alias("state"), F.lit("s").alias("session_id"), F.col("l_orderkey").cast("string").alias("bill_id"), F.lit(None).cast("array<struct<url:string,note:string>>").alias("sources"), F.transform("lines", lambda x: x["action"]).alias("actions"))
    a = F.col("action")
    return sinks.action_log_rows(bills).select("bill_id", "log_key", a["description"].alias("description"), F.get(a["related_entities"], 0)["name"].alias("entity"), a["jurisdiction_id"].alias("jurisdiction_id"), F.array_join(a["classifications"], ",").alias("classes"))


VOTES_SQL = """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || CASE o_orderstatus WHEN 'F' THEN '.vote_event.pass.upper' WHEN 'O' THEN '_vote_event_fail' ELSE '_vote_event_unknown' END AS log_key,
  CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'unknown' END AS result FROM orders"""


@query("vote_log_rows", f"SELECT o_custkey AS bill_id, log_key, arg_max(o_orderkey::VARCHAR, o_orderkey::VARCHAR) AS identifier, any_value(result) AS result FROM ({VOTES_SQL}) GROUP BY 1, 2")
def vote_log_rows(spark, sf):
    result = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail")
    votes = table(spark, sf, "orders").select(
        F.lit("x").alias("state"), F.lit("s").alias("session_id"), F.col("o_custkey").alias("bill_id"), F.col("o_orderkey").cast("string").alias("identifier"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("start_date"), result.alias("result"), F.lit('~{"classification": "upper"}').alias("organization"),
    )
    return sinks.vote_log_rows(votes).select("bill_id", "log_key", "identifier", keys.vote_result(F.coalesce("result", "log_key")).alias("result"))


@query("session_log_catalog", """SELECT p_partkey::VARCHAR AS bill_id, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey::VARCHAR) > 1 THEN p_name || '_' || p_partkey ELSE p_name END AS entry FROM part""")
def session_log_catalog(spark, sf):
    logs = table(spark, sf, "part").select(F.col("p_brand").alias("state"), F.col("p_type").alias("session_id"), F.col("p_name").alias("log_key"), F.col("p_partkey").cast("string").alias("bill_id"))
    return sinks.session_log_catalog(logs).select("bill_id", "entry")


@query("quarantine_new", """SELECT p_type AS category, p_name AS name, count(*) AS n FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size < 5 AND q.p_type = p.p_type AND q.p_name = p.p_name) GROUP BY 1, 2""")
def quarantine_new(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("name"), "p_size")
    return sinks.quarantine(rows.filter("p_size > 25"), rows.filter("p_size < 5")).groupBy("category", "name").agg(F.count(F.lit(1)).alias("n"))


@query("run_summary", """SELECT count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS error_count, min(user_id::VARCHAR) FILTER (WHERE event_type = 'error') AS first_error FROM events""")
def run_summary(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("name"))
    out = sinks.run_summary(rows, rows.filter("kind = 'error'"), "wy")
    return out.select(F.element_at("objects", "view").alias("views"), "error_count", "first_error")


@query("failed_documents", """SELECT doc_id, CASE WHEN toxic IS NULL THEN 'download_failed' ELSE 'placeholder_only' END AS error_type, CASE WHEN toxic IS NULL THEN 1 ELSE 0 END AS counted FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic = 1""")
def failed_documents(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    reason = F.when(F.col("toxic").isNull(), "download_failed").when(F.col("toxic") == 1, "placeholder_only")
    results = joined.select(F.col("doc_id").alias("bill_id"), reason.alias("reason"), F.when(reason.isNull(), "ok").otherwise("unavailable").alias("outcome"), F.lit("u").alias("url"))
    return sinks.failed_documents(results, F.lit("now")).select(F.col("bill_id").alias("doc_id"), "error_type", F.col("counted").cast("int").alias("counted"))


@query("availability", """SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN 'now' WHEN l.doc_id IS NULL THEN 'before' END AS extracted_at, CASE WHEN l.toxic = 1 THEN 'no_text_layer' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def availability(spark, sf):
    """Labelled documents were tried again: the toxic ones stay unavailable."""
    before = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("tried")), "doc_id", "left").select(
        "doc_id", F.when(F.col("tried").isNull(), "before").alias("extracted_at"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("checked_at")
    )
    results = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "unavailable").otherwise("ok").alias("outcome"), F.lit("no_text_layer").alias("new_reason"))
    return docs_ops.availability(before, results, "doc_id", F.lit("now")).select("doc_id", "extracted_at", "reason")


@query("extract_versions", """SELECT source, arg_min(kind, rank) FILTER (WHERE ok) AS media_type, count(*) AS tried FROM (
         SELECT source, kind, row_number() OVER (PARTITION BY source ORDER BY pref) AS rank, n >= 200 AND doc_id % 3 > 0 AS ok FROM (
           SELECT source, 'text/' || lang AS kind, lang AS l, arg_min(doc_id, doc_id) AS doc_id, arg_min(length(trim(text)), doc_id) AS n, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS pref FROM documents GROUP BY source, lang)) GROUP BY 1""")
def extract_versions(spark, sf):
    """Per source the first language, in order, whose first document has text; kinds of documents are played by languages."""
    docs = table(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    order = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    ranked = docs.select(F.col("source").alias("bill_id"), F.lit("v").alias("note"), F.col("doc_id").cast("string").alias("url"), F.concat(F.lit("text/"), "lang").alias("media_type"), order.alias("rank"))
    plain = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), F.when((F.length(F.trim("text")) >= 200) & (F.col("doc_id") % 3 > 0), F.col("text")).alias("content"))
    return docs_ops.extract(ranked, plain).select(F.col("bill_id").alias("source"), "media_type", "tried")


@query("harvest", """WITH r AS (SELECT 'w' || (user_id % 20) AS workflow, event_id AS id, event_id % 40 <> 0 AS done, value < 100 AS good FROM events WHERE event_id > 100 AND ts >= TIMESTAMP '2024-01-29 12:00:00'),
         p AS (SELECT *, bool_and(done) OVER (PARTITION BY workflow ORDER BY id ROWS UNBOUNDED PRECEDING) AS ok FROM r), l AS (SELECT workflow, id, unnest([0, 1, 2]) AS line_no, good FROM p WHERE ok)
       SELECT workflow, id AS run_id, line_no, 999 + row_number() OVER (PARTITION BY workflow ORDER BY id, line_no) AS collected_ns FROM l WHERE NOT good OR line_no >= 1""")
def harvest(spark, sf):
    """Runs after the watermark up to the first that isn't done: two last lines of good ones, a bounded end of the others."""
    rows = table(spark, sf, "events")
    runs = rows.select(
        F.lit("o").alias("org"), F.lit("r").alias("repo"), F.concat(F.lit("w"), F.col("user_id") % 20).alias("workflow"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 40 == 0, "queued").otherwise("completed").alias("status"), F.when(F.col("value") < 100, "success").otherwise("failure").alias("conclusion"),
    )
    lines = rows.select(F.col("event_id").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line_no"), F.col("event_type").alias("line"))
    marks = runs.select("org", "repo", "workflow").distinct().withColumn("watermark", F.lit(100).cast("long"))
    shipped, _ = sweep.harvest(runs, lines, marks, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), F.lit(999 + 1).cast("long"), n_tail=2)
    return shipped.select("workflow", "run_id", "line_no", "collected_ns")


@query("shipped_marks", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN max(event_id) ELSE 7 END AS watermark FROM events GROUP BY 1")
def shipped_marks(spark, sf):
    """Watermarks move for the keys whose rows the sink took; the others keep theirs."""
    marks = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("watermark"))
    before = marks.select("user_id", F.lit(7).cast("long").alias("watermark"))
    return sweep.ship(marks, marks, before, ["user_id"], lambda batch: batch.filter("user_id % 2 = 0"))


@query("cursors", "SELECT event_type AS category, CASE WHEN event_type = 'view' THEN '2030-01-01' ELSE strftime(max(ts), '%Y-%m-%d') END AS day FROM events GROUP BY 1")
def cursors(spark, sf):
    """The larger of each category's cursor and its newest row."""
    rows = table(spark, sf, "events").select("event_type", "ts")
    known = rows.filter("event_type = 'view'").groupBy(F.col("event_type").alias("category")).agg(F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("cursor"))
    return sweep.advance_cursors(known, rows, "event_type", "ts").select("category", F.date_format("cursor", "yyyy-MM-dd").alias("day"))


@query("upsert_tags", "SELECT doc_id, lang AS tag, CASE WHEN source IN ('src1', 'src2') THEN 0.9 ELSE 0.5 END AS score FROM documents")
def upsert_tags(spark, sf):
    stored = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("tag"), F.lit(0.5).alias("score"))
    new = table(spark, sf, "documents").filter("source IN ('src1', 'src2')").select("doc_id", F.col("lang").alias("tag"), F.lit(0.9).alias("score"))
    return sinks.upsert_bill_tags(stored, new, ["doc_id", "tag"])


@query("dropped_keys", """SELECT p_partkey, '{"name":"' || p_name || '","parts":[{"size":' || p_size || '}]}' AS value FROM part""")
def dropped_keys(spark, sf):
    """Ids and scrape times go at every depth."""
    rows = table(spark, sf, "part").select(
        "p_partkey", F.struct(F.lit("x").alias("_id"), F.col("p_name").alias("name"), F.array(F.struct(F.col("p_size").alias("size"), F.lit("y").alias("scraped_at"))).alias("parts")).alias("o")
    )
    return rows.select("p_partkey", F.to_json(records.drop_keys(F.col("o"), rows.schema["o"].dataType)).alias("value"))


@query("html_parsed", """SELECT page_id, CASE WHEN contains(html, '<title>') THEN 1 ELSE 0 END AS titled, CASE WHEN html IS NULL THEN 0 ELSE 1 END AS has_text FROM pages""")
def html_parsed(spark, sf):
    """Titles by the parser, where pages have one."""
    parsed = table(spark, sf, "pages").select("page_id", docs_ops.parse_html("html").alias("p"))
    return parsed.select("page_id", F.col("p.title").isNotNull().cast("int").alias("titled"), F.col("p.text").isNotNull().cast("int").alias("has_text"))


@query("unfiltered_noise", "SELECT conv_id, turn FROM conversations")
def unfiltered_noise(spark, sf):
    """The filter called none keeps every log; a tag that is asked for must be defined."""
    logs = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    defs = tagging.tag_defs(spark, {"trade": {}})
    tagged = logs.withColumn("tag", F.lit(filters.check_tag(defs, "trade")))
    return rules.filter_noise(tagged, rules.default_rule_sets(), "role", F.col("text"), F.array("role"), alias="none").filter("tag = 'trade'").select("conv_id", "turn")


# --- gates, hashes, orders, scalars

@query("session_gate_expected", """SELECT gate, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN 'missing_session' WHEN p_size <= 10 THEN 'unknown_session' WHEN p_size <> 20 AND p_brand < 'Brand#2' THEN 'wrong_session' ELSE 'ok' END AS gate FROM part) GROUP BY 1""")
def session_gate_expected(spark, sf):
    """All three categories: no session, an unknown one, and for some rows one other than the expected."""
    part = table(spark, sf, "part")
    rows = part.select("p_brand", F.when(F.col("p_size") > 40, "").otherwise(F.col("p_size").cast("string")).alias("session_id"))
    known = part.filter("p_size > 10").select(F.col("p_size").cast("string").alias("session_id"))
    return filters.session_gate(rows, known, ["session_id"], F.when(F.col("p_brand") < "Brand#2", "20")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("undated", """SELECT CASE kind WHEN 'events' THEN 'from_is_newer_than_latest_missing_event_date' WHEN 'vote_events' THEN 'from_is_newer_than_latest_missing_vote_date' ELSE 'from_is_newer_than_latest_unknown_category' END AS category, count(*) AS n
       FROM (SELECT CASE event_type WHEN 'view' THEN 'events' WHEN 'click' THEN 'vote_events' ELSE 'bills' END AS kind, value FROM events) WHERE value > 50 OR kind = 'bills' GROUP BY 1""")
def undated(spark, sf):
    kind = F.when(F.col("event_type") == "view", "events").when(F.col("event_type") == "click", "vote_events").otherwise("bills")
    rows = table(spark, sf, "events").select(kind.alias("kind"), F.when(F.col("value") <= 50, F.col("ts")).alias("ts"))
    return filters.undated(rows, "kind", "ts").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash", """SELECT doc_id, sha256('{"action":{"a":' || n_chars || ',"z":"' || lang || '"},"bill":{"b":[{"c":"' || source || '","d":null}],"title":"' || sha256(text) || '"}}') AS content_hash FROM documents""")
def content_hash(spark, sf):
    """Keys sorted at every depth, volatile fields left out."""
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.struct(F.sha2("text", 256).alias("title"), F.lit("x").alias("scraped_at"), F.array(F.struct(F.lit(None).cast("string").alias("d"), F.col("source").alias("c"))).alias("b")).alias("bill"),
        F.struct(F.col("lang").alias("z"), F.col("n_chars").alias("a")).alias("action"),
    )
    return rows.select("doc_id", records.content_hash("bill", "action", schema=rows.schema).alias("content_hash"))


@query("config_hash", """SELECT p_partkey, sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || ',"gone":null}') AS config_hash FROM part""")
def config_hash(spark, sf):
    defs = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.lit(None).cast("string").alias("gone"))
    return tagging.config_hash(defs).select("p_partkey", "config_hash")


@query("sorted_logs", """SELECT event_id, stamp FROM (SELECT event_id, CASE WHEN value > 20 THEN strftime(ts, '%Y%m%dT%H%M%SZ') END AS stamp FROM events) ORDER BY stamp DESC NULLS LAST, event_id::VARCHAR LIMIT 200""")
def sorted_logs(spark, sf):
    """The newest logs; those without a stamp come last."""
    logs = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 20, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("stamp"), F.col("event_id").cast("string").alias("path"))
    return latest.sort_logs(logs, True, "stamp", "path").limit(200).select("event_id", "stamp")


@query("dashboard_order", """SELECT state, session, id FROM (SELECT CASE WHEN p_size > 5 THEN p_type END AS state, p_brand AS session, p_partkey AS id FROM part) ORDER BY coalesce(state, ''), session, id LIMIT 300""")
def dashboard_order(spark, sf):
    bills = table(spark, sf, "part").select(F.when(F.col("p_size") > 5, F.col("p_type")).alias("state"), F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"))
    return sinks.dashboard_order(bills).limit(300)


@query("dashboard_document", f"""WITH b AS (SELECT s_suppkey AS id, {SQL_STATE} AS state, CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS tag FROM supplier WHERE s_acctbal > 0)
       SELECT (SELECT count(DISTINCT state) FROM b) AS n_states, (SELECT count(DISTINCT {SQL_STATE}) FROM supplier WHERE {SQL_STATE} NOT IN (SELECT state FROM b)) AS n_empty,
              (SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM b) AS tags, (SELECT count(*) FROM b) AS n_bills, (SELECT arg_min(id, (state, id)) FROM b) AS first_bill""")
def dashboard_document(spark, sf):
    """The dashboard's one document with its bills, read back."""
    rows = _suppliers(spark, sf)
    bills = rows.filter("s_acctbal > 0").select("state", F.lit("s").alias("session"), F.col("s_suppkey").alias("id"), F.array(F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor")).alias("tags"))
    defs = spark.sql("SELECT 'rich' AS name, 'much' AS description")
    one = sinks.dashboard(bills, defs, F.lit("now"), "src", rows, with_bills=True)
    kind = "states array<struct<code:string,name:string>>, empty_jurisdictions array<struct<code:string,name:string>>, tags array<struct<name:string,description:string>>, bills array<struct<id:bigint,state:string>>"
    d = one.select(F.from_json("document", kind).alias("d"))
    return d.select(
        F.size("d.states").cast("long").alias("n_states"), F.size("d.empty_jurisdictions").cast("long").alias("n_empty"), F.array_join(F.col("d.tags")["name"], ",").alias("tags"),
        F.size("d.bills").cast("long").alias("n_bills"), F.get("d.bills", 0)["id"].alias("first_bill"),
    )


@query("jurisdictions", f"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN {SQL_STATE} WHEN 1 THEN 'usa' WHEN 2 THEN 'pr' ELSE 'zz' END AS code, CASE s_suppkey % 4 WHEN 1 THEN 'United States' WHEN 2 THEN 'Puerto Rico' WHEN 3 THEN 'ZZ' ELSE 'named' END AS name,
       CASE WHEN s_acctbal > 0 THEN '2024' ELSE (2020 + s_suppkey % 5)::VARCHAR END AS session_id, lower({SQL_STATE}) || '-legislation' AS repo, {SQL_STATE} AS locale FROM supplier""")
def jurisdictions(spark, sf):
    """Codes and names of jurisdictions, the session of a path, and repository names there and back."""
    rows = _suppliers(spark, sf)
    kind = F.col("s_suppkey") % 4
    ref = F.when(kind == 0, F.concat(F.lit("ocd-jurisdiction/country:us/state:"), "state", F.lit("/government"))).when(kind == 1, "ocd-jurisdiction/country:us/government").when(kind == 2, "Commonwealth").otherwise("nowhere")
    code = keys.jurisdiction_code(ref, F.lit("zz"), {"commonwealth": "pr"})
    name = keys.jurisdiction_name(F.when(kind == 0, "named"), F.col("code"))
    repo = keys.repo_name(F.upper("state"))
    out = rows.select("s_suppkey", code.alias("code"), keys.session_of(F.when(F.col("s_acctbal") > 0, "2024").otherwise(""), F.concat(_bill_folder(), F.lit("/x"))).alias("session_id"), repo.alias("repo"))
    return out.select("s_suppkey", "code", name.alias("name"), "session_id", "repo", keys.locale_of_repo(F.concat("repo", F.lit("/a/b"))).alias("locale"))


@query("scalars", """SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Tag' AS title, substr(props, 1, 5) AS cut, CASE WHEN event_id % 3 = 0 THEN 'xml' WHEN event_id % 3 = 1 THEN 'pdf' ELSE 'html' END AS sniffed,
       CASE WHEN event_id % 2 = 0 THEN event_type || '-' || user_id END AS session, event_type || '_' || user_id || '.json' AS file,
       CASE WHEN event_id % 4 = 0 THEN '2026-12-31' ELSE '2025-06-30' END AS ends, CASE WHEN event_id % 2 = 0 THEN '20240101T000000Z' END AS legacy FROM events""")
def scalars(spark, sf):
    """Scalar functions that other queries don't reach."""
    n = F.col("event_id")
    head = F.when(n % 3 == 0, "  <?xml version='1.0'?>").when(n % 3 == 1, "%PDF-1.4").otherwise("<html>")
    name = F.when(n % 4 == 0, "2025-2026 Session").when(n % 4 == 1, "2020-2021").otherwise("One")
    return table(spark, sf, "events").select(
        "event_id", text.title_case(F.concat("event_type", F.lit("_tag"))).alias("title"), text.truncate(F.col("props"), 5).alias("cut"), text.sniff(F.lit(None).cast("string"), head).alias("sniffed"),
        text.session_slug(F.concat(F.lit(" "), F.upper("event_type"), F.when(n % 2 == 0, "_").otherwise("/"), "user_id")).alias("session"),
        text.file_slug(F.concat(F.lit("/"), "event_type", F.lit(" : "), "user_id", F.lit(".json"))).alias("file"),
        F.date_format(times.corrected_end_date(name, F.lit("x"), F.lit("2025-06-30").cast("date")), "yyyy-MM-dd").alias("ends"),
        times.legacy_timestamp(F.concat(F.lit("a_b/20240101T000000Z"), F.when(n % 2 == 0, "_x.json").otherwise(".json"))).alias("legacy"),
    )


@query("picked_repos", "SELECT s_name FROM supplier WHERE s_nationkey IN (3, 7)")
def picked_repos(spark, sf):
    return filters.pick_repos(_suppliers(spark, sf), f"{CODES[3]}, {CODES[7]},", "state").select("s_name")


@query("tags_or_keywords", """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' ELSE d.lang END AS tags FROM documents d LEFT JOIN labels l USING (doc_id)""")
def tags_or_keywords(spark, sf):
    """Scored tags where there are any, else those by keywords."""
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").alias("tag")).filter("tag IS NOT NULL")
    out = joins.tags_or_keywords(table(spark, sf, "documents").select("doc_id", "lang"), labels, F.array("lang"), ["doc_id"])
    return out.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("linked_events", """SELECT event_id, arg_min(p, place) AS bill_id FROM (
         SELECT event_id, CASE place WHEN 0 THEN user_id * 7 % 300 WHEN 1 THEN user_id ELSE event_id % 200 END AS p, place FROM events, (SELECT unnest([0, 1, 2]) AS place))
         WHERE p IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1""")
def linked_events(spark, sf):
    """Events whose agenda names three bills, linked to the first that is known."""
    entity = lambda name: F.struct(F.lit("bill").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"), F.concat(F.lit("B "), name.cast("string")).alias("name"))
    person = F.struct(F.lit("person").alias("entity_type"), F.lit("B1").alias("entity_id"), F.lit("B1").alias("name"))
    agenda = F.array(F.struct(F.array(person, entity(F.col("user_id") * 7 % 300)).alias("related_entities")), F.struct(F.array(entity(F.col("user_id")), entity(F.col("event_id") % 200)).alias("related_entities")))
    rows = table(spark, sf, "events").select(F.lit("x").alias("state"), "event_id", agenda.alias("agenda"))
    bills = table(spark, sf, "part").filter("p_size > 25").select(F.lit("x").alias("state"), F.concat(F.lit("B"), "p_partkey").alias("bill_id"), F.lit("s").alias("session_id"))
    linked, _ = normalise.linked_events(rows, normalise.bill_sessions(bills))
    return linked.select("event_id", F.substring("bill_id", 2, 20).cast("long").alias("bill_id"))


# --- feed text, rules of all locales, tag vectors

FEED_SQL = """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'https://x.example/bills/' || o_orderkey WHEN o_orderstatus <> 'P' THEN 'https://s.example/' || o_custkey END AS link,
  'id: HB' || o_orderkey || chr(10) || chr(10) || 'log:' || chr(10) || '  action:' || chr(10) || '    description: ' || o_orderpriority || chr(10) || '    date: ' || strftime(o_orderdate, '%Y-%m-%d')
  || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '    classification:' || chr(10) || '      - passage' || chr(10) || '      - other' ELSE '' END
  || chr(10) || '    organization_id: org' || chr(10) || '  bill_id: HB' || o_orderkey
  || CASE WHEN o_orderstatus = 'O' THEN '' ELSE chr(10) || chr(10) || 'bill:' || chr(10) || '  identifier: HB ' || o_orderkey || chr(10) || '  title: T' || o_custkey || chr(10) || '  legislative_session: ' || year(o_orderdate)
       || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '  subject:' || chr(10) || '    - a' || chr(10) || '    - b' ELSE '' END || chr(10) || '  abstract (short): s' || o_custkey || chr(10) || '  abstract: long' END AS description
FROM orders"""


@query("feed_text", FEED_SQL)
def feed_text(spark, sf):
    """The text block and the link of feed items, with and without a bill, classes, subjects and a base."""
    status, number = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    strings = lambda *values: F.array(*map(F.lit, values))
    action = F.struct(F.col("o_orderpriority").alias("description"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(status == "F", strings("passage", "other")).otherwise(F.array().cast("array<string>")).alias("classification"), F.lit("org").alias("organization_id"))
    abstract = lambda value, note: F.struct(value.cast("string").alias("abstract"), F.lit(note).alias("note"))
    bill = F.struct(
        F.concat(F.lit("HB "), number).alias("identifier"), F.concat(F.lit("T"), "o_custkey").alias("title"), F.year("o_orderdate").cast("string").alias("legislative_session"),
        F.when(status == "F", strings("a", "b")).alias("subject"), F.array(abstract(F.concat(F.lit("s"), "o_custkey"), "short"), abstract(F.lit(None), "x"), abstract(F.lit("long"), "")).alias("abstracts"),
    )
    rows = table(spark, sf, "orders").select("*", action.alias("action"), F.when(status != "O", bill).alias("bill"))
    base = F.when(F.col("o_totalprice") > 100000, "https://x.example//")
    return rows.select(
        "o_orderkey", records.feed_link(base, F.concat(F.lit("bills/"), number), F.when(status != "P", F.concat(F.lit("https://s.example/"), "o_custkey"))).alias("link"),
        records.feed_description(F.concat(F.lit("HB"), number), F.col("action"), F.concat(F.lit("HB"), number), F.col("bill")).alias("description"),
    )


@query("default_rows", """SELECT event_id, 'HB' || user_id AS id, 'p' || event_id AS log, CASE WHEN event_type <> 'error' THEN 'b' || user_id END AS bill, CASE WHEN event_type <> 'error' THEN 'T' || user_id END AS title FROM events""")
def default_rows(spark, sf):
    """The default selection of joined rows keeps the paths of log and bill."""
    there = F.col("event_type") != "error"
    bill = F.struct(
        F.concat(F.lit("T"), "user_id").alias("title"), F.lit(None).cast("array<string>").alias("abstracts"), F.lit(None).cast("array<string>").alias("subject"), F.lit("i").alias("identifier"),
        F.lit("s").alias("legislative_session"), F.lit("o").alias("from_organization"), F.concat(F.lit("b"), "user_id").alias("path"), F.array(F.struct(F.lit("u").alias("url"))).alias("sources"),
    )
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("HB"), "user_id").alias("bill_id"), F.struct(F.struct(F.col("event_id").cast("string").alias("description")).alias("action")).alias("log"), F.when(there, bill).alias("bill"),
        F.lit(None).cast("map<string,double>").alias("tags"), F.concat(F.lit("p"), "event_id").alias("path"), F.lit("t").alias("log_ts"),
    )
    out = topic_feed.select_default(rows)
    return out.select(F.col("log.action.description").cast("long").alias("event_id"), "id", F.element_at("sources", "log").alias("log"), F.element_at("sources", "bill").alias("bill"), "bill.title")


def _sql_rule(rule: str) -> str:
    """A rule's tests in SQL, from its alternatives."""
    def one(kind, value):
        quoted = "'" + value.replace("'", "''") + "'"
        return {"=": f"d = {quoted}", "^": f"starts_with(d, {quoted})", "~": f"contains(d, {quoted})", "<": f"strlen(d) < {value}"}[kind]

    return "(" + " OR ".join("(" + " AND ".join(one(*t) for t in tests) + ")" for tests in rules._alternatives(rule)) + ")"


def _rule_words() -> list[str]:
    """The texts that the rules of all locales test for."""
    return sorted({v for r in rules.default_rule_sets().values() for rule in r.rules for tests in rules._alternatives(rule) for kind, v in tests if kind != "<"})


def _rule_classes() -> list[str]:
    return sorted({c for r in rules.default_rule_sets().values() for c in r.classes})


def _locale_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda values: "[" + ", ".join(map(quote, values)) + "]"
    locales, words, classes = sorted(rules.default_rule_sets()) + ["dc"], _rule_words(), _rule_classes()
    noise = " ".join(
        f"WHEN {quote(k)} THEN " + " OR ".join([*(f"c = {quote(c)}" for c in r.classes), *map(_sql_rule, r.rules)])
        for k, r in rules.default_rule_sets().items() if r.classes or r.rules
    )
    return f"""WITH l AS (SELECT event_id, ({listed(locales)})[event_id % {len(locales)} + 1] AS state, CASE WHEN event_id % 11 = 0 THEN ({listed(classes)})[user_id % {len(classes)} + 1] ELSE 'x' END AS c,
           CASE WHEN user_id % 3 = 1 THEN 'x ' ELSE '' END || ({listed(words)})[event_id // {len(locales)} * 17 % {len(words)} + 1] || CASE WHEN user_id % 2 = 1 THEN ' ' || ({listed(words)})[user_id % {len(words)} + 1] ELSE '' END AS d FROM events)
       SELECT event_id, state FROM l WHERE NOT (CASE state {noise} ELSE false END)"""


@query("noise_of_locales", _locale_sql())
def noise_of_locales(spark, sf):
    """The package's rules of every locale over logs whose texts are put together from the rules' own words."""
    sets = rules.default_rule_sets()
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    locales, words, classes = sorted(sets) + ["dc"], _rule_words(), _rule_classes()
    n, user = F.col("event_id"), F.col("user_id")
    described = F.concat(F.when(user % 3 == 1, "x ").otherwise(""), at(words, F.floor(n / len(locales)) * 17 % len(words)), F.when(user % 2 == 1, F.concat(F.lit(" "), at(words, user % len(words)))).otherwise(""))
    logs = table(spark, sf, "events").select("event_id", at(locales, n % len(locales)).alias("state"), F.array(F.when(n % 11 == 0, at(classes, user % len(classes))).otherwise("x")).alias("classes"), described.alias("d"))
    return rules.filter_noise_by_locale(logs, sets, "state", "d", "classes").select("event_id", "state")


def _letters(texts):
    """A stand-in for a model: how often four letters occur."""
    return [[float(t.lower().count(c)) for c in "aeno"] for t in texts]


def _sql_letters(value: str) -> str:
    return "[" + ", ".join(f"(length({value}) - length(replace(lower({value}), '{c}', '')))::FLOAT" for c in "aeno") + "]"


@query("tag_vectors", f"""SELECT n_name AS tag, list_transform({_sql_letters("(n_name || ' Examples: ' || n_name || ' | one more')")}, lambda x: x::INT)::VARCHAR AS base, list_transform({_sql_letters("'one more'")}, lambda x: x::INT)::VARCHAR AS second, 2::BIGINT AS examples, 1::BIGINT AS negatives, suppliers
       FROM nation JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def tag_vectors(spark, sf):
    """Definitions per nation with suppliers: one vector of description and examples, one for each example and negative example."""
    used = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    defs = table(spark, sf, "nation").join(used, "n_nationkey").select(
        F.col("n_name").alias("name"), F.col("n_name").alias("description"), F.array(F.col("n_name"), F.lit("one more")).alias("examples"), F.array(F.lit("not this")).alias("negative_examples"), "suppliers"
    )
    shown = lambda v: F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ", "), F.lit("]"))
    out = tagging.tag_vectors(defs, _letters)
    return out.select(
        F.col("name").alias("tag"), shown(F.col("base_vector")).alias("base"), shown(F.get("example_vectors", 1)).alias("second"), F.size("example_vectors").cast("long").alias("examples"),
        F.size("negative_vectors").cast("long").alias("negatives"), "suppliers",
    )


@query("scored_tags", f"""WITH v AS (SELECT conv_id, turn, {_sql_letters("text")} AS v FROM conversations), s AS (SELECT conv_id, turn, list_cosine_similarity(v::DOUBLE[], [3, 5, 2, 1]::DOUBLE[]) AS base, list_cosine_similarity(v::DOUBLE[], [1, 0, 2, 7]::DOUBLE[]) AS neg FROM v WHERE list_sum(v) > 0)
       SELECT conv_id, turn, round(least(greatest(base - 0.25 * greatest(neg, 0), 0), 1), 4) AS score FROM s WHERE least(greatest(base - 0.25 * greatest(neg, 0), 0), 1) >= 0.7""")
def scored_tags(spark, sf):
    """Texts scored against one definition by vectors: threshold, negative example, no keyword."""
    texts = tagging.embed(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", _letters).filter(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x) > 0)
    vector = lambda *v: F.array(*(F.lit(float(x)) for x in v)).cast("array<float>")
    none = F.array().cast("array<string>")
    defs = spark.range(1).select(F.lit("t").alias("name"), none.alias("include_keywords"), none.alias("exclude_keywords"), F.lit(0.7).alias("threshold"), vector(3, 5, 2, 1).alias("base_vector"), F.array().cast("array<array<float>>").alias("example_vectors"), F.array(vector(1, 0, 2, 7)).alias("negative_vectors"))
    return tagging.score_tags(texts, defs).select("conv_id", "turn", F.round("score", 4).alias("score"))
