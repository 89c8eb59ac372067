"""Registered queries: joins, aggregates, latest rows, state and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawmill.operators import filters, joins, latest, quality, rules
from lawmill.plans import sql as stock
from lawmill.registry import query
from lawmill.sources.tables import table

STAMP = "%Y-%m-%d %H:%M:%S"


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(
    "logs_join_bill",
    """WITH ranked AS (
         SELECT l.*, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem l)
       SELECT l_orderkey, l_linenumber, l_suppkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS o_totalprice
       FROM ranked LEFT JOIN orders ON l_orderkey = o_orderkey WHERE rn <= 10""",
)
def logs_join_bill(spark, sf):
    """The newest logs per source with their bill; the limit comes before the join."""
    logs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    kept = latest.limit_per_key(logs, ["l_suppkey"], 10, F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"))
    bills = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    joined = joins.join_bills(kept, bills, ["l_orderkey"])
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", "bill.o_orderstatus", "bill.o_orderpriority", F.round("bill.o_totalprice", 2).alias("o_totalprice"))


@query(
    "logs_with_tag_names",
    """WITH tags AS (SELECT user_id, event_type, max(value) AS score FROM events GROUP BY 1, 2)
       SELECT c_custkey, (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM tags t WHERE t.user_id = c_custkey) AS tag_names,
              (SELECT round(max(score), 2) FROM tags t WHERE t.user_id = c_custkey) AS top_score FROM customer""",
)
def logs_with_tag_names(spark, sf):
    logs = table(spark, sf, "customer").select("c_custkey")
    tags = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("tag"), F.col("value").alias("score"))
    joined = joins.join_tags(logs, tags, ["c_custkey"])
    return joined.select("c_custkey", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tag_names"), F.round(F.array_max(F.map_values("tags")), 2).alias("top_score"))


RULES = {
    "user": rules.RuleSet(("system",), ('^"The "', '~"the of" AND bytes < 400', '="Yes."')),
    "assistant": rules.RuleSet((), ('^"In " OR ^"On " AND ~"and"', '^"Is " AND (~"that" OR ~"with")')),
    "system": rules.RuleSet(("system",), ()),
}


@query(
    "noise_filter",
    """SELECT conv_id, turn, role FROM conversations WHERE NOT (
         CASE role WHEN 'user' THEN coalesce(starts_with(text, 'The ') OR (contains(text, 'the of') AND strlen(text) < 400) OR text = 'Yes.', false)
                   WHEN 'assistant' THEN coalesce(starts_with(text, 'In ') OR (starts_with(text, 'On ') AND contains(text, 'and'))
                        OR (starts_with(text, 'Is ') AND (contains(text, 'that') OR contains(text, 'with'))), false)
                   WHEN 'system' THEN true ELSE false END)""",
)
def noise_filter(spark, sf):
    logs = table(spark, sf, "conversations")
    kept = rules.filter_noise(logs, RULES, state="role", description=F.col("text"), classes=F.array("role"))
    return kept.select("conv_id", "turn", "role")


@query("noise_filter_by_table", """SELECT conv_id, turn, role FROM conversations WHERE NOT (
         CASE role WHEN 'user' THEN coalesce(starts_with(text, 'The ') OR (contains(text, 'the of') AND strlen(text) < 400) OR text = 'Yes.', false)
                   WHEN 'assistant' THEN coalesce(starts_with(text, 'In ') OR (starts_with(text, 'On ') AND contains(text, 'and'))
                        OR (starts_with(text, 'Is ') AND (contains(text, 'that') OR contains(text, 'with'))), false)
                   WHEN 'system' THEN true ELSE false END)""")
def noise_filter_by_table(spark, sf):
    """The same rules as a broadcast table, for rule sets too large for one expression."""
    logs = table(spark, sf, "conversations").withColumn("classes", F.array("role"))
    return rules.filter_noise_by_locale(logs, RULES, "role", "text", "classes").select("conv_id", "turn", "role")


@query(
    "bills_by_state",
    """SELECT n_name AS state, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def bills_by_state(spark, sf):
    """Counted per customer before the joins, so that they see a row per customer."""
    bills = table(spark, sf, "orders").groupBy("o_custkey").count()
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return bills.join(people, "o_custkey").groupBy("n_nationkey").agg(F.sum("count").alias("n")).join(table(spark, sf, "nation"), "n_nationkey").select(F.col("n_name").alias("state"), "n")


@query(
    "bills_by_state_session",
    """SELECT n_name AS state, year(o_orderdate)::INT AS session, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def bills_by_state_session(spark, sf):
    bills = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("session")).count()
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    grouped = bills.join(people, "o_custkey").groupBy("n_nationkey", "session").agg(F.sum("count").alias("n"))
    return grouped.join(table(spark, sf, "nation"), "n_nationkey").select(F.col("n_name").alias("state"), "session", "n")


@query("distinct_by_class", """SELECT class, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS class FROM part) GROUP BY class""")
def distinct_by_class(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("class"))
    return rows.groupBy("class").agg(F.count_distinct("p_partkey").alias("n"))


@query("top_sponsors", """SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20""")
def top_sponsors(spark, sf):
    return latest.top(table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), 20, F.desc("n"), F.asc("l_suppkey"))


@query("action_counts", """SELECT l_orderkey, count(*) AS n_actions, count(DISTINCT l_suppkey) AS n_sponsors FROM lineitem GROUP BY 1""")
def action_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_actions"), F.count_distinct("l_suppkey").alias("n_sponsors"))


@query("passed_actions", """SELECT conv_id, turn, sentence FROM (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS sentence FROM conversations) WHERE sentence ILIKE '%the on%'""")
def passed_actions(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\. ", -1)).alias("sentence"))
    return rows.filter(F.col("sentence").ilike("%the on%"))


@query("stock_sql", """SELECT n_name AS state, o_orderkey % 4 AS session_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def stock_sql(spark, sf):
    """Bills as a view, then one of the stock questions in SQL."""
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("state"))
    bills = table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("state", (F.col("o_orderkey") % 4).alias("session_id"))
    return stock.ask(spark, stock.BILLS_BY_SESSION, bills=bills)


def _part_bills(spark, sf):
    """Parts as bills: two classes, two sponsors and actions by the words of the name."""
    sponsor = lambda name, first: F.struct(F.col(name).alias("name"), F.lit(first).alias("primary"))
    action = F.transform(F.split("p_name", " "), lambda w, i: F.struct(F.concat(F.lit("d"), i).alias("date"), F.concat(F.when(w.contains("red"), "Passed ").otherwise("Read "), w).alias("description")))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("bill_id"), F.col("p_type").alias("state"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("classification"),
        F.array(sponsor("p_brand", True), sponsor("p_type", False)).alias("sponsorships"), action.alias("actions"),
    )


@query("stock_by_state", "SELECT p_type AS state, count(*) AS n FROM part GROUP BY 1")
def stock_by_state(spark, sf):
    return stock.ask(spark, stock.BILLS_BY_STATE, bills=_part_bills(spark, sf))


@query("stock_by_class", "SELECT class, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS class FROM part) GROUP BY 1")
def stock_by_class(spark, sf):
    return stock.ask(spark, stock.DISTINCT_BY_CLASS, bills=_part_bills(spark, sf))


@query("stock_top_sponsors", "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def stock_top_sponsors(spark, sf):
    return stock.ask(spark, stock.TOP_SPONSORS, bills=_part_bills(spark, sf))


@query("stock_most_active", "SELECT p_partkey AS bill_id, len(string_split(p_name, ' '))::INT AS n_actions, 2 AS n_sponsors FROM part")
def stock_most_active(spark, sf):
    return stock.ask(spark, stock.MOST_ACTIVE, bills=_part_bills(spark, sf))


@query("stock_passed", "SELECT bill_id, 'd' || k AS date, 'Passed ' || w AS description FROM (SELECT p_partkey AS bill_id, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS k FROM part) WHERE contains(w, 'red')")
def stock_passed(spark, sf):
    return stock.ask(spark, stock.PASSED_ACTIONS, bills=_part_bills(spark, sf))


@query("stock_same_title", "SELECT a.p_name AS title, a.p_type AS state_a, b.p_type AS state_b FROM (SELECT DISTINCT p_name, p_type FROM part) a JOIN (SELECT DISTINCT p_name, p_type FROM part) b ON a.p_name = b.p_name AND a.p_type < b.p_type")
def stock_same_title(spark, sf):
    """Over one row per title and state, so that repeated titles of a state aren't paired."""
    return stock.ask(spark, stock.SAME_TITLE, bills=_part_bills(spark, sf).select("title", "state").distinct())


@query("activity_by_month", f"""SELECT strftime(date_trunc('month', o_orderdate), '{STAMP}') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def activity_by_month(spark, sf):
    return table(spark, sf, "orders").groupBy(_stamp(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "facets_grouping_sets",
    """SELECT event_type, user_id, grouping_id(event_type, user_id)::INT AS level, count(*) AS n FROM events
       GROUP BY GROUPING SETS ((event_type), (user_id), ())""",
)
def facets_grouping_sets(spark, sf):
    rows = table(spark, sf, "events")
    return rows.groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@query(
    "tiles",
    """SELECT count(*) AS bills, count(DISTINCT o_custkey) AS jurisdictions, count(DISTINCT year(o_orderdate)) AS sessions,
              round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6) AS share_tagged FROM orders""",
)
def tiles(spark, sf):
    return table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("bills"), F.count_distinct("o_custkey").alias("jurisdictions"), F.count_distinct(F.year("o_orderdate")).alias("sessions"),
        F.round(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")), 6).alias("share_tagged"),
    )


@query("dashboard_slice", """SELECT p_type AS state, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part WHERE p_name ILIKE '%red%' AND p_size > 10 GROUP BY 1""")
def dashboard_slice(spark, sf):
    bills = table(spark, sf, "part").select("*", F.col("p_type").alias("state"), F.col("p_name").alias("title")).filter("p_size > 10")
    return filters.slice_rows(bills, text="red").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


@query(
    "markup_rollup",
    """SELECT source, grouping(source)::INT AS is_total, count(*) FILTER (WHERE toxic IS NOT NULL) AS checked,
              count(*) FILTER (WHERE toxic = 1) AS hits, count(*) FILTER (WHERE toxic IS NULL) AS errors,
              CASE WHEN count(toxic) > 0 THEN round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(toxic), 2) END AS pct
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""",
)
def markup_rollup(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return quality.rate_with_total(rows, "source", F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("toxic").isNull())


@query(
    "backlog_cube",
    """SELECT source, lang, grouping_id(source, lang)::INT AS level, count(*) AS bills, count(l.doc_id) AS with_text, count(*) - count(l.doc_id) AS missing
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY CUBE (source, lang)""",
)
def backlog_cube(spark, sf):
    return quality.backlog(table(spark, sf, "documents").select("doc_id", "source", "lang"), table(spark, sf, "labels"), ["doc_id"], ["source", "lang"])


@query(
    "latest_action_asof",
    f"""SELECT l_orderkey, strftime(max(l_shipdate), '{STAMP}') AS latest_action, arg_min(l_linenumber, -epoch(l_shipdate) * 100 + l_linenumber)::INT AS line
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-31' GROUP BY 1""",
)
def latest_action_asof(spark, sf):
    """The latest action not after a day; of equal dates the first in the list."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    out = latest.latest_row_asof(rows, ["l_orderkey"], "l_shipdate", "l_linenumber", F.lit("1998-12-31").cast("timestamp_ntz"))
    return out.select("l_orderkey", _stamp(F.col("l_shipdate")).alias("latest_action"), F.col("l_linenumber").alias("line"))


@query("latest_nested_action", """SELECT doc_id, n_actions::BIGINT AS n_actions, day, place::BIGINT AS place FROM (
         SELECT doc_id, len(w) AS n_actions, list_max(list_filter(list_transform(w, lambda x: substr(x, 1, 3)), lambda x: x <= 'sss')) AS day,
                list_position(list_transform(w, lambda x: substr(x, 1, 3)), list_max(list_filter(list_transform(w, lambda x: substr(x, 1, 3)), lambda x: x <= 'sss'))) - 1 AS place
         FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE day IS NOT NULL""")
def latest_nested_action(spark, sf):
    """The same over a nested list: words play the actions, their first letters the dates."""
    actions = F.transform(F.split("text", " ", -1), lambda w, i: F.struct(F.substring(w, 1, 3).alias("date"), i.alias("place")))
    rows = table(spark, sf, "documents").select("doc_id", actions.alias("actions"))
    done = rows.select("doc_id", F.size("actions").cast("long").alias("n_actions"), latest.latest_past_action(F.col("actions"), F.lit("sss")).alias("a"))
    return done.filter("a IS NOT NULL").select("doc_id", "n_actions", F.col("a.date").alias("day"), F.col("a.place").cast("long").alias("place"))


@query(
    "dedup_best",
    """SELECT user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def dedup_best(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return latest.best_row(rows, ["user_id", "event_type"], F.struct("value", "event_id"))


@query("first_line_wins", """SELECT conv_id, arg_min(role, turn) AS role, arg_min(sha256(text), turn) AS text_hash FROM conversations GROUP BY 1""")
def first_line_wins(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))
    return latest.first_row(rows, ["conv_id"], F.col("turn")).select("conv_id", "role", "text_hash")


@query("dedup_guid", """SELECT sha256(text) AS guid, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def dedup_guid(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("guid")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("feed_top", """SELECT guid, doc_id FROM (SELECT sha256(text) AS guid, min(doc_id) AS doc_id FROM documents GROUP BY 1) ORDER BY doc_id DESC, guid LIMIT 100""")
def feed_top(spark, sf):
    """Dedup, then the newest hundred: a top-k, no full sort."""
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("guid")).agg(F.min("doc_id").alias("doc_id"))
    return latest.top(rows, 100, F.desc("doc_id"), F.asc("guid"))


@query(
    "session_gate",
    """SELECT gate, count(*) AS n FROM (
         SELECT CASE WHEN p.p_size % 7 = 0 THEN 'missing_session' WHEN s.p_size IS NULL THEN 'unknown_session' ELSE 'ok' END AS gate
         FROM part p LEFT JOIN (SELECT DISTINCT p_size FROM part WHERE p_size % 3 > 0 AND p_size % 7 > 0) s ON p.p_size = s.p_size) GROUP BY 1""",
)
def session_gate(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select("p_partkey", F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_size").cast("string")).alias("session_id"))
    known = part.filter("p_size % 3 > 0 AND p_size % 7 > 0").select(F.col("p_size").cast("string").alias("session_id"))
    return filters.session_gate(rows, known, ["session_id"]).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "in_session",
    """WITH sessions AS (SELECT o_custkey % 10 AS state, min(o_orderdate) + INTERVAL 1 YEAR AS s, CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE min(o_orderdate) + INTERVAL 2 YEAR END AS e FROM orders GROUP BY 1, o_custkey % 10)
       SELECT state, count(*) AS n FROM (SELECT o_custkey % 10 AS state, o_orderdate AS d FROM orders) JOIN sessions USING (state)
       WHERE s <= d AND (e IS NULL OR d <= e) GROUP BY 1""",
)
def in_session(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("state"), F.col("o_orderdate").alias("day"))
    first = rows.groupBy("state").agg(F.min("day").alias("first"))
    year = lambda n: F.col("first") + F.expr(f"INTERVAL '{n}' YEAR")
    sessions = first.select("state", year(1).alias("start_date"), F.when(F.col("state") != 3, year(2)).alias("end_date"))
    return joins.in_session(rows, sessions, "state", "day").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_first_known_bill",
    """SELECT user_id, arg_min(k, event_id) AS part FROM (
         SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
       WHERE k IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1""",
)
def event_first_known_bill(spark, sf):
    from lawmill.functions.records import json_path

    refs = table(spark, sf, "events").select("user_id", "event_id", json_path(F.col("props"), "k").cast("long").alias("part"))
    known = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("part"))
    return joins.first_match(refs, known, "user_id", "part", "event_id")


@query("orphans", """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS votes, count(*) FILTER (WHERE event_type <> 'view') AS events
       FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) GROUP BY 1""")
def orphans(spark, sf):
    from lawmill.plans.normalise import orphans as plan

    keyed = table(spark, sf, "events").select(F.lit("x").alias("state"), F.lit("s").alias("session_id"), F.col("user_id").alias("bill_id"), "event_type")
    bills = table(spark, sf, "customer").filter("c_acctbal > 2000").select(F.lit("x").alias("state"), F.lit("s").alias("session_id"), F.col("c_custkey").alias("bill_id"))
    out = plan(keyed.filter("event_type = 'view'"), keyed.filter("event_type <> 'view'"), bills)
    return out.select(F.col("bill_id").alias("user_id"), "votes", "events")


@query(
    "orphan_state_merge",
    """WITH now AS (SELECT o_custkey AS key, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1 AS orphan FROM orders GROUP BY 1),
            before AS (SELECT c_custkey AS key, c_custkey % 5 + 1 AS occurrences FROM customer WHERE c_acctbal > 3000)
       SELECT key, CASE WHEN coalesce(orphan, false) AND occurrences IS NULL THEN 'new' WHEN coalesce(orphan, false) THEN 'continuing'
                        WHEN occurrences IS NOT NULL AND orphan IS NOT NULL THEN 'resolved' WHEN occurrences IS NOT NULL THEN 'untouched' ELSE 'fine' END AS status,
              (coalesce(occurrences, 0) + CASE WHEN coalesce(orphan, false) THEN 1 ELSE 0 END)::BIGINT AS occurrences
       FROM now FULL JOIN before USING (key)""",
)
def orphan_state_merge(spark, sf):
    now = (
        table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key"))
        .agg(F.bool_or(F.col("o_orderstatus") == "O").alias("orphan"), F.lit("now").alias("seen"))
    )
    before = table(spark, sf, "customer").filter("c_acctbal > 3000").select(
        F.col("c_custkey").alias("key"), F.lit("then").alias("first_seen"), F.lit("then").alias("last_seen"), (F.col("c_custkey") % 5 + 1).alias("occurrences")
    )
    return joins.merge_state(now, before, "key", "seen").select("key", "status", "occurrences")


@query("chronic_orphans", """SELECT user_id, count(*) AS occurrences FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3""")
def chronic_orphans(spark, sf):
    return quality.chronic(table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("occurrences")))


@query("new_actions", """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber > 3 AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_linenumber <= 3
       AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey)""")
def new_actions(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.new_rows(rows.filter("l_linenumber > 3"), rows.filter("l_linenumber <= 3"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query(
    "merge_actions",
    """WITH old AS (SELECT p_partkey, upper(p_name) AS name FROM part WHERE p_size < 20)
       SELECT p.p_partkey, coalesce(o.name, p.p_name) AS name FROM part p LEFT JOIN old o USING (p_partkey)""",
)
def merge_actions(spark, sf):
    part = table(spark, sf, "part")
    incoming = part.select("p_partkey", F.col("p_name").alias("name"))
    return joins.merge_rows(incoming, part.filter("p_size < 20").select("p_partkey", F.upper("p_name").alias("name")), ["p_partkey"])


@query(
    "nearest_ancestor",
    """WITH paths AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
            owners AS (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+') AS owner FROM paths WHERE contains(path, '/en/')
                       UNION SELECT DISTINCT regexp_extract(path, '^[^/]+') FROM paths WHERE contains(path, '.org'))
       SELECT path, arg_max(owner, length(owner)) AS owner FROM paths JOIN owners ON path = owner OR starts_with(path, owner || '/') GROUP BY 1""",
)
def nearest_ancestor(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    deep = paths.filter(F.col("path").contains("/en/")).select(F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("at"))
    hosts = paths.filter(F.col("path").contains(".org")).select(F.regexp_extract("path", "^[^/]+", 0).alias("at"))
    return joins.nearest_ancestor(paths, deep.union(hosts).distinct(), "path", "at")


@query("same_title_pairs", """SELECT a.p_name AS title, a.p_type AS state_a, b.p_type AS state_b FROM (SELECT DISTINCT p_name, p_type FROM part) a
       JOIN (SELECT DISTINCT p_name, p_type FROM part) b ON a.p_name = b.p_name AND a.p_type < b.p_type""")
def same_title_pairs(spark, sf):
    return joins.same_title_pairs(table(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("state")), "title", "state")


@query("same_title_classes", """SELECT p_name AS title, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS states, count(*) AS n_rows, min(p_partkey) AS first_row FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def same_title_classes(spark, sf):
    out = joins.same_title(table(spark, sf, "part").select(F.col("p_name").alias("title"), "p_type", "p_partkey"), "title", "p_type", "p_partkey")
    return out.withColumn("states", F.array_join("states", ","))


@query("missing_text", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("has_text", """SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def has_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "overlap_exists",
    """WITH m AS (SELECT l_orderkey AS page, l_linenumber AS mark_id, l_orderkey * 10 + l_linenumber AS id, l_quantity AS x0, l_quantity + 20 AS x1, l_partkey % 40 AS top, l_partkey % 40 + 2 AS bottom FROM lineitem WHERE l_returnflag = 'A'),
            c AS (SELECT l_orderkey AS page, l_quantity AS x0, l_quantity + 1 AS x1, l_partkey % 40 AS top, l_partkey % 40 + 5 AS bottom FROM lineitem WHERE l_returnflag <> 'A')
       SELECT id, max(CASE WHEN c.page IS NOT NULL THEN 1 ELSE 0 END)::INT AS hit FROM m LEFT JOIN c ON m.page = c.page AND c.x0 < m.x1 AND c.x1 > m.x0
         AND c.top - 2 <= m.bottom AND c.bottom + 2 >= m.top GROUP BY id""",
)
def overlap_exists(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("top", F.col("l_partkey") % 40)
    marks = rows.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mark_id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 20).alias("x1"), "top", (F.col("top") + 2).alias("bottom"))
    chars = rows.filter("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("c_x0"), (F.col("l_quantity") + 1).alias("c_x1"), F.col("top").alias("c_top"), (F.col("top") + 5).alias("c_bottom"))
    out = joins.overlapping(marks, chars, ["page"])
    return out.groupBy(F.col("mark_id").alias("id")).agg(F.max(F.col("hit").cast("int")).alias("hit"))


@query(
    "reconcile_sources",
    """WITH a AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size <= 40), b AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_retailprice > 950),
            j AS (SELECT coalesce(a.p_brand, b.p_brand) AS brand, a.p_name AS an, b.p_name AS bn FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_name = b.p_name),
            c AS (SELECT brand, count(*) FILTER (WHERE an IS NOT NULL AND bn IS NOT NULL) AS "both", count(*) FILTER (WHERE bn IS NULL) AS only_a, count(*) FILTER (WHERE an IS NULL) AS only_b FROM j GROUP BY 1)
       SELECT *, CASE WHEN only_a = 0 AND only_b = 0 THEN 'agree' WHEN only_a = 0 OR only_b = 0 THEN 'subset' ELSE 'split' END AS verdict FROM c""",
)
def reconcile_sources(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_name", "p_size", "p_retailprice")
    return quality.reconcile(part.filter("p_size <= 40"), part.filter("p_retailprice > 950"), ["brand"], "p_name")


@query(
    "union_backfill",
    """SELECT p_name, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) AS rn
       FROM (SELECT p_name, p_size, p_partkey FROM part WHERE p_brand <= 'Brand#2' UNION ALL SELECT p_name, p_size + 1, p_partkey FROM part WHERE p_brand > 'Brand#2')) WHERE rn = 1""",
)
def union_backfill(spark, sf):
    part = table(spark, sf, "part")
    of = lambda condition: part.filter(condition).select("p_name", "p_size", "p_partkey")
    sources = [of("p_brand <= 'Brand#2'"), of("p_brand > 'Brand#2'").withColumn("p_size", F.col("p_size") + 1)]
    return quality.union_backfill(sources, ["p_name"], F.struct("p_size", "p_partkey"))


@query(
    "expected_vs_actual",
    """SELECT s AS name, 'missing' AS status FROM (SELECT DISTINCT p_name AS s FROM part WHERE p_size <= 10 EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#2')
       UNION ALL SELECT s, 'surplus' FROM (SELECT DISTINCT p_name AS s FROM part WHERE p_brand = 'Brand#2' EXCEPT SELECT p_name FROM part WHERE p_size <= 10)""",
)
def expected_vs_actual(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_name", "name")
    return quality.expected_vs_actual(part.filter("p_size <= 10").select("name").distinct(), part.filter("p_brand = 'Brand#2'"), "name")


GUARD = """SELECT o_orderpriority AS k, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS old_rows,
       count(DISTINCT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_custkey END) AS old_ids,
       count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS new_rows,
       count(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_custkey END) AS new_ids FROM orders GROUP BY 1"""


def _guarded(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), "o_custkey", "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return quality.shrink_guard(rows.filter(F.col("o_orderdate") < cut), rows.filter(F.col("o_orderdate") >= cut), ["k"], "o_custkey")


@query("shrink_guard", f"SELECT *, CASE WHEN new_rows < old_rows AND new_ids < old_ids THEN 1 ELSE 0 END AS refuse FROM ({GUARD})")
def shrink_guard(spark, sf):
    return _guarded(spark, sf).withColumn("refuse", F.col("refuse").cast("int"))


@query("content_change", f"SELECT k, CASE WHEN new_ids < old_ids THEN 'dropped' WHEN new_ids > old_ids THEN 'net_new' WHEN new_rows <> old_rows THEN 'rescraped' ELSE 'unchanged' END AS change FROM ({GUARD})")
def content_change(spark, sf):
    return quality.content_change(_guarded(spark, sf)).select("k", "change")


@query(
    "ledger_changes",
    """WITH now AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
            before AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE lang <> 'de')
       SELECT n.doc_id, content_hash FROM now n LEFT JOIN before b ON n.doc_id = b.doc_id WHERE b.doc_id IS NULL OR content_hash IS DISTINCT FROM h""",
)
def ledger_changes(spark, sf):
    now = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "lang")
    before = now.filter("lang <> 'de'").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("content_hash")))
    return filters.changed_by_hash(now, before, ["doc_id"]).select("doc_id", "content_hash")


@query("changed_by_count", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') OR count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') = 0""")
def changed_by_count(spark, sf):
    def bills(rows):
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    orders = table(spark, sf, "orders")
    old = bills(orders.filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")))
    return filters.changed_by_count(bills(orders), old, ["o_custkey"], F.col("n")).select("o_custkey", "n")


@query("newer_than_cursor", """SELECT event_type, count(*) AS n FROM events e JOIN (SELECT event_type AS t, avg(epoch_us(ts))::BIGINT AS c FROM events WHERE event_type <> 'view' GROUP BY 1) ON event_type = t WHERE epoch_us(ts) // 86400000000 > c // 86400000000 GROUP BY 1
       UNION ALL SELECT 'view', count(*) FROM events WHERE event_type = 'view'""")
def newer_than_cursor(spark, sf):
    rows = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    mean = rows.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("category")).agg(F.avg(micros).cast("long").alias("m"))
    cursors = mean.select("category", F.date_trunc("day", F.timestamp_add("MICROSECOND", F.col("m"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))).alias("cursor"))
    return filters.newer_than(rows, cursors, "event_type", "day").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("quarantine_split", """SELECT category, count(*) AS n FROM (SELECT CASE WHEN toxic IS NULL THEN 'missing_label' ELSE 'good' END AS category FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def quarantine_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    good, bad = filters.require(rows, ["source", "toxic"], "missing_label")
    return good.withColumn("category", F.lit("good")).unionByName(bad, allowMissingColumns=True).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("collision_names", """SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) > 1 THEN p_name || '_' || p_partkey ELSE p_name END AS p_name FROM part""")
def collision_names(spark, sf):
    return latest.rename_collisions(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "p_name")


@query("poll_latest_completed", """SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE value > 20) AS latest_conclusion, max(event_id) FILTER (WHERE value > 20 AND event_type = 'purchase') AS last_success
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY 1""")
def poll_latest_completed(spark, sf):
    runs = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("id"), F.when(F.col("value") > 20, "completed").otherwise("queued").alias("status"),
        F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type")).alias("conclusion"), F.col("event_id").alias("created_at"),
    )
    out = latest.latest_runs(runs, ["user_id"])
    return out.withColumn("latest_conclusion", F.when(F.col("latest_conclusion") == "success", "purchase").otherwise(F.col("latest_conclusion")))


@query("version_ends", """SELECT conv_id, arg_min(role, turn) AS earliest, arg_max(role, turn) AS latest FROM conversations GROUP BY 1""")
def version_ends(spark, sf):
    return latest.ends(table(spark, sf, "conversations"), ["conv_id"], "turn", "role")


@query("sample_last_session", """WITH b AS (SELECT o_custkey % 20 AS state, year(o_orderdate)::INT AS session_id, o_orderkey AS bill_id FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY bill_id) AS rn FROM b WHERE session_id = (SELECT max(session_id) FROM b c WHERE c.state = b.state))
       SELECT state, session_id, bill_id FROM r WHERE rn <= 5""")
def sample_last_session(spark, sf):
    bills = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("state"), F.year("o_orderdate").alias("session_id"), F.col("o_orderkey").alias("bill_id"))
    return latest.sample_last_session(bills, 5)


@query("upsert_merge", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size % 4 = 0 THEN 'new' ELSE 'old' END AS stamp FROM part""")
def upsert_merge(spark, sf):
    """Upsert that keeps the stored processing map but for our own stamp."""
    from lawmill.sinks import upsert_bills

    part = table(spark, sf, "part")
    stored = part.select("p_partkey", "p_name", F.create_map(F.lit("text_extraction_latest_update"), F.lit("old")).alias("processing"))
    incoming = part.filter("p_size % 2 = 0").select(
        "p_partkey", F.upper("p_name").alias("p_name"),
        F.when(F.col("p_size") % 4 == 0, F.create_map(F.lit("text_extraction_latest_update"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>")).alias("processing"),
    )
    out = upsert_bills(stored, incoming, ["p_partkey"])
    return out.select("p_partkey", "p_name", F.element_at("processing", "text_extraction_latest_update").alias("stamp"))
