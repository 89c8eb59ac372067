"""Registered queries: topic scoring, documents, scalar functions, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawmill import sinks
from lawmill.functions import keys, records, text, times
from lawmill.operators import documents as docs_ops
from lawmill.operators import filters, latest, quality, tagging
from lawmill.registry import query
from lawmill.session import materialise, small
from lawmill.sources.tables import spread, table

TAGS = {
    "trade": {"include_keywords": ["the", "of the", "einer"], "exclude_keywords": ["idiot"], "threshold": 0.5},
    "energy": {"include_keywords": ["une", "license", "en"], "exclude_keywords": [], "threshold": 0.7},
    "health": {"include_keywords": ["los", "und die"], "exclude_keywords": ["the"], "threshold": 0.55},
}
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _sql_hit(word: str) -> str:
    if " " in word:
        return f"contains(lower(text), '{word}')"
    return f"regexp_matches(lower(text), '(?:^|{EDGE}){word}(?:\\+|$|{EDGE})')"


def _sql_tags() -> str:
    parts = []
    for tag, d in TAGS.items():
        hits = " || ".join(f"CASE WHEN {_sql_hit(w)} THEN '{w},' ELSE '' END" for w in d["include_keywords"])
        clear = " AND ".join(f"NOT {_sql_hit(w)}" for w in d["exclude_keywords"]) or "true"
        parts.append(f"SELECT doc_id, '{tag}' AS tag, rtrim({hits}, ',') AS keywords, {max(d['threshold'], 0.6)}::DOUBLE AS score FROM documents WHERE ({hits}) <> '' AND {clear}")
    return " UNION ALL ".join(parts)


@query("keyword_tags", _sql_tags())
def keyword_tags(spark, sf):
    out = tagging.tag_by_keywords(spread(table(spark, sf, "documents").select("doc_id", "text")), tagging.tag_defs(spark, TAGS))
    return out.select("doc_id", "tag", F.array_join("keywords", ",").alias("keywords"), "score")


WORDS = f"list_distinct(regexp_split_to_array(lower(text), '{EDGE}+'))"


@query(
    "keyword_tags_many",
    f"""WITH d AS (SELECT conv_id * 100 + turn AS tag, {WORDS} AS w FROM conversations),
            k AS (SELECT tag, word, length(word) > 12 AS out FROM (SELECT tag, unnest(w) AS word FROM d) WHERE regexp_full_match(word, '[a-z]{{7,}}')),
            h AS (SELECT doc_id, tag, word, out FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) JOIN k USING (word))
       SELECT doc_id, tag, count(*) AS n, min(word) AS first_word FROM h GROUP BY doc_id, tag HAVING NOT bool_or(out)""",
)
def keyword_tags_many(spark, sf):
    """Every turn of every conversation is a definition: its words of 7 to 12 letters are keywords, longer ones exclude."""
    words = F.array_distinct(F.split(F.lower("text"), EDGE + "+"))
    of_size = lambda least, most: F.filter(words, lambda w: w.rlike(f"^[a-z]{{{least},{most}}}$"))
    defs = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("name"), of_size(7, 12).alias("include_keywords"),
        of_size(13, 999).alias("exclude_keywords"), F.lit(0.5).alias("threshold"),
    )
    out = tagging.tag_by_keywords(spread(table(spark, sf, "documents").select("doc_id", "text")), defs, inline=0, keep=["doc_id"])
    return out.select("doc_id", F.col("tag").cast("long").alias("tag"), F.size("keywords").cast("long").alias("n"), F.array_min("keywords").alias("first_word"))


def _sql_cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


@query(
    "scored_tags_many",
    f"""WITH m AS (SELECT label, part, list(x ORDER BY i) AS v FROM (SELECT label, part, i, avg(e) AS x FROM (
              SELECT label, vec_id % 6 AS part, unnest(embedding)::DOUBLE AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2, 3) GROUP BY 1, 2),
            d AS (SELECT a.label, a.part, a.v, e.v AS ex, f.v AS ey, n.v AS neg, 0.1 + a.part / 20.0 AS threshold FROM m a
                  LEFT JOIN m e ON e.label = a.label AND e.part = (a.part + 1) % 6 LEFT JOIN m f ON f.label = a.label AND f.part = (a.part + 2) % 6 LEFT JOIN m n ON n.label = (a.label + 1) % 10 AND n.part = a.part),
            p AS (SELECT vec_id, d.label || '-' || part AS tag, threshold, vec_id % 9 = part AS out, label_of = d.label AS kw,
                    {_sql_cos('embedding::DOUBLE[]', 'v')} AS base, greatest({_sql_cos('embedding::DOUBLE[]', 'ex')}, {_sql_cos('embedding::DOUBLE[]', 'ey')}) AS example, {_sql_cos('embedding::DOUBLE[]', 'neg')} AS negative
                  FROM (SELECT vec_id, label AS label_of, embedding FROM embeddings), d),
            w AS (SELECT *, (coalesce(base * 0.35, 0) + coalesce(example * 0.25, 0) + 0.4) / (0.4 + CASE WHEN base IS NULL THEN 0 ELSE 0.35 END + CASE WHEN example IS NULL THEN 0 ELSE 0.25 END) AS with_word,
                    (coalesce(base * 0.5, 0) + coalesce(example * 0.35, 0)) / (CASE WHEN base IS NULL THEN 0 ELSE 0.5 END + CASE WHEN example IS NULL THEN 0 ELSE 0.35 END) AS without FROM p),
            s AS (SELECT vec_id, tag, threshold, CASE WHEN out THEN 0 ELSE least(greatest(CASE WHEN kw THEN greatest(with_word, threshold) ELSE without END - 0.25 * greatest(coalesce(negative, 0), 0), 0), 1) END::DOUBLE AS score FROM w)
       SELECT vec_id, tag, round(score, 4) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tag) AS place FROM s WHERE score >= threshold""",
)
def scored_tags_many(spark, sf):
    """A definition for each label and sixth of its vectors: mean vectors as description, examples and negative example, the
    label as keyword, the sixth as excluded one."""
    rows = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 6).alias("part"), "vec_id", "embedding")
    each = rows.select("label", "part", F.posexplode("embedding").alias("i", "x")).groupBy("label", "part", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = materialise(each.groupBy("label", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")))
    moved = lambda name, label, part: means.select(label.alias("label"), part.alias("part"), F.col("v").alias(name))
    label, part = F.col("label"), F.col("part")
    all_of = means.join(moved("ex", label, (part + 5) % 6), ["label", "part"], "left").join(moved("ey", label, (part + 4) % 6), ["label", "part"], "left")
    all_of = all_of.join(moved("neg", (label + 9) % 10, part), ["label", "part"], "left")
    defs = all_of.select(
        F.concat_ws("-", "label", "part").alias("name"), F.array(F.concat(F.lit("Word"), "label")).alias("include_keywords"),
        F.array(F.concat(F.lit("out"), "part")).alias("exclude_keywords"), (0.1 + F.col("part") / 20).alias("threshold"), F.col("v").alias("base_vector"),
        F.array_compact(F.array("ex", "ey")).alias("example_vectors"), F.array_compact(F.array("neg")).alias("negative_vectors"),
    )
    text = F.format_string("word%d and out%d", "label", F.col("vec_id") % 9)
    texts = rows.select("vec_id", text.alias("text"), F.col("embedding").alias("vector"))
    return tagging.score_tags(texts, defs).select("vec_id", "tag", F.round("score", 4).alias("score"), F.col("place").cast("long").alias("place"))


@query("dashboard_keyword_tags", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(?:^|{EDGE})of\\s+the(?:$|{EDGE})') OR regexp_matches(lower(text), '(?:^|{EDGE})une(?:$|{EDGE})')")
def dashboard_keyword_tags(spark, sf):
    return table(spark, sf, "documents").filter(tagging.dashboard_keywords(F.col("text"), ["of the", "une"])).select("doc_id")


CENTROIDS = """c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(e) AS x FROM (
    SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def _centroids(spark, sf):
    """Mean vector per label: positions are averaged, so that no task gathers a label's vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


@query(
    "cosine_topk",
    f"""WITH {CENTROIDS}, s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, c)
        SELECT vec_id, label, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10""",
)
def cosine_topk(spark, sf):
    """The ten vectors nearest to each label's mean; the means are a small table (one row per label)."""
    both = table(spark, sf, "embeddings").select("vec_id", "embedding").crossJoin(small(materialise(_centroids(spark, sf))))
    scored = both.select("vec_id", "label", tagging.cosine(F.col("embedding"), F.col("v")).alias("score"))
    return latest.limit_per_key(scored, ["label"], 10, F.desc("score"), F.asc("vec_id")).withColumn("score", F.round("score", 5))


@query(
    "composite_score",
    f"""WITH {CENTROIDS}, p AS (SELECT vec_id, e.label, vec_id % 3 = 0 AS kw, vec_id % 11 = 0 AS ex,
            list_cosine_similarity(embedding::DOUBLE[], c.v) AS base, list_cosine_similarity(embedding::DOUBLE[], d.v) AS neg
          FROM embeddings e JOIN c ON e.label = c.label JOIN c d ON d.label = (e.label + 1) % 10)
        SELECT vec_id, round(CASE WHEN ex THEN 0 ELSE least(greatest((CASE WHEN kw THEN greatest((base * 0.35 + 0.4) / 0.75, 0.5) ELSE base END)
          - 0.25 * greatest(neg, 0), 0), 1) END, 5)::DOUBLE AS score FROM p""",
)
def composite_score(spark, sf):
    vectors = table(spark, sf, "embeddings")
    means = materialise(_centroids(spark, sf))
    both = vectors.join(means, "label").join(means.select(((F.col("label") + 9) % 10).alias("label"), F.col("v").alias("w")), "label")
    score = tagging.composite_score(
        tagging.cosine(F.col("embedding"), F.col("v")), F.lit(None).cast("double"), F.col("vec_id") % 3 == 0,
        tagging.cosine(F.col("embedding"), F.col("w")), F.col("vec_id") % 11 == 0, F.lit(0.5),
    )
    return both.select("vec_id", F.round(score, 5).alias("score"))


@query("not_yet_tagged", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def not_yet_tagged(spark, sf):
    return tagging.not_yet_tagged(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").filter("quality = 1"), ["doc_id"])


@query("text_cache", """SELECT sha256(text) AS text_hash, length(any_value(text))::BIGINT AS n FROM documents GROUP BY 1""")
def text_cache(spark, sf):
    return tagging.text_cache(table(spark, sf, "documents")).select("text_hash", F.char_length("text").cast("long").alias("n"))


@query("entry_defaults", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'entry_' || substr(sha256(text), 1, 8) ELSE 'b' || doc_id END AS bill_id, 'us' AS country, lang AS state, 'unknown' AS session_id FROM documents""")
def entry_defaults(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("b"), "doc_id")).alias("bill_id"),
        F.lit(None).cast("string").alias("country"), F.col("lang").alias("state"), F.lit(None).cast("string").alias("session_id"),
    )
    return tagging.with_defaults(rows).drop("text")


@query("json_field", """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_field(spark, sf):
    props = F.col("props")
    return table(spark, sf, "events").select("event_id", records.json_path(props, "k").alias("k"), records.json_path(props, "missing").alias("missing"))


@query("org_class", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE NULL END AS chamber FROM events""")
def org_class(spark, sf):
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.lit("not json"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('~{"classification": "'), "event_type", F.lit('"}')))
        .otherwise(F.lit('~{"name": "x"}'))
    )
    return table(spark, sf, "events").select("event_id", keys.org_classification(raw).alias("chamber"))


@query("slug", """SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', '_', 'g'), '_'), 1, 100) AS slug FROM documents""")
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(
    "path_info",
    """SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS state, regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS session_id FROM pages""",
)
def path_info(spark, sf):
    path = F.concat(F.lit("country:us/state:"), F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("/sessions/"), F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1), F.lit("/bills/HB1"))
    info = keys.path_info(path)
    return table(spark, sf, "pages").select("page_id", info["state"].alias("state"), info["session_id"].alias("session_id"))


@query("log_ts", """SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS log_ts, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact FROM events""")
def log_ts(spark, sf):
    path = F.concat(F.lit("x/logs/"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), "event_type", F.lit(".json"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return table(spark, sf, "events").select("event_id", times.log_timestamp(path).alias("log_ts"), times.compact_ts(iso).alias("compact"))


@query("ns_stamps", """SELECT event_id, (epoch_us(ts) * 1000)::BIGINT AS ns, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS iso FROM events""")
def ns_stamps(spark, sf):
    ns = times.to_ns(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return table(spark, sf, "events").select("event_id", ns.alias("ns")).withColumn("iso", times.ns_to_iso(F.col("ns")))


@query("hours_since", """SELECT event_id, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 36.0 + 0.5) / 100 AS hours, date_diff('day', ts, TIMESTAMP '2024-02-01')::INT AS days FROM events""")
def hours_since(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf, "events").withColumn("s", F.date_trunc("second", "ts"))
    return rows.select("event_id", times.hours_since(F.col("s"), now).alias("hours"), times.days_since(F.col("ts"), now).alias("days"))


@query("action_log_key", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || CASE WHEN o_orderstatus = 'F' THEN '.classification.passage.upper' ELSE '_' || regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9_\\s]', '', 'g'), '\\s+', '_', 'g') END AS log_key FROM orders""")
def action_log_key(spark, sf):
    classes = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("passage"))).otherwise(F.array(F.lit("other")))
    key = keys.action_log_key(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderpriority"), classes, F.lit('~{"classification": "upper"}'))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("log_key"))


@query("bill_text_hash", """SELECT p_partkey, sha256(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || ' ' || p_partkey) AS text_hash FROM part""")
def bill_text_hash(spark, sf):
    words = records.bill_text(
        F.col("p_name"), F.array("p_brand", "p_type"), F.array().cast("array<struct<abstract:string>>"), F.col("p_size").cast("string"),
        F.lit(""), F.lit(None).cast("string"), F.col("p_partkey").cast("string"),
    )
    return table(spark, sf, "part").select("p_partkey", records.text_hash(words).alias("text_hash"))


@query("pruned_json", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"name":"' || p_name || '","nested":{"brand":"' || p_brand || '"}}' ELSE '{"name":"' || p_name || '"}' END AS value FROM part""")
def pruned_json(spark, sf):
    """Rows as JSON without empty parts at any depth."""
    even = F.col("p_size") % 2 == 0
    rows = table(spark, sf, "part").select(
        F.col("p_partkey"), F.col("p_name").alias("name"), F.lit("").alias("blank"), F.array(F.lit("")).alias("none"),
        F.struct(F.when(even, F.col("p_brand")).otherwise("").alias("brand"), F.array().cast("array<string>").alias("more")).alias("nested"),
    )
    pruned = records.prune_rows(rows)
    return pruned.select("p_partkey", F.to_json(F.struct("name", "blank", "none", "nested")).alias("value"))


@query(
    "feed_items",
    """SELECT event_id, event_type || ' - ' || 'usr' || user_id || ' - ' || 'Event ' || event_id AS title,
              'id: ' || event_id || chr(10) || chr(10) || 'log:' || chr(10) || '  action:' || chr(10) || '    description: ' || event_type || chr(10) || '  bill_id: B' || user_id AS description, 'https://x.example/' || event_id AS link,
              strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date, 'g' || event_id AS guid
       FROM events ORDER BY ts DESC, event_id LIMIT 100""",
)
def feed_items(spark, sf):
    rows = latest.top(table(spark, sf, "events"), 100, F.desc("ts"), F.asc("event_id"))
    number = F.col("event_id").cast("string")
    none = F.lit(None).cast("string")
    action = F.struct(F.col("event_type").alias("description"), none.alias("date"), F.array().cast("array<string>").alias("classification"), none.alias("organization_id"))
    bill = F.lit(None).cast("struct<identifier:string,title:string,legislative_session:string,subject:array<string>,abstracts:array<struct<abstract:string,note:string>>>")
    return rows.select(
        "event_id",
        records.feed_title(F.array("event_type"), F.concat(F.lit("usr"), "user_id"), F.concat(F.lit("Event "), number), number).alias("title"),
        records.feed_description(number, action, F.concat(F.lit("B"), "user_id"), bill).alias("description"),
        records.feed_link(F.lit("https://x.example/"), number, F.lit("")).alias("link"),
        times.rfc2822(F.col("ts")).alias("pub_date"),
        records.guid(F.concat(F.lit("g"), number), F.lit(""), number).alias("guid"),
    )


HTML_SQL = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"""


@query("html_text", f"SELECT page_id, sha256({HTML_SQL}) AS text_hash, length({HTML_SQL})::BIGINT AS n FROM pages")
def html_text(spark, sf):
    plain = text.html_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(plain, 256).alias("text_hash"), F.char_length(plain).cast("long").alias("n"))


@query("html_title", """SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query("html_placeholder", f"SELECT page_id, CASE WHEN length({HTML_SQL}) < 600 THEN 1 ELSE 0 END AS placeholder FROM pages")
def html_placeholder(spark, sf):
    holder = text.html_placeholder(F.col("html"), text.html_text(F.col("html")), 600)
    return table(spark, sf, "pages").select("page_id", holder.cast("int").alias("placeholder"))


@query("xml_sections", """SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS title, CASE WHEN p_size > 45 THEN NULL ELSE p_brand END AS official_title,
         CASE WHEN p_size > 45 THEN NULL ELSE p_type || 'a,' || 'Sec ' || p_size END AS sections FROM part""")
def xml_sections(spark, sf):
    """Bills in XML made from the part table: some with a DOCTYPE, some broken off, of two roots or with crossed tags."""
    body = F.concat(
        F.lit("<bill><title>"), "p_name", F.lit("</title><official-title>"), "p_brand", F.lit("</official-title><section><header>"), "p_type",
        F.lit("</header><text>a</text></section><section><header>Sec "), "p_size", F.lit("</header></section></bill>"),
    )
    xml = (
        F.when(F.col("p_size") > 49, F.concat(body, body)).when(F.col("p_size") > 48, F.concat(F.lit("<a><b></a>"), body)).when(F.col("p_size") > 47, F.substring(body, 1, 60))
        .when(F.col("p_size") > 46, F.lit("no xml")).when(F.col("p_size") > 45, F.lit(None).cast("string"))
        .when(F.col("p_size") > 20, F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE bill PUBLIC "-//US Congress//DTDs/bill.dtd//EN" "bill.dtd">'), body)).otherwise(body)
    )
    parts = table(spark, sf, "part").select("p_partkey", docs_ops.xml_parts(xml).alias("x"))
    return parts.select("p_partkey", "x.title", "x.official_title", F.array_join("x.sections", ",").alias("sections"))


@query("extract_skip", """SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN CASE WHEN (d.doc_id % 4 = 0 AND d.doc_id % 30 > 0) OR (d.doc_id % 4 > 0 AND d.doc_id % 30 > 9) OR d.doc_id % 30 >= 15 THEN 1 ELSE 0 END
              WHEN l.doc_id IS NOT NULL AND d.doc_id % 4 > 0 THEN 0 ELSE 1 END AS fetch
       FROM documents d LEFT JOIN labels l USING (doc_id)""")
def extract_skip(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    day = F.lit("2024-03-01").cast("date")
    unavailable = F.when(F.col("doc_id") % 5 == 0, F.date_sub(day, (F.col("doc_id") % 30).cast("int")))
    updated = F.when(F.col("doc_id") % 4 == 0, day).otherwise(F.date_sub(day, 9))
    need = filters.needs_extraction(day, updated, F.date_sub(day, 3), F.coalesce("has", F.lit(False)), unavailable)
    return rows.select("doc_id", need.cast("int").alias("fetch"))


@query(
    "extract_outcome",
    f"""WITH r AS (SELECT regexp_extract(url, '/([a-z]{{2}})/', 1) AS state,
           CASE WHEN page_id % 9 = 0 THEN 'download_failed' WHEN length({HTML_SQL}) < 200 THEN 'placeholder_only' END AS reason FROM pages)
        SELECT state, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS ok, count(*) FILTER (WHERE reason IS NOT NULL) AS unavailable,
               coalesce(string_agg(DISTINCT reason, '+' ORDER BY reason), '') AS reasons FROM r GROUP BY 1""",
)
def extract_outcome(spark, sf):
    content = F.when(F.col("page_id") % 9 > 0, F.col("html"))
    rows = table(spark, sf, "pages").select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("state"), docs_ops.outcome(content, F.lit("text/html")).alias("r"))
    counted = quality.outcome_counts(rows.select("state", "r.outcome", "r.reason"), ["state"])
    return counted.select("state", "total", "ok", "unavailable", "reasons")


@query("doc_preference", """SELECT doc_id, arg_min(kind, CASE kind WHEN 'text/html' THEN 2 WHEN 'application/pdf' THEN 3 ELSE 4 END) AS media_type FROM (
       SELECT o_custkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'text/plain' WHEN 'F' THEN 'application/pdf' ELSE 'text/html' END AS kind FROM orders) GROUP BY 1""")
def doc_preference(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "O", "text/plain").when(F.col("o_orderstatus") == "F", "application/pdf").otherwise("text/html")
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), kind.alias("media_type"), F.col("o_orderkey").alias("position"), F.lit("u").alias("url"))
    return docs_ops.candidates(links, ["doc_id"]).filter("rank = 1").select("doc_id", "media_type")


@query("document_header", """SELECT doc_id, sha256('Title: ' || source || chr(10) || 'Official Title: N/A' || chr(10) || 'Source: s' || doc_id || chr(10) || 'Media Type: text/html' || chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) || text) AS h FROM documents""")
def document_header(spark, sf):
    whole = docs_ops.text_document(F.col("source"), F.lit(None).cast("string"), F.concat(F.lit("s"), "doc_id"), F.lit("text/html"), F.lit(False), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(whole, 256).alias("h"))


@query("dataset_catalog", """SELECT p_type AS state, count(*) AS n_bills, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sessions FROM part GROUP BY 1""")
def dataset_catalog(spark, sf):
    bills = table(spark, sf, "part").select(F.col("p_type").alias("state"), F.col("p_brand").alias("session_id"))
    out = sinks.dataset_catalog(bills, "https://x.example").withColumn("o", F.from_json("descriptor", "n_bills bigint, `dcat:keyword` array<string>"))
    return out.select("state", F.col("o.n_bills").alias("n_bills"), F.array_join("o.`dcat:keyword`", ",").alias("sessions"))
