"""Writers. Upserts write touched partitions only; state tables get a new version and then a pointer to it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawmill.functions.keys import action_log_key, bill_key, jurisdiction_name, vote_log_key
from lawmill.functions.records import canonical_classes, merge_processing, prune_rows, reshape_action
from lawmill.functions.text import xml_escape
from lawmill.session import materialise


def action_log_rows(bills: DataFrame) -> DataFrame:
    """One row per action with its file key; of equal keys the last action stays."""
    rows = bills.select("state", "session_id", "bill_id", "sources", F.posexplode("actions").alias("pos", "action"))
    keyed = rows.withColumn(
        "log_key",
        action_log_key(
            F.coalesce("action.date", "action.occurred_at"), F.col("action.description"),
            F.coalesce(canonical_classes(F.col("action")), F.array().cast("array<string>")), F.col("action.organization_id"),
        ),
    )
    last = F.row_number().over(W.partitionBy("state", "session_id", "bill_id", "log_key").orderBy(F.desc("pos")))
    return keyed.withColumn("_n", last).filter("_n = 1").select(
        "state", "session_id", "bill_id", "log_key", reshape_action(F.col("action"), F.col("session_id"), F.col("sources")).alias("action")
    )


def vote_log_rows(votes: DataFrame) -> DataFrame:
    """Vote events with their file key; of equal keys the last identifier stays."""
    keyed = votes.withColumn("log_key", vote_log_key(F.col("start_date"), F.col("result"), F.col("organization")))
    last = F.row_number().over(W.partitionBy("state", "session_id", "bill_id", "log_key").orderBy(F.desc("identifier")))
    return keyed.withColumn("_n", last).filter("_n = 1").drop("_n")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("state", "session_id")) -> None:
    """Replace the partitions that the rows touch, one shuffle by partition so that each gets few files. Spark cuts the
    shuffle's large partitions, so a state of many rows is written by several tasks."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_bills(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("state", "session_id", "bill_id")) -> DataFrame:
    """New documents in place of the stored ones, which lend their ``processing`` map; others stay."""
    columns = [c for c in incoming.columns if c not in (*keys, "processing")]
    new = incoming.select(*keys, F.struct(*columns).alias("_new"), F.col("processing").alias("_np"))
    old = stored.select(*keys, F.struct(*columns).alias("_old"), F.col("processing").alias("_op"))
    both = new.join(old, list(keys), "full_outer")
    empty = F.create_map().cast("map<string,string>")
    processing = merge_processing(F.coalesce("_op", empty), F.coalesce("_np", empty))
    return both.select(*keys, F.coalesce("_new", "_old").alias("_row"), processing.alias("processing")).select(*keys, "_row.*", "processing")


def resolved(spark, path: str) -> str:
    """A path with the file system that Spark takes it to be on, so that tasks write where readers look."""
    files, where = file_system(spark, path)
    return files.makeQualified(where).toString()


def write_tree(files: DataFrame, root: str) -> None:
    """Write files: one per row of (path under the root, body as bytes), by the tasks that hold them; a file there is replaced.

    The root is on the file system that Spark reads it from. A file is written under a name of its own and then moved into
    place, so that a lost or repeated task never leaves half of one."""
    where = re.sub("^file:/*", "file:///", resolved(files.sparkSession, root))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"]):
                whole = f"{base.rstrip('/')}/{path}"
                folder, name = whole.rsplit("/", 1)
                target.create_dir(folder, recursive=True)
                apart = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with target.open_output_stream(apart) as out:
                    out.write(body)
                try:
                    target.move(apart, whole)
                except OSError:  # some file systems don't move onto a file
                    target.delete_file(whole)
                    target.move(apart, whole)
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("path", "body").mapInPandas(put, "n long").agg({"n": "sum"}).collect()


def quarantine(bad: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows to append: those whose name the quarantine doesn't hold."""
    return bad if stored is None else bad.join(stored.select("category", "name").distinct(), ["category", "name"], "left_anti")


def session_log_catalog(logs: DataFrame, file: str = "log_key") -> DataFrame:
    """One flat list of logs per session; from the second holder of a name on, the bill is appended."""
    rank = F.row_number().over(W.partitionBy("state", "session_id", file).orderBy("bill_id"))
    return logs.withColumn("entry", F.when(rank > 1, F.concat_ws("_", file, "bill_id")).otherwise(F.col(file)))


def load_tables(bills: DataFrame) -> None:
    """Temporary views ``bills`` and ``bills_summary`` for SQL."""
    bills.createOrReplaceTempView("bills")
    bills.select(
        "state", "session_id", "identifier", "title", F.size("actions").alias("actions_count"), F.size("sponsorships").alias("sponsors_count")
    ).createOrReplaceTempView("bills_summary")


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    {"csv": writer.option("header", True).csv, "json": writer.json, "parquet": writer.parquet}[kind](path)


def dashboard_order(bills: DataFrame) -> DataFrame:
    """Bills in the dashboard's order: state (none first), session, identifier."""
    return bills.orderBy(F.coalesce("state", F.lit("")), "session", "id")


def dashboard(bills: DataFrame, tag_defs: DataFrame, generated_at: Column, source: str, jurisdictions: DataFrame, with_bills: bool = False) -> DataFrame:
    """One row, the document as JSON: states by name, jurisdictions without bills, tags with descriptions, and with
    ``with_bills`` the bills in order, which is for as many as one file of a static host holds; else they stay a table."""
    def named(states: DataFrame, to: str) -> DataFrame:
        one = F.struct(jurisdiction_name(F.lit(None).cast("string"), F.col("state")).alias("name"), F.col("state").alias("code"))
        return states.agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["code"].alias("code"), s["name"].alias("name"))).alias(to))

    present = bills.filter(F.coalesce("state", F.lit("")) != "").select("state").distinct()
    used = bills.select(F.explode("tags").alias("name")).distinct().join(tag_defs.select("name", "description"), "name", "left")
    tags = used.agg(F.array_sort(F.collect_list(F.struct("name", F.coalesce("description", F.lit("")).alias("description")))).alias("tags"))
    empty = jurisdictions.select("state").distinct().join(present, "state", "left_anti")
    one = named(present, "states").crossJoin(named(empty, "empty_jurisdictions")).crossJoin(tags)  # one row each
    if with_bills:
        row = F.struct(F.coalesce("state", F.lit("")).alias("_s"), F.col("session").alias("_n"), F.col("id").alias("_i"), F.struct(*bills.columns).alias("bill"))
        one = one.crossJoin(bills.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["bill"]).alias("bills")))
    return one.select(F.to_json(F.struct(generated_at.alias("generated_at"), F.lit(source).alias("source"), *one.columns)).alias("document"))


def dashboard_shards(bills: DataFrame, shard_bytes: int = 8_000_000, folder: str = "bills") -> tuple[DataFrame, DataFrame]:
    """(files, manifest) of the dashboard's bills in their order, for more of them than one value holds: files are (path, body
    as bytes), each a JSON list, for ``write_tree``; the manifest has a row per file: its number, path, bytes, bills and first id.

    The bills are sorted by range over tasks. Where each one begins is a running sum of sizes, inside a task and over the tasks
    before it; a file holds what begins in its span of ``shard_bytes``, so a task never has more of a file than that and one bill.
    The lists of all files in a row are the list of all bills."""
    order = ["_state", "session", "id"]
    text = bills.select(F.coalesce("state", F.lit("")).alias("_state"), "session", "id", F.to_json(F.struct(*bills.columns)).alias("_json"))
    placed = text.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_size", F.octet_length("_json") + 1))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    parts = placed.groupBy("_part").agg(F.sum("_size").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    begins = F.col("_base") + F.sum("_size").over(inside) - F.col("_size")
    cut = placed.join(F.broadcast(parts), "_part").withColumn("shard", F.floor(begins / shard_bytes))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_json"))), lambda x: x["_json"]), ","), F.lit("]"))
    each = cut.groupBy("shard").agg(body.alias("body"), F.count(F.lit(1)).alias("n_bills"), F.min_by("id", "_at").alias("first_id"))
    each = materialise(each.withColumn("path", F.format_string(f"{folder}/%06d.json", "shard")))
    return each.select("path", F.encode("body", "UTF-8").alias("body")), each.select("shard", "path", F.octet_length("body").cast("long").alias("bytes"), "n_bills", "first_id")


def feed_xml(items: DataFrame, title: str, link: str) -> DataFrame:
    """One RSS text of a limited feed's items (title, description, link, pub_date, guid, order)."""
    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>"))

    item = F.concat(F.lit("<item>"), *(tag(n, F.coalesce(F.col(c), F.lit(""))) for n, c in (("title", "title"), ("description", "description"), ("link", "link"), ("pubDate", "pub_date"), ("guid", "guid"))), F.lit("</item>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", item.alias("xml")))), lambda x: x["xml"]), "")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), tag("title", F.lit(title)), tag("link", F.lit(link)))
    return items.agg(F.concat(head, body, F.lit("</channel></rss>")).alias("rss"))


def jsonl(df: DataFrame) -> DataFrame:
    """One pruned JSON text per row."""
    pruned = prune_rows(df)
    return pruned.select(F.to_json(F.struct(*pruned.columns)).alias("value"))


def upsert_bill_tags(stored: DataFrame, results: DataFrame, keys: Sequence[str] = ("state", "session_id", "bill_id", "tag")) -> DataFrame:
    """Stored results with the new ones laid over them by bill and tag."""
    return stored.join(results.select(*keys), list(keys), "left_anti").unionByName(results, allowMissingColumns=True)


def dataset_catalog(bills: DataFrame, base_url: str) -> DataFrame:
    """A DCAT descriptor per state's data set."""
    sets = bills.groupBy("state").agg(F.count(F.lit(1)).alias("n_bills"), F.array_sort(F.collect_set("session_id")).alias("sessions"))
    return sets.select(
        "state",
        F.to_json(
            F.struct(
                F.lit("dcat:Dataset").alias("@type"), F.concat(F.lit("Legislation of "), F.upper("state")).alias("dct:title"),
                F.concat(F.lit(base_url.rstrip("/") + "/"), "state").alias("dcat:landingPage"), F.col("sessions").alias("dcat:keyword"), "n_bills",
            )
        ).alias("descriptor"),
    )


def run_summary(objects: DataFrame, errors: DataFrame, state: str) -> DataFrame:
    """One row: objects by kind, number of errors and the first of them."""
    kinds = objects.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("objects"))
    bad = errors.agg(F.count(F.lit(1)).alias("error_count"), F.min("name").alias("first_error"))
    return kinds.crossJoin(bad).withColumn("state", F.lit(state))


def failed_documents(results: DataFrame, now: Column) -> DataFrame:
    """Rows for the error list, with whether their type counts in the summary."""
    bad = results.filter(F.col("outcome") != "ok")
    return bad.select("bill_id", F.col("reason").alias("error_type"), "url", now.alias("at"), F.col("reason").isin("download_failed", "parsing_failed").alias("counted"))


def with_bill_key(df: DataFrame) -> DataFrame:
    return df.withColumn("bill_key", bill_key(F.col("state"), F.col("session_id"), F.col("identifier")))


def file_system(spark, path: str):
    """The file system of a path, and the path on it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commits(spark, path: str):
    """File system, folder of commits and the numbers committed so far."""
    files, folder = file_system(spark, f"{path}/_commits")
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return files, folder, sorted(int(n) for n in found if n.isdigit())


def current_version(spark, path: str) -> str | None:
    """Folder of a state table's committed version; null before the first."""
    _, folder, numbers = _commits(spark, path)
    return f"{path}/{spark.read.text(f'{folder}/{numbers[-1]:012d}').first()[0]}" if numbers else None


def committed_versions(spark, path: str) -> list[str]:
    """Names of a state table's versions in the order of their commits."""
    _, folder, numbers = _commits(spark, path)
    return [spark.read.text(f"{folder}/{n:012d}").first()[0] for n in numbers]


def commit_state(df: DataFrame, path: str, version: str) -> None:
    """Write a new version of a state table, then commit it: a numbered file with its name, written apart and renamed
    into place, which is one step. Readers take the highest number, so they see the old version until then and never none."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    files, folder, numbers = _commits(spark, path)
    files.mkdirs(folder)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    apart = Path(f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(apart)
    out.write(bytearray(version.encode()))
    out.close()
    number = numbers[-1] + 1 if numbers else 0
    if not files.rename(apart, Path(f"{folder}/{number:012d}")):
        raise RuntimeError(f"another writer committed version {number} of {path}")
