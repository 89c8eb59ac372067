"""Readers of legislative records. Schemas are explicit and nothing globs through folder names with a colon."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill import schemas
from lawmill.functions.keys import path_info, session_of
from lawmill.functions.times import log_timestamp
from lawmill.sources import archives, listing

#: What a broken, cut off, encrypted or oddly packed archive raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, EOFError, OSError, ValueError, KeyError)


def _json(spark: SparkSession, root: str, schema: str, pattern: str) -> DataFrame:
    """Whole files read with an explicit schema, plus ``path``; files that aren't JSON are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    named = files.select("value", F.col("_metadata.file_path").alias("path")).filter(F.try_parse_json("value").isNotNull())
    return named.select(F.from_json("value", schema).alias("o"), "path").select("o.*", "path")


def read_bills(spark: SparkSession, root: str) -> DataFrame:
    """Every ``bills/*/metadata.json`` with its path keys; unreadable files are skipped."""
    rows = _json(spark, root, schemas.BILL, "metadata.json").filter(F.col("path").contains("/bills/"))
    info = path_info(F.col("path"))
    return rows.withColumns(
        {"country": info["country"], "state": info["state"], "session_id": session_of(F.col("legislative_session"), F.col("path")), "bill_id": info["bill_id"]}
    )


def read_logs(spark: SparkSession, root: str, repos=None) -> DataFrame:
    """JSON files under country / state / sessions / logs, with path keys, stamp and the bill that the log names."""
    rows = _json(spark, root, schemas.LOG, "*.json").filter(
        F.col("path").rlike(r"country:[^/]+/state:[^/]+/sessions/[^/]+/.*logs/[^/]+\.json$")
    )
    if repos is not None:
        rows = rows.filter(F.regexp_extract("path", r"/([^/]+-legislation)/", 1).isin(list(repos)))
    info = path_info(F.col("path"))
    log = F.struct(*(c for c in rows.columns if c != "path"))
    return rows.select(
        info["country"].alias("country"), info["state"].alias("state"), info["session_id"].alias("session_id"),
        F.coalesce("bill_id", "bill_identifier", info["bill_id"]).alias("bill_id"), log.alias("log"),
        log_timestamp(F.col("path")).alias("log_ts"), "path",
    )


def discover_log_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, log_ts) of log files by listing alone, which tasks do: the driver holds none of the paths."""
    files = listing.files_below(spark, root, ".json")
    return files.filter(F.col("path").contains("/logs/")).select(
        "path", F.regexp_replace("path", r"^.*?/(country:.*)$", "$1").alias("relative"), log_timestamp(F.col("path")).alias("log_ts")
    )


def logs_from_paths(files: DataFrame, wanted: DataFrame, column: str = "path") -> DataFrame:
    return files.join(wanted.select(F.col(column).alias("path")).distinct(), "path", "left_semi")


def read_raw_objects(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(objects, quarantined): raw scraper files as ``kind``, ``name``, ``body`` JSON text; unreadable ones apart."""
    files = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
        .select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("body"))
    )
    kind = F.lit("other")
    for prefix in ("bill", "vote_event", "event", "jurisdiction", "organization"):
        kind = F.when(F.col("name").startswith(prefix + "_"), prefix).otherwise(kind)
    typed = files.withColumn("kind", kind)
    good = F.try_parse_json("body").isNotNull()
    return typed.filter(good), typed.filter(~good).withColumn("category", F.lit("from_scraper_invalid_json"))


def event_archive(objects: DataFrame) -> DataFrame:
    """(name, body): the raw events, which are kept as they came besides being processed."""
    return objects.filter(F.col("kind") == "event").select("name", "body")


def typed_objects(objects: DataFrame, kind: str) -> DataFrame:
    """The objects of one kind with their explicit schema."""
    schema = {"bill": schemas.BILL, "vote_event": schemas.VOTE_EVENT, "event": schemas.EVENT, "jurisdiction": schemas.JURISDICTION}[kind]
    return objects.filter(F.col("kind") == kind).select("name", F.from_json("body", schema).alias("o")).select("name", "o.*")


def read_any_layout(spark: SparkSession, root: str) -> DataFrame:
    """Bills as ``metadata.json`` or ``bill_*.json`` at any depth outside .git."""
    parts = [_json(spark, root, schemas.BILL, p) for p in ("metadata.json", "bill_*.json")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).filter(~F.col("path").contains("/.git/"))


def read_jsonl(spark: SparkSession, path: str, schema: str, on_bad: str = "skip", stream: bool = False) -> DataFrame:
    """JSON lines with ``raw``: blank lines skipped, malformed ones skipped or passed through with null fields."""
    text = (spark.readStream if stream else spark.read).format("text").load(path)
    rows = text.filter(F.trim("value") != "").select(F.col("value").alias("raw"), F.from_json("value", schema).alias("o"), F.try_parse_json("value").isNotNull().alias("_ok"))
    if on_bad == "skip":
        rows = rows.filter("_ok")
    return rows.select("raw", "o.*")


def read_tag_results(spark: SparkSession, root: str) -> DataFrame:
    """(bill_id, tag, score) from one JSON file per tag; unreadable files are skipped."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("tag"),
        F.from_json("value", "bills map<string,struct<text_hash:string,score:struct<final_score:double>>>").alias("o"),
    )
    return files.select("tag", F.explode("o.bills").alias("bill_id", "result")).select("bill_id", "tag", F.col("result.score.final_score").alias("score"), "result.text_hash")


def read_sessions(jurisdictions: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Sessions that have identifier, name, start and end, with their ``date_folder``; the cached table where there are none."""
    rows = jurisdictions.select(F.explode("legislative_sessions").alias("s")).select("s.*")
    ok = F.lit(True)
    for name in ("identifier", "name", "start_date", "end_date"):
        ok = ok & (F.coalesce(F.col(name), F.lit("")) != "")
    found = rows.filter(ok).select(
        F.col("identifier").alias("session_id"), "name", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"),
        F.concat_ws("-", F.substring("start_date", 1, 4), F.substring("end_date", 1, 4)).alias("date_folder"),
    )
    return cached if cached is not None and not found.limit(1).count() else found


def read_poller_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POLL).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run listings, one file per workflow named org__repo__workflow."""
    runs = spark.read.schema(f"workflow_runs array<struct<{schemas.RUN.replace(' ', ':')}>>".replace(",:", ",")).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return runs.select(F.split(name, "__").alias("n"), F.explode("workflow_runs").alias("r")).select(
        F.col("n")[0].alias("org"), F.col("n")[1].alias("repo"), F.regexp_replace(F.col("n")[2], r"\.json$", "").alias("workflow"), "r.*"
    )


def read_run_archives(spark: SparkSession, path: str, whole_bytes: int = 16 << 20) -> DataFrame:
    """(run, file, line_no, line) of the top-level text files of zipped run logs. A file that can't be read (broken,
    encrypted, of an unknown method) gives one null line, and so does a broken archive; the others go on.

    Archives of up to ``whole_bytes`` come as values; larger ones are read by member (``archives``), where a member packed in
    another way than deflate can't be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    files = found.filter(F.col("length") <= whole_bytes).select("path", "content")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                run = name.rsplit("/", 1)[-1].removesuffix(".zip")
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    names = sorted(n for n in archive.namelist() if n.endswith(".txt") and "/" not in n)
                except UNREADABLE:
                    yield archives.frame(run, None, 0, None)
                    continue
                for file in names:
                    try:
                        lines = archive.read(file).decode("utf-8", "replace").splitlines()
                    except UNREADABLE:
                        yield archives.frame(run, file, 0, None)
                        continue
                    if lines:
                        yield archives.frame(run, file, 0, lines)

    small = files.mapInPandas(unzip, archives.LINES)
    large = found.filter(F.col("length") > whole_bytes).select("path")
    return small.unionByName(archives.read_by_member(spark, large))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Per session and bill how many files there are, by listing alone."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    info = path_info(F.col("path"))
    return (
        paths.select(info["state"].alias("state"), info["session_id"].alias("session_id"), info["bill_id"].alias("bill_id"), F.col("path").contains("/files/").alias("is_file"))
        .filter(F.col("bill_id").isNotNull())
        .groupBy("state", "session_id", "bill_id")
        .agg(F.count(F.lit(1)).alias("n_files"), F.bool_or("is_file").alias("has_files"))
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Session calendar from a CSV with header: state, session, start_date, end_date."""
    return spark.read.option("header", True).schema("state string, session string, start_date date, end_date date, status string, notes string").csv(path)
