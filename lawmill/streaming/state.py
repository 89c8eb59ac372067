"""Streams: scoring, ledger, orphans, dead man. Each has a batch twin that gives the same rows."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lawmill.operators import tagging

# the process that prepares a processor's state does not get files added to the application, so processors travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State that outgrows memory lives in RocksDB, which stateful processors need; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class LedgerProcessor(StatefulProcessor):
    """Emits a key's row when its hash is new or differs from the last one kept."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        out = []
        for pdf in rows:
            for row in pdf.sort_values("content_hash").itertuples(index=False):
                if row.content_hash != known:
                    known = row.content_hash
                    out.append((key[0], known))
        if out:
            self.last.update((known,))
            yield pd.DataFrame(out, columns=["key", "content_hash"])

    def close(self) -> None:
        pass


def stream_ledger(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, content_hash) of new and changed keys of a stream of the same columns."""
    kind = rows.schema[key].dataType.simpleString()
    return (
        rows.select(F.col(key).alias("key"), "content_hash")
        .groupBy("key")
        .transformWithStateInPandas(LedgerProcessor(), f"key {kind}, content_hash string", "Append", "None")
    )


class OrphanProcessor(StatefulProcessor):
    """Counts references to a bill until the bill arrives; emits a status each time rows come."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "arrived boolean, occurrences long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived, count = self.state.get() if self.state.exists() else (False, 0)
        before, had = arrived, count
        for pdf in rows:
            arrived = arrived or bool((pdf["kind"] == "bill").any())
            count += int((pdf["kind"] != "bill").sum())
        self.state.update((arrived, count))
        # a bill that comes with or after references to it resolves them; one without any, or that was there before, is fine
        status = "fine" if before or arrived and not count else "resolved" if arrived else "new" if not had else "continuing"
        yield pd.DataFrame({"key": [key[0]], "status": [status], "occurrences": [count]})

    def close(self) -> None:
        pass


def stream_orphans(rows: DataFrame) -> DataFrame:
    """(key, status, occurrences) from a stream of (key, kind), kind ``bill`` or a reference."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(OrphanProcessor(), f"key {kind}, status string, occurrences long", "Append", "None")


class DeadManProcessor(StatefulProcessor):
    """Remembers the last beat; a processing-time timer reports silence."""

    def __init__(self, hours: float = 6):
        self.millis = int(hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(pdf["at"].max() for pdf in rows)
        if self.last.exists():
            newest = max(newest, pd.Timestamp(self.last.get()[0]))
        self.last.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        yield pd.DataFrame({"key": [key[0]], "last_seen": [newest], "dead": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "last_seen": [pd.Timestamp(self.last.get()[0])], "dead": [True]})

    def close(self) -> None:
        pass


def stream_dead_man(beats: DataFrame, hours: float = 6) -> DataFrame:
    """(key, last_seen, dead) from a stream of (key, at timestamp)."""
    kind = beats.schema["key"].dataType.simpleString()
    return beats.groupBy("key").transformWithStateInPandas(DeadManProcessor(hours), f"key {kind}, last_seen timestamp, dead boolean", "Append", "ProcessingTime")


class SilenceProcessor(StatefulProcessor):
    """By event time: emits a key's ``dead`` at the end of each silence and ``back`` at the next beat."""

    def __init__(self, hours: float):
        self.millis = int(hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, dead boolean")

    def _rows(self, key, events: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(events), "at": pd.to_datetime([at for at, _ in events], unit="ms", utc=True), "state": [s for _, s in events]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, dead = self.last.get() if self.last.exists() else (None, False)
        out = []
        for at in sorted(int(at) for pdf in rows for at in pdf["ms"]):
            if last is not None and at - last >= self.millis:
                out += [] if dead else [(last + self.millis, "dead")]
                out.append((at, "back"))
            dead, last = False, at if last is None else max(last, at)
        self.last.update((last, dead))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.millis)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, dead = self.last.get()
        if not dead:
            self.last.update((last, True))
            yield self._rows(key, [(last + self.millis, "dead")])

    def close(self) -> None:
        pass


def stream_silence(beats: DataFrame, hours: float = 6, late: str = "0 seconds") -> DataFrame:
    """(key, at, state) from a stream of (key, at timestamp): ``dead`` when a key's beats have been missing for the hours, by the
    stream's own time, ``back`` at the beat that ends it. Keys' beats come in order but for ``late``."""
    kind = beats.schema["key"].dataType.simpleString()
    timed = beats.select("key", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(SilenceProcessor(hours), f"key {kind}, at timestamp, state string", "Append", "EventTime")


def silences(beats: DataFrame, hours: float = 6) -> DataFrame:
    """The batch twin of ``stream_silence`` over all beats there are."""
    by = W.partitionBy("key").orderBy("at")
    limit = F.make_dt_interval(hours=F.lit(int(hours)))
    spans = beats.select("key", "at", F.lead("at").over(by).alias("next")).crossJoin(F.broadcast(beats.agg(F.max("at").alias("end"))))
    silent = F.coalesce("next", "end") - F.col("at") >= limit
    both = F.array(F.struct((F.col("at") + limit).alias("at"), F.lit("dead").alias("state")), F.struct(F.col("next").alias("at"), F.lit("back").alias("state")))
    return spans.filter(silent).select("key", F.explode(both).alias("e")).filter("e.at IS NOT NULL").select("key", "e.at", "e.state")


class ExpiringOrphanProcessor(StatefulProcessor):
    """Orphans by event time: what isn't referred to for ``hours`` is given up, emitted as ``expired`` and forgotten; a bill that
    arrived is forgotten as well then, without a row."""

    def __init__(self, hours: float):
        self.millis = int(hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "arrived boolean, occurrences long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived, count, last = self.state.get() if self.state.exists() else (False, 0, None)
        out = []
        for at, kind in sorted((int(at), kind) for pdf in rows for at, kind in zip(pdf["ms"], pdf["kind"])):
            if last is not None and at - last >= self.millis:
                out += [] if arrived else [(key[0], "expired", count)]
                arrived, count = False, 0
            if kind == "bill":
                out += [(key[0], "resolved", count)] if count and not arrived else []
                arrived = True
            else:
                count += 1
            last = at if last is None else max(last, at)
        self.state.update((arrived, count, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.millis)
        if out:
            yield pd.DataFrame(out, columns=["key", "status", "occurrences"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        arrived, count, _ = self.state.get()
        self.state.clear()
        if not arrived:
            yield pd.DataFrame([(key[0], "expired", count)], columns=["key", "status", "occurrences"])

    def close(self) -> None:
        pass


def stream_expiring_orphans(rows: DataFrame, hours: float, late: str = "0 seconds") -> DataFrame:
    """(key, status, occurrences) from a stream of (key, kind, at timestamp): ``resolved`` when the bill of an orphan arrives,
    ``expired`` when nothing has come for the hours, after which no state of the key is left."""
    kind = rows.schema["key"].dataType.simpleString()
    timed = rows.select("key", "kind", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(ExpiringOrphanProcessor(hours), f"key {kind}, status string, occurrences long", "Append", "EventTime")


def stream_tags(texts: DataFrame, defs: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Score a stream of texts and keep the results under ``path``: one folder per batch, replaced if the batch is
    run again, so that each text and tag is there once. The keys met before are the stream's state, so texts scored
    in an earlier batch are left out without reading what was written."""

    def upsert(batch: DataFrame, number: int) -> None:
        tagging.tag_by_keywords(batch, defs).select(*keys, "tag", "keywords", "score").write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(texts.dropDuplicates(list(keys)), upsert, checkpoint)


def tag_schema(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> str:
    """DDL of the results of ``stream_tags``."""
    return ", ".join([f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys] + ["tag string, keywords array<string>, score double"])


def current_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All results under ``path``; no rows where no batch has run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def recent(rows: DataFrame, ts: str = "created_at", hours: int = 24) -> DataFrame:
    """Rows under a watermark that bounds how late they may come; ``ts`` is a timestamp."""
    return rows.withWatermark(ts, f"{hours} hours")


def stream_windows(rows: DataFrame, ts: str, span: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and keys, with late rows allowed for a while (an addition of ours)."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, span), *keys).count()


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is: into a function of (batch, id), or a Parquet folder."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if callable(sink) else writer.format("parquet").start(sink)
    query.awaitTermination()
