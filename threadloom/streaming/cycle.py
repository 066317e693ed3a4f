"""The incremental cycle: documents come, are replaced, deleted and expire, and only the threads that they touch are linked anew.

``lifecycle`` keeps, for each file, when it expires: a timer on the clock of the newest fetch time fires then for its bucket of files, so no scan of the
store looks for stale documents. ``ThreadTable`` holds each live document with its component and its thread. A batch is compared with the
live documents, and the components that it touches, by a new document or by one that goes, are paired and linked as a whole; since
merges never leave a component, all other threads stand. That needs the loop's unbounded budget and no chunks: both couple
components that have nothing to do with each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..config import EN_CLUSTERING, ClusteringConfig
from ..operators import linkage
from ..operators.pairs import near_any
from ..storage import cut
from .keyed import PARTS, KeyedTable

#: What ``lifecycle`` takes.
CHANGE = "file_name string, seq long, gone boolean, fetch_time long, ttl long, payload string"
#: Files share states by hash, in so many buckets: a call to the state costs more than a file.
BUCKETS = 4096
#: What the session needs for the lifecycle's states: RocksDB, with a bound on what all states of an executor keep in memory.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


class _Lifecycle(StatefulProcessor):
    """State of a bucket of files: of each one the number of its last change, and the second after which it is stale. One timer, for the first of them."""

    def init(self, handle):
        self.handle = handle
        self.files = handle.getValueState("files", "names array<string>, seqs array<long>, untils array<long>")

    def _held(self) -> dict:
        found = self.files.get()
        return {n: (s, u) for n, s, u in zip(*found, strict=True)} if found else {}

    def _keep(self, files: dict) -> int | None:
        """When the first of them is stale, in milliseconds."""
        if not files:
            self.files.clear()
            return None
        self.files.update((list(files), *([v[k] for v in files.values()] for k in (0, 1))))
        return self._first(files)

    @staticmethod
    def _first(files: dict) -> int | None:
        return (min(u for _, u in files.values()) + 1) * 1000 if files else None

    def handleInputRows(self, key, rows, timerValues):
        last: dict = {}
        for pdf in rows:
            pdf = pdf[pdf["payload"].notna() | pdf["gone"]]
            for name, seq, until, payload, gone in zip(*(pdf[c].tolist() for c in ("file_name", "seq", "until", "payload", "gone")), strict=True):
                if name not in last or seq >= last[name][0]:
                    last[name] = (seq, until, payload, gone)
        files = self._held()
        before, out = self._first(files), []
        for name, (seq, until, payload, gone) in last.items():
            held = files.get(name)
            if held and seq < held[0]:
                continue
            files.pop(name, None)
            if not gone:
                files[name] = (int(seq), int(until))
            if held or not gone:
                out.append((name, seq, "gone" if gone else "put", payload))
        if out:
            after = self._keep(files)
            if after != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                if after is not None:
                    self.handle.registerTimer(after)
            yield pd.DataFrame(out, columns=["file_name", "seq", "action", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        files, now = self._held(), timerValues.getCurrentWatermarkInMs()
        stale = [n for n, (_, u) in files.items() if (u + 1) * 1000 <= now]
        out = [(n, files.pop(n)[0], "expired", None) for n in stale]
        if out:
            after = self._keep(files)
            if after is not None:
                self.handle.registerTimer(after)
            yield pd.DataFrame(out, columns=["file_name", "seq", "action", "payload"])

    def close(self):
        pass


def lifecycle(changes: DataFrame) -> DataFrame:
    """changes: a stream of file_name, seq, gone, fetch_time, ttl, payload (string). Returns a stream of file_name, seq, action, payload: ``put`` for the
    last change of a file in a batch, ``gone`` for a deleted one, ``expired`` once the newest fetch time seen is beyond fetch_time + ttl.

    A late document is taken in, as the clock's rows alone carry the event time and may come late; stale ones expire in
    the batch that follows. A change with a smaller number than the file's last one is ignored. The state is a number and a time for each live file, by ``BUCKETS``.
    """
    until = F.col("fetch_time") + F.col("ttl")
    clock = F.struct(F.timestamp_seconds("fetch_time").alias("ts"), F.lit(None).cast("string").alias("payload"), F.lit(False).alias("gone"))
    change = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.when(~F.col("gone"), F.coalesce("payload", F.lit(""))).alias("payload"), F.col("gone").alias("gone"))
    kinds = F.when(F.col("fetch_time").isNull(), F.array(change)).otherwise(F.array(clock, change))
    bucket = F.pmod(F.xxhash64("file_name"), F.lit(BUCKETS)).cast("int")
    rows = changes.select(bucket.alias("bucket"), "file_name", "seq", until.alias("until"), F.explode(kinds).alias("k")).select("bucket", "file_name", "seq", "until", "k.*")
    timed = rows.withWatermark("ts", "0 seconds")
    out = "file_name string, seq long, action string, payload string"
    return timed.groupBy("bucket").transformWithStateInPandas(_Lifecycle(), out, "Append", "eventTime")


class ThreadTable:
    """Live documents and their threads. Rows: file_name, lang, site_name, fetch_time, vector, comp, thread; comp and thread are the
    least file name of the component and of the thread."""

    def __init__(self, spark: SparkSession, path: str, cfg: ClusteringConfig = EN_CLUSTERING, parts: int = PARTS):
        if cfg.budget != "unbounded" or cfg.time_penalty:
            raise ValueError("the incremental cycle needs an unbounded budget and no time penalty")
        self.spark, self.cfg, self.table = spark, cfg, KeyedTable(spark, path, parts=parts)

    def documents(self) -> DataFrame | None:
        return self.table.read()

    def apply(self, puts: DataFrame, gone: DataFrame) -> None:
        """puts: file_name (one row each), lang, site_name, fetch_time, vector. gone: file_name."""
        own = ["file_name", "lang", "site_name", "fetch_time", "vector"]
        docs = puts = cut(puts.select("file_name", "lang", "site_name", "fetch_time", F.transform("vector", lambda x: x.cast("float")).alias("vector")))
        touched = cut(puts.select("file_name").unionByName(gone.select("file_name")).distinct())
        old = self.table.read()
        if old is not None:
            # The components of the batch's files as they were, and of the documents near the new ones.
            stay = old.join(touched, "file_name", "left_anti")
            reached = cut(old.join(touched, "file_name", "left_semi").select("comp").distinct())
            near = near_any(puts, stay.join(reached, "comp", "left_anti"), self.cfg.small_threshold, "file_name", ("lang",), once="comp")
            reached = reached.unionByName(near)
            docs = cut(puts.unionByName(stay.join(reached, "comp", "left_semi").select(*own)))
        linked = linkage.link_components(docs, self.cfg)
        self.table.apply(docs.join(linked, "file_name").select(*own, "comp", "thread"), touched)


def run_threads(table: ThreadTable, changes: DataFrame, parse, checkpoint: str, trigger: dict | None = None):
    """Keep the table up with a stream of changes (as ``lifecycle`` takes them). parse: rows of file_name and payload to what ``ThreadTable.apply`` takes as puts.
    Without a trigger: all that is there, then stop. The session's settings must hold those of ``STATE_SETTINGS`` while the stream runs."""

    def batch(df: DataFrame, _: int) -> None:
        # In the table's session: that of a stream with states plans without adaptive execution, each small step in all its partitions.
        df = cut(df, table.spark)
        if df.isEmpty():
            return
        last = df.groupBy("file_name").agg(F.max_by(F.struct("action", "payload"), F.struct("seq", F.col("action") != "put")).alias("l")).select("file_name", "l.*")
        table.apply(parse(last.where("action = 'put'")), last.where("action <> 'put'"))

    out = lifecycle(changes)
    return out.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
