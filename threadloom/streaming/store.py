"""A keyed document store, changed by document events, and the index that queries read.

Documents lie in a ``KeyedTable``. The index is written whole: a version is a folder of Parquet; readers see the version that a
pointer names, and the pointer moves only once the version is complete, so a reader sees the old state or the new one.
Everything lies in the folder that driver and executors share, and is reached through Spark's file system layer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RankerConfig
from ..functions.scalars import ttl_seconds
from ..operators.filters import not_stale
from ..operators.rank import rank
from ..storage import cut
from .keyed import PARTS, KeyedTable


class NotReady(RuntimeError):
    """Asked before the first index was published."""


class BadRequest(ValueError):
    """A parameter outside its range."""


class Versions:
    """Complete versions of a table under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        if not fs.exists(folder):
            return None
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=None)

    def read(self) -> DataFrame | None:
        n = self.current()
        return None if n is None else self.spark.read.parquet(f"{self.path}/v={n}")

    def publish(self, df: DataFrame, keep: int = 2) -> int:
        n = (self.current() or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        jvm, fs = self._fs()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.path}/current"))
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/current/{n}")).close()
        for old in range(max(1, n - keep - 1), n - keep + 1):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/current/{old}"), False)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)
        return n


def changes(events: DataFrame, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """events: seq, method, file_name, cache_control, body. The last change of each file: its annotated columns, ``seq``
    and ``gone``. Puts without a positive ttl or that are not indexable change nothing; a delete goes by its file name.

    annotate: rows of (seq, file_name, ttl, body) to annotated rows with seq, file_name, ttl and ``indexable``.
    """
    written = events.where("method in ('PUT', 'POST')").withColumn("ttl", ttl_seconds(F.col("cache_control"))).where("ttl is not null and ttl >= 0")
    docs = annotate(written.select("seq", "file_name", "ttl", "body")).where("indexable").drop("indexable").withColumn("gone", F.lit(False))
    deleted = events.where("method = 'DELETE'").select("seq", "file_name").withColumn("gone", F.lit(True))
    every = docs.unionByName(deleted, allowMissingColumns=True)
    return every.groupBy("file_name").agg(F.max_by(F.struct(*every.columns), "seq").alias("_d")).select("_d.*")


def respond(events: DataFrame, store: DataFrame | None, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What each event is answered with: seq, status. Statuses count files that the store holds before the events."""
    ttl = ttl_seconds(F.col("cache_control"))
    docs = annotate(events.where("method in ('PUT', 'POST')").withColumn("ttl", ttl).select("seq", "file_name", "ttl", "body")).select("seq", "indexable")
    rows = events.join(docs, "seq", "left")
    if store is not None:
        rows = rows.join(store.select("file_name", F.lit(True).alias("_old")), "file_name", "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("boolean"))
    fresh = F.when(F.col("_old"), 204).otherwise(201)
    status = (
        F.when(F.col("method") == "DELETE", F.when(F.col("_old"), 204).otherwise(404))
        .when(ttl.isNull() | ((F.col("method") == "PUT") & (ttl < 0)) | F.col("indexable").isNull(), 400)
        .when(F.col("method") == "PUT", F.when(F.col("indexable"), fresh).otherwise(204))
        .otherwise(F.when(F.col("indexable") & (ttl >= 0) & F.col("_old").isNull(), 201).otherwise(200))
    )
    return rows.select("seq", "file_name", status.alias("status"))


class DocumentStore:
    """Documents, and the index of threads built from them."""

    def __init__(self, spark: SparkSession, path: str, annotate: Callable, build: Callable[[DataFrame], DataFrame], parts: int = PARTS):
        """build: live documents to threads (thread_id, lang, lang_ord, category, size, freshest_ts, best_ts, importance,
        iter_ts, and what queries are to return)."""
        self.spark, self.annotate, self.build = spark, annotate, build
        self.docs_at, self.index_at = KeyedTable(spark, f"{path}/docs", parts=parts), Versions(spark, f"{path}/index")

    def apply(self, events: DataFrame) -> None:
        """Latest wins, deleted files go; only the parts of the changed files are rewritten."""
        change = cut(changes(events, self.annotate))
        self.docs_at.apply(change.where(~F.col("gone")).drop("gone", "seq"), change.select("file_name"))

    def respond(self, events: DataFrame) -> DataFrame:
        """``respond`` against this store: the filters rule most absent files out, and only the parts of the others are read."""
        asked = self.docs_at.may_hold(events.select("file_name").distinct()).where("may_hold")
        held = self.docs_at.lookup(asked)
        return respond(events, None if held is None else held.select("file_name"), self.annotate)

    def documents(self) -> DataFrame | None:
        return self.docs_at.read()

    def live(self) -> DataFrame:
        """Documents whose time to live has not run out by the newest document's clock. An old document is taken in, and
        goes at the next cycle if it is stale."""
        return not_stale(self.documents())

    def rebuild(self) -> None:
        self.index_at.publish(self.build(self.live()))

    def get(self, file_name: str) -> DataFrame:
        found = self.docs_at.lookup(self.spark.createDataFrame([(file_name,)], "file_name string"))
        if found is None:
            raise NotReady
        return found

    def threads(self, period: int, lang: str, category: str, cfg: RankerConfig = RankerConfig()) -> DataFrame:
        """The best threads of the last ``period`` seconds before the newest one, at most ``cfg.top``."""
        from ..schema import CATEGORIES

        if period < 0 or category not in CATEGORIES[1:]:
            raise BadRequest("period or category")
        index = self.index_at.read()
        if index is None:
            raise NotReady
        own = index.where(F.col("lang") == lang)
        newest = index.agg(F.greatest(F.max("freshest_ts") - period, F.lit(0)).alias("_from"))
        rows = own.join(F.broadcast(newest), F.col("freshest_ts") >= F.col("_from")).drop("_from")
        clock = index.agg(F.max("iter_ts").alias("iter_ts"))
        return rank(rows.drop("iter_ts"), clock, cfg, cfg.top).where(F.col("category") == category)


def run_stream(store: DocumentStore, events: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Apply a stream of events batch by batch, and rebuild the index after each. A batch applied twice ends in the same
    store, as latest wins. Without a trigger: all that is there, then stop."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            store.apply(df)
            store.rebuild()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
