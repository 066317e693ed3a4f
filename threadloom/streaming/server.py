"""The continuous service: documents by HTTP, threads by query.

Requests become events in a folder; a loop applies what has come as a stream and publishes a new index; queries read the
last published one. ``Service.handle`` answers a request without a socket, ``serve`` puts it behind the standard
library's server.
"""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnnotatorConfig
from ..operators import importance as imp
from ..operators import ratings, threads
from ..operators.annotate import annotate
from ..plans import modes
from ..schema import DOC_EVENT, TRAFFIC
from ..sources.readers import parse_pages
from .store import BadRequest, DocumentStore, NotReady, run_stream


def html_annotation(cfg: AnnotatorConfig = AnnotatorConfig(save_not_news=True), embed=None):
    """Bodies are HTML. ``indexable`` is null where a body is no article."""
    embedder = embed or modes.ArticleEmbedder()

    def run(rows: DataFrame) -> DataFrame:
        parsed = parse_pages(rows.select(F.col("seq").cast("string").alias("file_name"), F.col("body").alias("html"))).withColumn("_seq", F.col("file_name").cast("long"))
        done = annotate(parsed, cfg, cfg.languages, "top", embed=embedder).drop("file_name").withColumn("_whole", F.lit(True))
        out = rows.join(parsed.select("_seq", F.lit(True).alias("_parsed")), F.col("seq") == F.col("_seq"), "left").drop("_seq")
        out = out.join(done, F.col("seq") == F.col("_seq"), "left")
        return out.withColumn("indexable", F.when(F.col("_parsed"), F.coalesce("_whole", F.lit(False)))).drop("_seq", "_parsed", "_whole", "body")

    return run


def index_builder(spark: SparkSession, pagerank: DataFrame | None = None, traffic: DataFrame | None = None, configs=None):
    """Live documents to the table that ``DocumentStore.threads`` ranks."""
    pagerank = pagerank if pagerank is not None else spark.createDataFrame([], "host string, rating double")
    traffic = traffic if traffic is not None else spark.createDataFrame([], TRAFFIC)

    def build(docs: DataFrame) -> DataFrame:
        rows = docs.join(modes.cluster(docs, configs).select("file_name", "thread_id"), "file_name")
        shown = threads.headlines(ratings.with_pagerank(threads.relevance(rows), pagerank))
        titles = shown.groupBy("thread_id").agg(F.min_by("title", "pos").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "file_name"))), lambda x: x["file_name"]).alias("articles"))
        main = imp.importance(ratings.with_traffic(rows, traffic)).drop("combo")
        out = threads.freshest(rows).join(threads.category(rows), "thread_id").join(main, "thread_id").join(titles, "thread_id")
        out = out.join(rows.groupBy("thread_id").agg(F.min("lang").alias("lang")), "thread_id")
        return out.withColumn("lang_ord", F.when(F.col("lang") == "en", 0).otherwise(1)).join(F.broadcast(threads.nth_timestamp(docs)), F.lit(True))

    return build


class Service:
    def __init__(self, spark: SparkSession, path: str, annotation=None, build=None, sleep: float = 1.0):
        self.spark, self.path, self.sleep = spark, path.rstrip("/"), sleep
        self.store = DocumentStore(spark, f"{self.path}/store", annotation or html_annotation(), build or index_builder(spark))
        self.stopped = threading.Event()

    def cycle(self) -> None:
        """Apply all events that have come, and publish."""
        source = self.spark.readStream.schema(DOC_EVENT).json(f"{self.path}/events")
        run_stream(self.store, source, f"{self.path}/checkpoint").awaitTermination()

    def loop(self) -> None:
        while not self.stopped.wait(self.sleep):
            self.cycle()

    def _event(self, method: str, name: str, age: str | None, body: str | None) -> tuple[int, DataFrame]:
        event = self.spark.createDataFrame([(time.time_ns(), method, name, age, body)], DOC_EVENT)
        status = self.store.respond(event).first()["status"]
        if status in (201, 204, 200) and not (method == "POST" and age == "no-cache"):
            event.coalesce(1).write.mode("append").json(f"{self.path}/events")
        return status, event

    def handle(self, method: str, target: str, headers: dict | None = None, body: str | None = None) -> tuple[int, object]:
        """(status, JSON value or None)."""
        url = urlsplit(target)
        name, query = unquote(url.path).lstrip("/"), {k: v[0] for k, v in parse_qs(url.query).items()}
        try:
            if method == "GET" and name == "threads":
                rows = self.store.threads(int(query["period"]), query["lang_code"], query["category"]).orderBy("rank")
                return 200, {"threads": [{"title": r["title"], "category": r["category"], "articles": r["articles"]} for r in rows.collect()]}
            if method == "GET":
                found = self.store.get(name).drop("vector").toJSON().collect()
                return (200, json.loads(found[0])) if found else (404, None)
            if method not in ("PUT", "POST", "DELETE") or not name:
                return 400, None
            status, event = self._event(method, name, (headers or {}).get("Cache-Control"), body)
            if method == "POST" and status < 300:
                row = self.store.annotate(event.withColumn("ttl", F.lit(0).cast("long")).select("seq", "file_name", "ttl", "body")).first()
                return status, {"lang_code": row["lang"], "is_indexed": bool(row["indexable"]), "is_news": row["category"] not in (None, "not_news"), "categories": [row["category"]] if row["category"] else []}
            return status, None
        except (KeyError, ValueError, BadRequest):
            return 400, None
        except NotReady:
            return 503, None


def serve(service: Service, port: int = 8080) -> ThreadingHTTPServer:
    """A running server, its loop beside it; shut down by ``server.shutdown()`` and ``service.stopped.set()``."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, value = service.handle(self.command, self.path, dict(self.headers), body)
            data = b"" if value is None else json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = answer

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    threading.Thread(target=service.loop, daemon=True).start()
    return server
