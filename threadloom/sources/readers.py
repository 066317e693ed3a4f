"""Article readers (HTML folders, JSON arrays, JSON lines) and reference tables (ratings, vocabularies, markup)."""

from __future__ import annotations

import calendar
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JSON_DOC, RAW_DOC, TRAFFIC

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)([+-])(\d\d):(\d\d)")


class BadDocument(ValueError):
    """A page without the parts that an article needs, or with a date that does not parse."""


def parse_date(text: str) -> int:
    """As functions.scalars.iso_to_epoch, but with days and months beyond their range carried over."""
    m = _ISO.fullmatch(text)
    if not m:
        raise BadDocument("date")
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    at = calendar.timegm((year, month, 1, hour, minute, second)) + (day - 1) * 86400
    zone = int(m[8]) * 3600 + int(m[9]) * 60
    return max(at - zone if m[7] == "+" else at + zone, 0)


class _Article(HTMLParser):
    """Collects meta properties, direct paragraphs of the article, their links, and the address."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.seen: set[str] = set()
        self.meta: dict[str, str] = {}
        self.paragraphs: list[str] = []
        self.links: list[str] = []
        self.author = self.datetime = None
        self.has_meta = self.in_author = self.address = False

    def path(self, *tags: str) -> bool:
        return self.stack[-len(tags) :] == list(tags)

    def in_paragraph(self) -> bool:
        """Within a paragraph that is a child of the article."""
        return self.stack[:4] == ["html", "body", "article", "p"]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "p" and "p" in self.stack:  # an unclosed paragraph ends where the next begins
            del self.stack[self.stack.index("p") :]
        self.seen.add("/".join([*self.stack, tag]) if len(self.stack) < 3 else tag)
        if tag == "meta" and self.stack[:2] == ["html", "head"] and len(self.stack) == 2:
            self.has_meta = True
            if attrs.get("property") and attrs.get("content") is not None:
                self.meta[attrs["property"]] = attrs["content"]
        if tag == "p" and self.stack == ["html", "body", "article"]:
            self.paragraphs.append("")
        if tag == "a" and self.in_paragraph() and attrs.get("href"):
            self.links.append(attrs["href"])
        if self.path("article", "address"):
            if tag == "time" and self.datetime is None and attrs.get("datetime"):
                self.datetime = attrs["datetime"]
            if tag == "a" and self.author is None and attrs.get("rel") == "author":
                self.in_author, self.author = True, ""
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_author = False
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if self.in_author:
            self.author += data
        if self.in_paragraph() and not {"script", "style"} & set(self.stack):
            self.paragraphs[-1] += data


def parse_html(html: str, file_name: str = "", parse_links: bool = False, max_words: int | None = None) -> dict:
    """One article, or BadDocument. Later meta properties win; a paragraph's text is that of all within it."""
    page = _Article()
    page.feed(html)
    page.close()
    for part in ("html", "html/head", "html/body", "html/body/article"):
        if part not in page.seen:
            raise BadDocument(part)
    if not page.has_meta:
        raise BadDocument("meta")
    text, words = "", 0
    for p in page.paragraphs:
        if max_words is not None and words >= max_words:
            break
        words += len(p.split())
        text += p + "\n"
    get = page.meta.get
    return {
        "file_name": file_name, "url": get("og:url", ""), "site_name": get("og:site_name", ""), "title": get("og:title", ""), "description": get("og:description", ""), "text": text, "author": page.author or "",
        "pub_time": parse_date(page.datetime) if page.datetime else 0, "fetch_time": parse_date(page.meta["article:published_time"]) if "article:published_time" in page.meta else 0, "out_links": page.links if parse_links else [],
    }


def parse_pages(pages: DataFrame, parse_links: bool = False, max_words: int | None = None) -> DataFrame:
    """pages: file_name, html. RAW_DOC rows; pages that are no articles are dropped."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, html in zip(pdf["file_name"], pdf["html"], strict=True):
                try:
                    rows.append(parse_html(html or "", name, parse_links, max_words))
                except BadDocument:
                    continue
            yield pd.DataFrame(rows, columns=RAW_DOC.names)

    return pages.select("file_name", "html").mapInPandas(run, RAW_DOC)


def read_html(spark: SparkSession, folder: str, limit: int | None = None, parse_links: bool = False) -> DataFrame:
    """All ``.html`` files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(folder)
    files = files.limit(limit) if limit is not None and limit >= 0 else files
    return parse_pages(files.select(F.col("path").alias("file_name"), F.col("content").cast("string").alias("html")), parse_links)


def _from_json(rows: DataFrame) -> DataFrame:
    """Malformed rows are dropped; so are rows without a required field."""
    needed = ("url", "site_name", "timestamp", "title", "description", "text")
    rows = rows.where(F.col("_corrupt_record").isNull() if "_corrupt_record" in rows.columns else F.lit(True)).dropna(subset=list(needed))
    return rows.select(
        F.coalesce("file_name", F.lit("")).alias("file_name"), "url", "site_name", "title", "description", "text", F.lit("").alias("author"), F.lit(0).cast("long").alias("pub_time"),
        F.col("timestamp").alias("fetch_time"), F.coalesce("out_links", F.array().cast("array<string>")).alias("out_links"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of articles."""
    return _from_json(spark.read.schema(JSON_DOC).option("multiLine", "true").json(path))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _from_json(spark.read.schema(JSON_DOC).json(path))


def read_articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """By suffix: ``.json``, ``.jsonl``, else a folder of HTML files; the limit holds for folders."""
    if path.endswith(".json"):
        return read_json(spark, path)
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    return read_html(spark, path, limit)


def read_pagerank(spark: SparkSession, path: str) -> DataFrame:
    """Lines of rating and host, apart by a tab (or a blank, as other tools write them)."""
    cols = F.split(F.trim("value"), r"[\t ]+")
    return spark.read.text(path).where(F.size(cols) == 2).select(cols[1].alias("host"), cols[0].cast("double").alias("rating"))


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAFFIC).option("multiLine", "true").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Lines of token and idf; a token's index is its line, and line 0 is ``<unk>``. One file, read in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("idx", "line"))
    cols = F.split("line", "\t")
    return lines.select(cols[0].alias("token"), "idx", cols[1].cast("double").alias("idf"))


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """Crowd-task TSV; column names lose their ``INPUT:`` and like prefixes."""
    rows = spark.read.option("header", "true").option("sep", "\t").csv(path)
    return rows.toDF(*[c.split(":")[-1] for c in rows.columns])


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """Lines of numbers apart by commas, in file order: a small matrix (or one column) of an exported model."""
    lines = spark.read.text(path, wholetext=True).first()
    return np.array([[float(x) for x in line.split(",")] for line in lines["value"].split("\n") if line.strip()], np.float32)


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of headline and short_description: title, text."""
    rows = spark.read.schema("headline string, short_description string").json(path)
    return rows.select(F.col("headline").alias("title"), F.concat_ws(" ", "headline", "short_description").alias("text"))


def read_news_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header and texts that span lines: title, text, site_name, date. Rows without a date are dropped."""
    names = columns or {"title": "title", "text": "content", "site_name": "publication", "date": "date"}
    rows = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    return rows.select(*[F.col(c).alias(k) for k, c in names.items()]).where(F.coalesce(F.col("date"), F.lit("")).rlike(r"\d{4}-\d{2}-\d{2}"))


def read_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each text, folders for rubrics: file_name, text with blanks for line ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file_name"), F.translate(F.col("content").cast("string"), "\n", " ").alias("text"))
