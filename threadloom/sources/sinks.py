"""Output shapes of the modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_file_name
from ..schema import CATEGORIES


def _files(order: Column | None = None) -> Column:
    return F.array_sort(F.collect_list(clean_file_name(F.col("file_name")))).alias("articles")


def languages(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and lang <> 'undefined'").groupBy(F.col("lang").alias("lang_code")).agg(_files())


def news(docs: DataFrame) -> DataFrame:
    """One row; an empty list where there are no documents."""
    return docs.agg(_files())


def categories(docs: DataFrame, save_not_news: bool = False) -> DataFrame:
    """A row for every category, empty ones too."""
    names = CATEGORIES[2:] if save_not_news else CATEGORIES[2:-1]
    every = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate(names, 2)], "category string, ordinal int")
    return every.join(docs.groupBy("category").agg(_files()), "category", "left").select("category", "ordinal", F.coalesce("articles", F.array().cast("array<string>")).alias("articles"))


def documents_json(docs: DataFrame) -> DataFrame:
    """A JSON object per document; out_links only where there are some."""
    links = F.when(F.size("out_links") > 0, F.col("out_links"))
    names = [c for c in ("url", "site_name", "title", "description", "text", "file_name", "lang", "category") if c in docs.columns]
    cols = [F.col(c).alias("language" if c == "lang" else c) for c in names] + [F.col("fetch_time").alias("timestamp")]
    return docs.select("file_name", F.to_json(F.struct(*cols, *([links.alias("out_links")] if "out_links" in docs.columns else []))).alias("json"))


def threads(members: DataFrame) -> DataFrame:
    """members: thread_id, pos, title, file_name. Title of the first, files in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", clean_file_name(F.col("file_name")).alias("f"), "title")))
    return members.groupBy("thread_id").agg(rows.alias("r")).select("thread_id", F.col("r")[0]["title"].alias("title"), F.transform("r", lambda x: x["f"]).alias("articles"))


def classifier_lines(rows: DataFrame) -> DataFrame:
    """rows: category, title, text. Lines for a text classifier's trainer."""
    flat = F.translate(F.concat_ws(" ", "title", "text"), "\n\r\t", "   ")
    return rows.select(F.concat(F.lit("__label__"), F.col("category"), F.lit(" "), flat).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_markup(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rubric_pages(rows: DataFrame) -> DataFrame:
    """rows: lang, category, rank, title, articles (array of urls). A page for each language and category: lang, category, html."""
    items = F.concat_ws("", F.transform("articles", lambda u: F.concat(F.lit('<li><a href="'), _escaped(u), F.lit('">'), _escaped(u), F.lit("</a></li>"))))
    block = F.concat(F.lit("<h2>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</h2><ul>"), items, F.lit("</ul>"))
    parts = rows.select("lang", "category", F.struct("rank", block.alias("b")).alias("x")).groupBy("lang", "category").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.concat(F.lit('<html><head><meta charset="utf-8"><title>'), _escaped(F.col("category")), F.lit("</title></head><body>"))
    return parts.select("lang", "category", F.concat(head, F.concat_ws("\n", F.transform("x", lambda v: v["b"])), F.lit("</body></html>")).alias("html"))


def metrics_page(report: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row, html: a class report as a table, and the errors (any columns) as another."""

    def rows(df: DataFrame, order: list) -> DataFrame:
        cells = F.concat_ws("", *[F.concat(F.lit("<td>"), _escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns])
        head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
        made = df.select(F.struct(*order, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("b")).alias("x"))
        return made.agg(F.concat(F.lit(head), F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda v: v["b"])), F.lit("</table>")).alias("t"))

    tables = rows(report, [report.columns[0]])
    if errors is not None:
        tables = tables.join(rows(errors, errors.columns).select(F.col("t").alias("e")), F.lit(True))
    return tables.select(F.concat(F.lit('<html><head><meta charset="utf-8"></head><body>'), *tables.columns, F.lit("</body></html>")).alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    """A text file under a folder for each language and category."""
    pages.select("lang", "category", F.col("html").alias("value")).write.mode("overwrite").partitionBy("lang", "category").text(path)
