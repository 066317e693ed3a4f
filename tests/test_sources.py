import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import readers, sinks

GOOD = """<html><head><meta property="og:title" content="First"><meta property="og:title" content="A title">
<meta property="og:url" content="https://a.org/1"><meta property="og:site_name" content="A"><meta property="og:description" content="D">
<meta property="article:published_time" content="2020-05-01T10:00:00+00:00"></head><body><p>outside</p><article><h1>x</h1>
<p>One <b>two <i>three</i></b> <a href="https://b.org/2">link</a></p><div><p>nested</p></div><p>Four</p>
<address><time datetime="2020-05-01T09:00:00+00:00">t</time><a rel="author">An Author</a></address></article></body></html>"""


def test_html_article():
    doc = readers.parse_html(GOOD, "x/1.html", parse_links=True)
    assert doc["title"] == "A title"
    assert doc["text"] == "One two three link\nFour\n"
    assert doc["out_links"] == ["https://b.org/2"]
    assert (doc["fetch_time"], doc["pub_time"], doc["author"]) == (1588327200, 1588323600, "An Author")


@pytest.mark.parametrize("tag", ["html", "head", "body", "article"])
def test_html_without_a_part(tag):
    bad = GOOD.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    with pytest.raises(readers.BadDocument):
        readers.parse_html(bad)


def test_html_with_a_bad_date():
    with pytest.raises(readers.BadDocument):
        readers.parse_html(GOOD.replace("2020-05-01T10:00:00+00:00", "yesterday"))


def test_folder_drops_bad_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "1.html").write_text(GOOD)
    (tmp_path / "sub" / "2.html").write_text("<p>no article</p>")
    (tmp_path / "3.txt").write_text(GOOD)
    rows = readers.read_articles(spark, str(tmp_path)).collect()
    assert [r["title"] for r in rows] == ["A title"]


def test_json_and_jsonl_agree(spark, tmp_path):
    docs = [{"url": f"https://a.org/{i}", "site_name": "A", "timestamp": i, "title": "T", "description": "", "text": "x"} for i in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(docs))
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, docs), "{broken", json.dumps({"url": "u"})]))
    one = readers.read_articles(spark, str(tmp_path / "a.json")).orderBy("url").collect()
    two = readers.read_articles(spark, str(tmp_path / "a.jsonl")).orderBy("url").collect()
    assert one == two and len(one) == 3 and one[1]["fetch_time"] == 1 and one[1]["out_links"] == []


def test_reference_tables(spark, tmp_path):
    (tmp_path / "pr.tsv").write_text("0.5\ta.org\n0.25 b.org\n")
    assert {r["host"]: r["rating"] for r in readers.read_pagerank(spark, str(tmp_path / "pr.tsv")).collect()} == {"a.org": 0.5, "b.org": 0.25}
    (tmp_path / "tr.json").write_text(json.dumps([{"host": "a.org", "rating": 2.0, "country": {"US": 50.0}}]))
    assert readers.read_traffic(spark, str(tmp_path / "tr.json")).first()["country"] == {"US": 50.0}
    (tmp_path / "v.tsv").write_text("<unk>\t0\nthe\t0.1\nof\t0.2\n")
    assert [(r["token"], r["idx"]) for r in readers.read_vocabulary(spark, str(tmp_path / "v.tsv")).orderBy("idx").collect()] == [("<unk>", 0), ("the", 1), ("of", 2)]
    (tmp_path / "m.tsv").write_text("INPUT:url\tOUTPUT:res\tplain\na\tsports\tx\n")
    assert readers.read_markup(spark, str(tmp_path / "m.tsv")).columns == ["url", "res", "plain"]


def test_empty_categories_are_shown(spark):
    rows = spark.createDataFrame([("a/1.html", "sports")], "file_name string, category string")
    got = {r["category"]: r["articles"] for r in sinks.categories(rows, save_not_news=True).collect()}
    assert got["sports"] == ["1.html"] and got["science"] == [] and "not_news" in got and len(got) == 8


def test_news_of_nothing(spark):
    assert sinks.news(spark.createDataFrame([], "file_name string")).first()["articles"] == []


def test_lines_and_markup_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("sports", "a\nb", "c")], "category string, title string, text string")
    sinks.write_lines(sinks.classifier_lines(rows), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()["value"] == "__label__sports a b c"
    sinks.write_markup(rows.select("category", F.lit("y").alias("t")), str(tmp_path / "m"))
    assert readers.read_markup(spark, str(tmp_path / "m")).first()["t"] == "y"


def test_corpora_and_exported_matrices(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"headline": "A", "short_description": "b c"}\n{"headline": "D"}\n')
    assert [tuple(r) for r in readers.read_headlines(spark, str(tmp_path / "h.json")).orderBy("title").collect()] == [("A", "A b c"), ("D", "D")]
    (tmp_path / "n.csv").write_text('title,publication,date,content\nT,P,2016-12-31,"one ""two""\nthree"\nU,P,nan,x\n')
    assert [tuple(r) for r in readers.read_news_csv(spark, str(tmp_path / "n.csv")).collect()] == [("T", 'one "two"\nthree', "P", "2016-12-31")]
    (tmp_path / "t" / "sport").mkdir(parents=True)
    (tmp_path / "t" / "sport" / "1.txt").write_text("a\nb")
    assert readers.read_text_folder(spark, str(tmp_path / "t")).first()["text"] == "a b"
    (tmp_path / "m.txt").write_text("1,2.5\n-3,4e-1\n")
    assert readers.read_matrix(spark, str(tmp_path / "m.txt")).tolist() == [[1.0, 2.5], [-3.0, pytest.approx(0.4)]]


def test_pages_escape_and_are_written_apart(spark, tmp_path):
    rows = spark.createDataFrame([("en", "sports", 2, "b", ["u2"]), ("en", "sports", 1, "a <&>", ["u1", 'x"y']), ("de", "other", 1, None, [])], "lang string, category string, rank int, title string, articles array<string>")
    pages = sinks.rubric_pages(rows)
    got = {(r["lang"], r["category"]): r["html"] for r in pages.collect()}
    assert "<h2>a &lt;&amp;&gt;</h2>" in got["en", "sports"] and "x&quot;y" in got["en", "sports"] and got["en", "sports"].index("u1") < got["en", "sports"].index("u2") and len(got) == 2
    sinks.write_pages(pages, str(tmp_path / "p"))
    assert (tmp_path / "p" / "lang=en" / "category=sports").is_dir()
    report = spark.createDataFrame([("b", 0.5), ("a", 1.0)], "label string, f1 double")
    html = sinks.metrics_page(report, spark.createDataFrame([("u<", "x")], "url string, gold string")).first()["html"]
    assert html.index("<td>a</td>") < html.index("<td>b</td>") < html.index("u&lt;")


def test_language_files_and_restored_urls(spark):
    from threadloom.operators import filters, markup

    docs = spark.createDataFrame([("d/1.html", "x"), ("d/2.html", "y")], "file_name string, title string")
    listing = spark.createDataFrame([("ru", ["1.html"]), ("de", ["2.html"])], "lang_code string, articles array<string>")
    assert [r["title"] for r in filters.in_language_file(docs, listing).collect()] == ["x"]
    rows = spark.createDataFrame([('a "t"', "old"), ("unknown", "own")], "title string, url string")
    originals = spark.createDataFrame([("a t", "new")], "title string, url string")
    assert [tuple(r) for r in markup.restore_urls(rows, originals).collect()] == [('a "t"', "new")]
    assert {r["url"] for r in markup.restore_urls(rows, originals, keep_unknown=True).collect()} == {"new", "own"}
