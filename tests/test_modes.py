import io
import json

import pytest

from threadloom.__main__ import main
from threadloom.plans import modes


@pytest.fixture(scope="module")
def articles(tmp_path_factory):
    story = "The team and the coach of the league won the match in the last minute of the season"
    docs = [
        {"url": f"https://www.s{k}.org/{k}", "site_name": f"s{k}", "timestamp": 1000 + k, "title": f"The match of the season {'was' if k < 2 else 'is'} won", "description": "", "text": f"{story} {'again ' if k == 2 else ''}and the fans cheered.", "file_name": f"dir/{k}.html"}
        for k in range(3)
    ]
    docs.append({"url": "https://b.org/9", "site_name": "b", "timestamp": 90000, "title": "Shares of the bank and the market fell in trade", "description": "", "text": "The bank said that the price of the shares and the economy were for the market to set.", "file_name": "dir/9.html"})
    docs.append({"url": "https://c.de/8", "site_name": "c", "timestamp": 500, "title": "Der Hund und die Katze", "description": "", "text": "Das ist ein Text von der Katze und dem Hund, die nicht mit den anderen sind.", "file_name": "dir/8.html"})
    path = tmp_path_factory.mktemp("in") / "a.json"
    path.write_text(json.dumps(docs))
    return str(path)


def call(spark, *args):
    out = io.StringIO()
    assert main(list(args), out) == 0
    return json.loads(out.getvalue())


def test_languages_news_categories_json(spark, articles):
    assert {x["lang_code"]: x["articles"] for x in call(spark, "languages", articles)} == {"en": ["0.html", "1.html", "2.html", "9.html"], "de": ["8.html"]}
    assert call(spark, "news", articles)["articles"] == ["0.html", "1.html", "2.html", "9.html"]
    by = {x["category"]: x["articles"] for x in call(spark, "categories", articles)}
    assert by["sports"] == ["0.html", "1.html", "2.html"] and by["economy"] == ["9.html"] and by["science"] == []
    assert {x["language"] for x in call(spark, "json", articles)} == {"en"}
    assert call(spark, "news", articles, "--languages", "de")["articles"] == ["8.html"]


def test_threads_and_top(spark, articles):
    assert sorted(sorted(x["articles"]) for x in call(spark, "threads", articles)) == [["0.html", "1.html", "2.html"], ["9.html"]]
    got = {x["category"]: x["threads"] for x in call(spark, "top", articles, "--print_top_debug_info")}
    assert list(got) == ["any", "society", "economy", "technology", "sports", "entertainment", "science", "other"]
    assert [t["size"] for t in got["any"]] == [3, 1] and got["science"] == [] and len(got["sports"][0]["features"]) == 50
    assert set(got["sports"][0]["articles"]) == {"0.html", "1.html", "2.html"} and got["sports"][0]["age_penalty"] < 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        modes.run(spark, "everything", "x")
