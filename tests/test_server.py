from threadloom.operators import filters
from threadloom.streaming.server import Service

PAGE = """<html><head><meta property="og:title" content="The match of the season was won"><meta property="og:url" content="https://a{k}.org/1"><meta property="og:site_name" content="a{k}">
<meta property="article:published_time" content="2020-05-01T10:0{k}:00+00:00"></head><body><article><p>The team and the coach of the league won the match in the last minute of the season.</p></article></body></html>"""


def test_documents_in_threads_out(spark, tmp_path):
    service = Service(spark, str(tmp_path))
    ask = "/threads?period=86400&lang_code=en&category=any"
    assert service.handle("GET", ask)[0] == 503
    age = {"Cache-Control": "max-age=86400"}
    for k in range(2):
        assert service.handle("PUT", f"/{k}.html", age, PAGE.replace("{k}", str(k))) == (201, None)
    assert service.handle("PUT", "/x.html", {"Cache-Control": "no-cache"}, PAGE)[0] == 400
    assert service.handle("PUT", "/x.html", age, "<p>no article</p>")[0] == 400
    assert service.handle("DELETE", "/x.html")[0] == 404
    status, told = service.handle("POST", "/y.html", {"Cache-Control": "no-cache"}, PAGE.replace("{k}", "3"))
    assert status == 200 and told == {"lang_code": "en", "is_indexed": True, "is_news": True, "categories": ["sports"]}
    service.cycle()
    status, found = service.handle("GET", ask)
    assert status == 200 and [sorted(t["articles"]) for t in found["threads"]] == [["0.html", "1.html"]]
    assert service.handle("GET", "/0.html")[1]["title"] == "The match of the season was won"
    assert service.handle("GET", "/y.html")[0] == 404
    assert service.handle("GET", "/threads?period=x&lang_code=en&category=any")[0] == 400
    assert service.handle("DELETE", "/0.html")[0] == 204
    service.cycle()
    assert service.handle("GET", ask)[1]["threads"][0]["articles"] == ["1.html"]


def test_split_is_stable(spark):
    a, b = filters.split(spark.range(1000), "id")
    assert a.intersect(b).count() == 0 and a.count() + b.count() == 1000 and 850 < a.count() < 950
