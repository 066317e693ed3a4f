import pytest
from pyspark.sql import functions as F

from threadloom.plans import query_stream as Q
from threadloom.schema import DOC_EVENT
from threadloom.streaming import store as st


def event(seq, method, name, age, at=None, cat="sports", title="t"):
    import json

    body = None if at is None else json.dumps({"url": f"https://a.org/{name}", "host": "a.org", "title": title, "lang": "en", "category": cat, "fetch_time": at, "thread_id": "en-1"})
    return (seq, method, name, age, body)


EVENTS = [
    event(1, "PUT", "a", "max-age=100", 1000), event(2, "PUT", "b", "max-age=10", 1000), event(3, "PUT", "c", "no-cache", 1000), event(4, "POST", "d", "no-cache", 1000),
    event(5, "PUT", "a", "max-age=100", 1000, "undefined", "bad"), event(6, "PUT", "e", "max-age=100", 1050), event(7, "DELETE", "nothing", None), event(8, "PUT", "f", "max-age=9", 900),
    event(9, "PUT", "g", "max-age=99", 1040), event(10, "DELETE", "g", None), event(11, "PUT", "e", "max-age=100", 1060, title="new"), event(12, "PUT", "h", "soon", 1000),
]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(EVENTS, DOC_EVENT)


def test_stream_ends_like_batch(spark, frame, tmp_path):
    batch = st.DocumentStore(spark, str(tmp_path / "batch"), Q.annotated, Q.build_index)
    with pytest.raises(st.NotReady):
        batch.threads(100, "en", "any")
    batch.apply(frame)
    for k in range(4):
        frame.where(F.col("seq").between(3 * k + 1, 3 * k + 3)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = st.DocumentStore(spark, str(tmp_path / "stream"), Q.annotated, Q.build_index)
    source = spark.readStream.schema(DOC_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    st.run_stream(stream, source, str(tmp_path / "cp")).awaitTermination()
    seen = lambda s: sorted((r["file_name"], r["title"]) for r in s.documents().collect())
    assert seen(batch) == seen(stream) == [("a", "t"), ("b", "t"), ("e", "new"), ("f", "t")]
    assert sorted(r["file_name"] for r in stream.live().collect()) == ["a", "e"]
    assert stream.threads(1000, "en", "any").first()["size"] == 2
    assert stream.threads(1000, "de", "any").count() == 0
    with pytest.raises(st.BadRequest):
        stream.threads(-1, "en", "any")
    assert stream.get("e").first()["title"] == "new"


def test_statuses(spark, frame):
    old = spark.createDataFrame([("b",), ("g",)], "file_name string")
    got = {r["seq"]: r["status"] for r in st.respond(frame, old, Q.annotated).collect()}
    assert got == {1: 201, 2: 204, 3: 400, 4: 200, 5: 204, 6: 201, 7: 404, 8: 201, 9: 204, 10: 204, 11: 201, 12: 400}
