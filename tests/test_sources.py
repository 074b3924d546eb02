"""A capturer's log as a source, gaps in it, vectors kept over runs, and children that have no order."""

import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docloom.functions.embed import Limits, in_task, limits
from docloom.operators.view import build_view, register
from docloom.plans.mapping import Field, Mapping
from docloom.sources.capture import _Log, capture_log, retained
from docloom.sources.vectors import KeptVectors
from docloom.streaming.supervise import Alerts, committed_offsets, gaps, lost_since, supervised


def line(n):
    row = {"seq": n, "type": "INSERT", "is_ddl": False, "db": "d", "table": "t", "pk": ["id"], "es": n, "ts": 0, "before": None, "after": {"id": str(n), "x": "y" * (n % 50), "none": None}, "updated": []}
    return json.dumps(row) + "\n"


def test_a_log_is_read_once_whatever_the_ranges(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "bin.000001").write_text("".join(map(line, range(100))))
    (log / "bin.000002").write_text("".join(map(line, range(100, 150))) + line(150)[:20])
    for size in (97, 700, 1 << 20):
        assert sorted(r["seq"] for r in capture_log(spark, str(log), stream=False, rangeBytes=size).collect()) == list(range(150))
    state = {"checkpoint": str(tmp_path / "first"), "out": str(tmp_path / "out")}

    def start():
        return capture_log(spark, str(log), rangeBytes=900, maxBytesPerTrigger=6000).writeStream.format("parquet").option("path", state["out"]).option("checkpointLocation", state["checkpoint"]).start()

    def run():
        running = start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        return sorted(r["seq"] for r in spark.read.parquet(state["out"]).collect())

    assert run() == list(range(150)), "the line that has no end yet waits"
    (log / "bin.000002").write_text("".join(map(line, range(152))))
    (log / "bin.000003").write_text("".join(map(line, range(152, 160))))
    (log / "bin.000002").write_text("".join(map(line, range(100, 152))))
    assert run() == list(range(160))
    lost = lost_since(spark, lambda: state["checkpoint"], lambda: retained(str(log)))
    assert lost() == [] and committed_offsets(spark, state["checkpoint"])[0]["file"] == "bin.000003" and committed_offsets(spark, str(tmp_path / "none")) == []
    for n in (1, 2, 3):
        (log / f"bin.00000{n}").unlink()
    (log / "bin.000007").write_text(line(300))
    assert lost() == ["bin.000003"]
    with pytest.raises(StreamingQueryException, match="LostLog"):
        run()
    rebuilt, sent = [], []

    class Until:
        """A stream that ends when all that is there is read."""

        def awaitTermination(self):  # noqa: N802
            self.query = start()
            self.query.processAllAvailable()
            self.query.stop()

    def rebuild():
        rebuilt.append(1)
        state.update(checkpoint=str(tmp_path / "second"), out=str(tmp_path / "out2"))

    assert supervised(Until, Alerts(sent.append), pause_s=0, lost=lost, on_loss=rebuild) == 0
    assert rebuilt == [1] and sent == ["lost: bin.000003"] and [r["seq"] for r in spark.read.parquet(state["out"]).collect()] == [300]


def test_gaps_of_topics():
    committed = {"a": {"0": 10, "1": 20}, "b": {"0": 5}}
    assert gaps(committed, {"a": {"0": 10, "1": 0}, "b": {"0": 0}}) == []
    assert gaps(committed, {"a": {"0": 11, "1": 0}}) == ["a-0", "b-0"]
    assert gaps({"file": "f2", "position": 9}, {"file": "f2", "size": 8}) == ["f2"] and gaps({"file": "", "position": 0}, {"file": "f9", "size": 1}) == []


class Counting:
    def __init__(self, calls, texts):
        self.calls, self.texts = calls, texts

    def __call__(self, some):
        self.calls.add(1)
        self.texts.add(len(some))
        return [[float(len(t))] for t in some]


def test_limits_come_from_the_mapping():
    assert limits({"modelClass": "m"}) == Limits(6, 60, "m//") and limits({"request-max-content-size": 3, "qpm": 0, "requestQueueName": "q"}) == Limits(3, None, "q")


def test_models_in_the_task_have_no_rate(spark):
    """The default rate is a service's: a model that computes in the task is not slowed by it, a service keeps to it."""
    m = Mapping("docs", "SELECT a.id AS id, a.name AS name FROM author a", fields=(Field("name", "llm-vector", params={"modelClass": "m", "requestMaxContentSize": 1}),)).check()
    register(spark, {"author": spark.range(60).selectExpr("id", "concat('name', id) AS name")})
    began = time.monotonic()
    got = build_view(spark, m, models={"m": in_task(lambda texts: [[float(len(t))] for t in texts])}).collect()
    assert time.monotonic() - began < 40 and sorted(r["name"][0] for r in got) == [5.0] * 10 + [6.0] * 50  # 60 requests took 59 s
    assert limits({}).of(len) == Limits(6, 60, "//") and limits({"qpm": 5}).of(in_task(lambda texts: [])).per_minute is None


def test_vectors_are_asked_for_once(spark, tmp_path):
    """Children of nested fields and main columns of one queue share what is kept, within the mapping's limits."""
    params = {"modelClass": "m", "qpm": 6000, "requestMaxContentSize": 1}
    m = Mapping(
        "docs", "SELECT a.id AS id, a.name AS name FROM author a",
        fields=(
            Field("name", "llm-vector", params=params), Field("books", "array-sql", sql="SELECT b.title AS title, b.facts AS facts FROM book b", on_main="WHERE b.author = #{id}"),
            Field("books$title", "llm-vector", params=params), Field("books$facts", "object"),
        ),
    ).check()
    register(spark, {"author": spark.createDataFrame([(1, "ann"), (2, " "), (3, None)], "id int, name string"), "book": spark.createDataFrame([(1, "zz", '{"p": 1}'), (1, "ann", None), (1, None, "{}"), (3, "a title", '{"q": {"r": 2}}')], "author int, title string, facts string")})
    sc, kept = spark.sparkContext, KeptVectors(spark, str(tmp_path))
    calls, texts = sc.accumulator(0), sc.accumulator(0)
    for _ in range(2):
        got = {r["id"]: r for r in build_view(spark, m, models={"m": Counting(calls, texts)}, vectors=kept).collect()}
    assert calls.value == texts.value == 3, "ann, zz and a title, one text in a request"
    assert got[1]["name"] == [3.0] and got[2]["name"] is None and [b["title"] for b in got[1]["books"]] == [None, [3.0], [2.0]]
    assert [b["facts"] for b in got[1]["books"]] == [{}, None, {"p": "1"}] and got[3]["books"][0]["title"] == [7.0]
    again = sc.accumulator(0)
    plain = build_view(spark, m, models={"m": Counting(again, sc.accumulator(0))}).filter(F.col("id") == 1).collect()
    assert plain[0]["books"] == got[1]["books"] and again.value == 4, "without what is kept, each field asks for itself"


def test_many_small_ranges_are_few_tasks(spark, tmp_path):
    """A log of very many times rangeBytes is read by a bounded number of tasks, each line once."""
    for n in range(3):
        (tmp_path / f"bin.{n}").write_text("".join(map(line, range(n * 1000, n * 1000 + 1000))))
    log = _Log({"path": str(tmp_path), "rangebytes": 100})
    ends = log.ranges({"file": "", "position": 0}, {"file": "bin.2", "position": log.files()[-1][1]})
    assert 100 < len(ends) <= 128 + 3
    assert sorted(n for part in ends for batch in log.read(part) for n in batch.column("seq").to_pylist()) == list(range(3000))
