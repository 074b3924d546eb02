"""The catalogue of indices: declared types, aliases, copies while the source is written."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import changes as ch
from docloom.operators.view import build_view, register, typed
from docloom.plans.mapping import MappingError
from docloom.sources.indices import IndexConflict, Indices
from docloom.sources.snapshots import Sealed, Snapshots
from docloom.streaming.maintain import DocumentStream

from .test_operators import TALLY, evolve, frames, plain, start

META = json.dumps({"properties": {"n": {"type": "integer"}, "v": {"type": "keyword"}}})
SCHEMA = "_id string, v string, n double"


def rows(spark, *ids, n=7.9):
    return spark.createDataFrame([(str(i), f"v{i}", n) for i in ids], SCHEMA)


def test_aliases_move_in_one_step(spark, tmp_path):
    indices = Indices(spark, str(tmp_path), buckets=2)
    assert indices.resolve("docs") == "docs" and indices.read("docs") is None
    indices.create("docs_1", META)
    indices.create("docs_1", META)
    with pytest.raises(ValueError):
        indices.create("docs_1", json.dumps({"properties": {}}))
    indices.create("docs_2", like="docs_1")
    assert indices.target("docs_2") == {"n": "integer", "v": "keyword"}
    indices.write("docs_1", rows(spark, 1, 2))
    with pytest.raises(MappingError):
        indices.write("docs_2", rows(spark, 1).withColumn("other", F.lit(1)))
    with pytest.raises(LookupError):
        indices.point({"docs": "docs_1", "more": "docs_3"})
    with pytest.raises(ValueError):
        indices.point({"docs_2": "docs_1"})
    assert indices.state()["aliases"] == {}, "all or none of them"
    indices.point({"docs": "docs_1", "more": "docs_1"})
    assert sorted(map(tuple, Indices(spark, str(tmp_path)).read("docs").select("_id", "n").collect())) == [("1", 7), ("2", 7)]
    with pytest.raises(ValueError):
        indices.create("docs", META)
    with pytest.raises(ValueError):
        indices.drop("docs_1")
    indices.point({"docs": "docs_2", "more": "docs_2"})
    indices.drop("docs_1")
    assert indices.open("docs").path.endswith("docs_2") and Snapshots(spark, str(tmp_path), "docs_1").version() is None
    with pytest.raises(LookupError):
        indices.drop("docs_1")


def test_catching_up_sends_no_ids_to_everyone(spark, tmp_path, monkeypatch):
    """ids that are small as files are many times as large in the driver."""
    indices, plans, update = Indices(spark, str(tmp_path), buckets=1), [], Snapshots.update
    indices.create("a")
    indices.write("a", rows(spark, *range(50)))
    since = indices.copy("a", "b")
    indices.open("a").update(rows(spark, 3, 77, n=1.5), rows(spark, 4).select("_id"))
    monkeypatch.setattr(Snapshots, "update", lambda self, up, gone, *more: plans.append(gone._jdf.queryExecution().executedPlan().toString()) or update(self, up, gone, *more))
    indices.catch_up("a", "b", since)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0] and plain(indices.read("b")) == plain(indices.read("a"))


def test_another_writer_of_the_catalogue_is_noticed(spark, tmp_path):
    one, other = Indices(spark, str(tmp_path)), Indices(spark, str(tmp_path))
    one.create("a")

    def edit(state):
        other.create("b")
        state["aliases"]["x"] = "a"

    with pytest.raises(IndexConflict):
        one._change(edit)
    assert one.state() == {"meta": {"a": None, "b": None}, "aliases": {}}
    assert not [n for n in one._names() if n.startswith("writing")], "no half state is left"


def test_a_copy_follows_its_source(spark, tmp_path):
    """Writes while documents are copied, and while the copy catches up, are in the new index; later ones are told."""
    indices = Indices(spark, str(tmp_path), buckets=16, most_deltas=2)
    indices.create("old")
    indices.write("old", rows(spark, *range(200)))
    indices.point({"docs": "old"})
    indices.create("new", META)
    old, none = indices.open("docs"), spark.createDataFrame([], "_id string")
    old.update(rows(spark, 500), none, {"s": 3})
    part = spark.createDataFrame([("9", 11.0)], "_id string, n double")
    writes = [
        lambda: old.update(rows(spark, 1, 600, n=8.5), rows(spark, 2).select("_id"), {"s": 4}), lambda: old.update(rows(spark), none, {"s": 5}, [(["n"], part)]),
        lambda: old.update(rows(spark), rows(spark, 500).select("_id"), {"s": 6}),
    ]

    def change(docs):
        if writes:
            writes.pop(0)()
        return docs.filter("_id <> '3'").withColumn("v", F.upper("v"))

    indices.reindex("docs", "new", change)
    want = {str(i): (f"V{i}", 7) for i in range(200) if i not in (2, 3)} | {"1": ("V1", 8), "600": ("V600", 8), "9": ("V9", 11)}
    assert not writes and indices.resolve("docs") == "new"
    assert {r["_id"]: (r.v, r.n) for r in indices.read("docs").collect()} == want
    assert indices.open("docs").applied("s") == 6
    with pytest.raises(Sealed):
        old.update(rows(spark, 1), none)
    with pytest.raises(Sealed):
        old.write(rows(spark, 1))
    assert old.compact() is None and old.read().count() == 200
    assert old.seal(old.version(), sealed=False) and old.update(rows(spark, 7), none) > 0, "a seal can be taken back"


def test_only_changed_buckets_are_read_again(spark, tmp_path):
    store, none = Snapshots(spark, str(tmp_path), "x", buckets=64), spark.createDataFrame([], "_id string")
    store.write(rows(spark, *range(2000)))
    store.update(rows(spark, 5), rows(spark, 6).select("_id"))
    docs, inside = store.changed_since(0)
    found = {r["_id"] for r in docs.collect()}
    assert "5" in found and "6" not in found and len(found) < 200
    assert {r["_id"] for r in store.read().filter(inside(F.col("_id"))).collect()} == found
    assert store.changed_since(1)[0].count() == 0 and not store.read().filter(store.changed_since(1)[1](F.col("_id"))).count()


def test_a_stream_goes_on_in_the_new_index(spark, tmp_path):
    """A batch that finds its index sealed waits until the alias moves, and is in the index that it then stands for."""
    import random

    rng, now = random.Random(2), {"state": start()}
    stream = DocumentStream(spark, [TALLY], lambda session: frames(session, now["state"]), str(tmp_path))
    indices = Indices(spark, str(tmp_path))
    indices.create("tally_1")
    indices.point({TALLY.index: "tally_1"})
    stream.load()

    def batch(n):
        now["state"], log = evolve(now["state"], rng, 8)
        stream.apply(spark.createDataFrame([(n * 100 + r[0], *r[1:]) for r in log], ch.CHANGE), n, "s")

    batch(0)
    old = indices.open(TALLY.index)
    since = indices.copy(TALLY.index, "tally_2")
    assert old.seal(since) and not old.seal(since)

    def later():
        time.sleep(2)
        indices.point({TALLY.index: "tally_2"})

    mover = threading.Thread(target=later)
    mover.start()
    batch(1)
    mover.join()
    register(spark, frames(spark, now["state"]))
    assert plain(indices.read(TALLY.index)) == plain(build_view(spark, TALLY))
    assert indices.open("tally_2").applied("s") == 1 and indices.open("tally_1").applied("s") == 0

    types = {"id": {"type": "keyword"}, "label": {"type": "keyword"}, "keeper": {"type": "keyword"}, "n": {"type": "integer"}}
    indices.create("tally_3", json.dumps({"properties": types}))
    stream.rebuild(TALLY, "tally_3")
    batch(2)
    register(spark, frames(spark, now["state"]))
    assert plain(indices.read(TALLY.index)) == plain(typed(build_view(spark, TALLY), indices.target("tally_3"))), "batches have the new index's types too"
    assert indices.open("tally_3").applied("s") == 2
    indices.create("tally_4", json.dumps({"properties": {"id": {"type": "keyword"}}}))
    with pytest.raises(MappingError):
        stream.rebuild(TALLY, "tally_4")
    batch(3)
    assert indices.resolve(TALLY.index) == "tally_3" and indices.open("tally_3").applied("s") == 3, "what failed leaves the old index open"
