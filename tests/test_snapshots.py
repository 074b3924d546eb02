"""Merge-on-read snapshots, owner indices and field-wise recompute."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import changes as ch
from docloom.operators import incremental
from docloom.operators.view import build_view, register
from docloom.plans.lineage import Analyser
from docloom.sources.snapshots import Snapshots, no_shuffles_left
from docloom.streaming.maintain import DocumentStream
from docloom.streaming.owners import OwnerIndex

from .test_operators import MAPPING, TALLY, evolve, frames, plain, start


def bytes_of(store, version):
    """Bytes that the folders of one version hold."""
    names = [n for n in store._names() if n.startswith(f"v-{version}-")]
    return sum(store._fs.getContentSummary(store._hadoop.Path(f"{store.path}/{n}")).getLength() for n in names)


def test_ids_in_deltas_go_by_a_bounded_bitmap(spark, tmp_path, monkeypatch):
    """the bitmap passes through the driver, so it does not grow with the deltas; ids that share a place in it stay apart."""
    store = Snapshots(spark, str(tmp_path), "x", buckets=2)
    docs = spark.range(3000).select(F.col("id").cast("string").alias("_id"), F.lit(0).alias("n"))
    store.write(docs)
    store.update(docs.filter("cast(_id as int) % 3 = 0").withColumn("n", F.lit(1)), docs.select("_id").filter("cast(_id as int) % 3 = 1"))
    want, state = plain(store.read()), Snapshots.state
    large = lambda s: s | {"buckets": {b: x | {"added": 10**11} for b, x in s["buckets"].items()}}
    monkeypatch.setattr(Snapshots, "state", lambda self, version: large(state(self, version)))
    got = store.read()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert str(1 << 26) in plan and str(1 << 31) not in plan
    monkeypatch.setattr("docloom.sources.snapshots.MOST_BITS", 4)
    assert len(want) == 2000 and plain(got) == want and plain(store.read()) == want


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(n).getName().startswith("shuffle_") for n in range(files.size()))


def test_a_write_leaves_no_shuffles(spark, tmp_path):
    """what was shuffled for a write goes with it, a first version is not shuffled by buckets, and the setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs, given = spark.range(1000).select(F.col("id").cast("string").alias("_id")).repartition(3, "_id"), spark.conf.get(name)
    there, store = shuffle_files(spark), Snapshots(spark, str(tmp_path), "x", buckets=1)
    store.write(docs)
    until = time.time() + 20
    while shuffle_files(spark) > there and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= there and spark.conf.get(name) == given
    assert len(spark.read.parquet(store.path + "/v-0-*").inputFiles()) == 3 and store.read().count() == 1000
    with no_shuffles_left(spark):
        with no_shuffles_left(spark):
            assert spark.conf.get(name) == "true"
        assert spark.conf.get(name) == "true", "another thread is inside still"
    assert spark.conf.get(name) == given


def test_an_update_writes_what_it_holds(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), "x", buckets=8)
    docs = spark.range(20000).select(F.col("id").cast("string").alias("_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("n"))
    assert store.write(docs, marks={"s": 4}) == 0 and store.applied("s") == 4 and store.applied("t") == -1
    new = spark.createDataFrame([("7", "new", 1), ("100000", "new", 1)], "_id string, v string, n int")
    part = spark.createDataFrame([("8", 5), ("9", 6), ("nobody", 7)], "_id string, n int")
    assert store.update(new, spark.createDataFrame([("9",)], "_id string"), {"t": 0}, [(["n"], part.filter("_id <> '9'"))]) == 1
    got = {r["_id"]: (r["v"], r["n"]) for r in store.read().filter("n > 0 or _id in ('9', '10')").collect()}
    assert got["7"] == got["100000"] == ("new", 1) and got["8"][1] == 5 and len(got["8"][0]) == 64 and set(got) == {"7", "100000", "8", "10"}
    assert store.read().count() == 20000 and store.applied("s") == 4 and store.applied("t") == 0 and store.read(0).filter("n > 0").count() == 0
    assert bytes_of(store, 1) < bytes_of(store, 0) / 20
    assert store.update(spark.createDataFrame([("9", "again", 2, "w")], "_id string, v string, n int, more string"), spark.createDataFrame([("7",)], "_id string")) == 2
    before = plain(store.read())
    assert len(before) == 20000 and store.compact() is None
    small = Snapshots(spark, str(tmp_path), "x", bucket_bytes=100_000, most_deltas=2)
    assert small.compact() == 3 and plain(small.read()) == before and plain(store.read(2)) == before
    state = small.state(3)
    assert len(state["buckets"]) > 8 and not any(x["deltas"] for b, x in state["buckets"].items() if x["size"] > 100_000)
    assert sum(2.0 ** -(b.bit_length() - 1) for b in state["buckets"]) == 1, "the buckets are a whole tree"
    small.update(spark.createDataFrame([("9", "third", 3, "w")], "_id string, v string, n int, more string"), spark.createDataFrame([], "_id string"))
    assert small.read().filter("v = 'third'").count() == 1 and small.read().count() == 20000
    small.prune(1)
    assert small.read().count() == 20000 and [r["n"] for r in small.read(only=spark.createDataFrame([("9",)], "_id string")).filter("_id = '9'").collect()] == [3]


def test_states_are_read_from_few_commits(spark, tmp_path):
    store, none = Snapshots(spark, str(tmp_path), "x", buckets=2, most_deltas=100), spark.createDataFrame([], "_id string")
    store.write(spark.createDataFrame([(str(i), 0) for i in range(9)], "_id string, n int"))
    for n in range(1, 19):
        store.update(spark.createDataFrame([(str(n % 4), n)], "_id string, n int"), none)
    assert [store._commit(v)["whole"] for v in (0, 1, 15, 16, 17, 18)] == [True, False, False, True, False, False]
    want = [("0", 16), ("1", 17), ("2", 18), ("3", 15), *((str(i), 0) for i in range(4, 9))]
    assert sorted(map(tuple, store.read().collect())) == want
    store.prune(2)
    assert store._versions()[0] == 16 and sorted(map(tuple, store.read().collect())) == want and store.read(17).filter("n = 18").count() == 0


@pytest.mark.parametrize(("mapping", "seed"), [(MAPPING, 3), (TALLY, 4)], ids=["nested", "joined"])
def test_parts_and_owner_index_keep_the_view(spark, tmp_path, seed, mapping):
    """Batch after batch, with compaction and splits on the way, the stored documents are those of the tables."""
    rng, state, now = random.Random(seed), start(), {}
    stream = DocumentStream(spark, [mapping], lambda session: frames(session, now["state"]), str(tmp_path), snapshots={"buckets": 2, "bucket_bytes": 3000, "most_deltas": 2})
    now["state"] = state
    stream.load()
    for batch in range(3):
        now["state"], log = evolve(now["state"], rng, 8)
        stream.apply(spark.createDataFrame([(batch * 100 + r[0], *r[1:]) for r in log], ch.CHANGE), batch, "s")
        register(spark, frames(spark, now["state"]))
        assert plain(stream._store(spark, mapping).read()) == plain(build_view(spark, mapping))
    if mapping is MAPPING:
        index = OwnerIndex(spark, mapping, str(tmp_path))
        assert [f.name for f in index.fields] == ["keeper", "gear"]
        pairs = {(r["_key"], r["document"]) for r in index.store(index.fields[0]).read().collect()}
        assert pairs == {(str(c), str(i)) for i, _, c in now["state"]["plot"].values()}


def test_a_nested_change_reads_its_own_tables(spark):
    """The plan of the parts of a changed visit names no table of another field."""
    register(spark, frames(spark, start()))
    log = [(1, "UPDATE", False, "db", "visit", ["id"], 1, 0, {"id": "3", "plot_id": "3", "grade": "x"}, {"id": "3", "plot_id": "3", "grade": "g3"})]
    _, _, parts = incremental.recompute_parts(spark, MAPPING, spark.createDataFrame(log, ch.CHANGE))
    named = {names[0]: df for names, df in parts}
    plan = named["grades"]._jdf.queryExecution().optimizedPlan().toString()
    assert "make" not in plan and "mentor_id" not in plan and [r["_id"] for r in named["grades"].collect()] == ["3"]
    assert named["keeper"].count() == 0 and named["id"].count() == 0


def test_the_owner_index_follows_rows_that_move(spark, tmp_path):
    register(spark, frames(spark, start()))
    index = OwnerIndex(spark, MAPPING, str(tmp_path), buckets=2)
    index.load()
    row = lambda i, c: {"id": str(i), "label": "n", "keeper_id": str(c)}
    log = [
        (1, "INSERT", False, "db", "plot", ["id"], 1, 0, None, row(50, 1)), (2, "UPDATE", False, "db", "plot", ["id"], 1, 0, row(50, 1), row(50, 2)),
        (3, "UPDATE", False, "db", "plot", ["id"], 1, 0, row(50, 2), row(50, 1)), (4, "UPDATE", False, "db", "plot", ["id"], 1, 0, row(1, 1), row(99, 1)),
        (5, "DELETE", False, "db", "plot", ["id"], 1, 0, row(5, 1), None), (6, "UPDATE", False, "db", "plot", ["id"], 1, 0, row(9, 1), {**row(9, 1), "label": "m"}),
    ]
    for _ in range(2):
        index.apply(spark.createDataFrame(log, ch.CHANGE), "s", 0)
    f = index.fields[0]
    assert sorted(r["_id"] for r in index.owners(f, spark.createDataFrame([(1,)], "_k0 bigint")).collect()) == ["50", "9", "99"]
    assert Analyser(spark).query(MAPPING.sql).simple


def test_a_store_of_small_buckets_does_not_split_without_end(spark, tmp_path):
    """Buckets of a few bytes become larger ones where they would be very many; the documents are the same."""
    store = Snapshots(spark, str(tmp_path), "i", buckets=4, bucket_bytes=50)
    docs = spark.range(3000).selectExpr("cast(id AS string) AS _id", "id AS n")
    store.write(docs)
    store.compact()
    found = store.state(store.version())["buckets"]
    assert 16 < len(found) <= 256 and store.read().exceptAll(docs).isEmpty() and store.read().count() == 3000


def test_the_owner_index_shuffles_keys_only(spark, tmp_path):
    """of a change's images only the key columns go into the grouping by rows, and a move is two events."""
    register(spark, frames(spark, start()))
    index = OwnerIndex(spark, MAPPING, str(tmp_path), buckets=2)
    row = lambda i, c: {"ID": str(i), "label": "n" * 1000, "keeper_id": str(c)}
    log = [(1, "INSERT", False, "db", "plot", ["id"], 1, 0, None, row(50, 1)), (2, "UPDATE", False, "db", "plot", ["id"], 1, 0, row(1, 1), row(99, 1)), (3, "UPDATE", False, "db", "plot", ["id"], 1, 0, row(7, 1), row(7, 2))]
    found = {(r["row"], r["step"]): (r["before"], r["after"]) for r in index._events(spark.createDataFrame(log, ch.CHANGE), ["id", "keeper_id"]).collect()}
    key = lambda i, c: {"ID": str(i), "keeper_id": str(c)}
    assert found == {("50", 1): (None, key(50, 1)), ("1", 0): (key(1, 1), None), ("99", 1): (None, key(99, 1)), ("7", 1): (key(7, 1), key(7, 2))}
