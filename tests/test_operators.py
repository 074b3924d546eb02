import random
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docloom import queries as q
from docloom.functions.embed import embed, hashed_model, vectors
from docloom.functions.names import clean_identifier, to_camel, to_snake
from docloom.operators import changes as ch
from docloom.operators import compact, history, incremental, load, ranges, reconcile, replay
from docloom.operators.view import build_view, register
from docloom.plans.lineage import Analyser, Route
from docloom.plans.index_types import check_strict, target_types
from docloom.plans.mapping import Field, Mapping, MappingError
from docloom.sources.changes import file_changes
from docloom.sources.snapshots import Snapshots
from docloom.streaming.maintain import DocumentStream
from docloom.streaming.supervise import Alerts, supervised

COLUMNS = {"plot": ("id", "label", "keeper_id"), "keeper": ("id", "title", "mentor_id"), "tool": ("id", "keeper_id", "size", "make"), "visit": ("id", "plot_id", "grade")}
MAPPING = Mapping(
    "plot",
    "SELECT p.id AS id, p.label AS label, p.keeper_id AS keeperId FROM plot p",
    fields=(
        Field("label", "array", split=" "),
        Field("keeper", "object-sql", sql="SELECT upper(k.title) AS title, m.title AS mentor FROM keeper k LEFT JOIN keeper m ON m.id = k.mentor_id", on_main="WHERE k.id = #{keeper_id}"),
        Field("gear", "array-sql", sql="SELECT t.size AS size, count(*) AS n, max(t.make) AS newest FROM tool t GROUP BY t.keeper_id, t.size", on_main="WHERE t.keeper_id = #{keeper_id}"),
        Field("visits", "array-sql", sql="SELECT v.grade AS grade, v.id AS visit FROM visit v", on_main="WHERE v.plot_id = #{id} ORDER BY v.grade, v.id DESC"),
        Field("best", "object-flat-sql", sql="SELECT b.top FROM visit v LEFT JOIN (SELECT plot_id, min(grade) AS top FROM visit GROUP BY plot_id) b ON b.plot_id = v.plot_id", on_main="WHERE v.plot_id = #{id}"),
        Field("grades", "array-flat-sql", sql="SELECT DISTINCT v.grade FROM visit v", on_main="WHERE v.plot_id = #{id}"),
    ),
)


def frames(spark, state):
    kinds = {"id": "bigint", "keeper_id": "bigint", "mentor_id": "bigint", "plot_id": "bigint", "size": "int"}
    return {t: spark.createDataFrame([tuple(r) for r in state[t].values()], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols)) for t, cols in COLUMNS.items()}


def start():
    return {
        "plot": {i: (i, f"plot {i}", i % 4) for i in range(12)},
        "keeper": {i: (i, f"keeper{i}", (i + 1) % 4) for i in range(4)},
        "tool": {i: (i, i % 3, i % 2, f"make{i}") for i in range(9)},
        "visit": {i: (i, i % 10, f"g{i % 5}") for i in range(25)},
    }


def evolve(state, rng, n):
    """n random changes of a state and their log."""
    state, log = {t: dict(rows) for t, rows in state.items()}, []
    for seq in range(n):
        t = rng.choice(list(COLUMNS))
        rows, cols = state[t], COLUMNS[t]
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        key = max(rows, default=0) + 1 if op == "INSERT" else rng.choice(list(rows)) if rows else None
        if key is None:
            continue
        before = rows.get(key)
        if op == "DELETE":
            after = rows.pop(key) and None
        else:
            after = tuple(key if c == "id" else rng.randrange(5) if c in ("keeper_id", "mentor_id", "size") else rng.randrange(14) if c == "plot_id" else rng.choice("abcde") for c in cols)
            rows[key] = after
        text = lambda r: None if r is None else {c: str(v) for c, v in zip(cols, r, strict=True)}
        log.append((seq, op, False, "db", t, ["id"], seq, 0, text(before if op != "INSERT" else None), text(after)))
    return state, log


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


TALLY = Mapping(
    "tally",
    "SELECT p.id AS id, p.label AS label, k.title AS keeper, t.n AS n FROM plot p JOIN keeper k ON k.id = p.keeper_id LEFT JOIN (SELECT plot_id, count(*) AS n FROM visit GROUP BY plot_id) t ON t.plot_id = p.id",
)


@pytest.mark.parametrize("mapping", [MAPPING, TALLY], ids=["nested", "joined"])
@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_is_the_view(spark, seed, mapping):
    """For any log, maintained documents are those of the final tables."""
    old = start()
    new, log = evolve(old, random.Random(seed), 25)
    register(spark, frames(spark, old))
    snapshot = build_view(spark, mapping).cache()
    snapshot.count()
    register(spark, frames(spark, new))
    changes = spark.createDataFrame(log, ch.CHANGE)
    kept = incremental.maintain(spark, mapping, snapshot, changes)
    assert plain(kept) == plain(build_view(spark, mapping))
    assert plain(incremental.maintain(spark, mapping, kept, changes)) == plain(kept)


def test_view_shapes(spark):
    register(spark, frames(spark, start()))
    docs = {r["_id"]: r for r in build_view(spark, MAPPING).collect()}
    assert docs["2"]["label"] == ["plot", "2"] and docs["2"]["keeper"].asDict() == {"title": "KEEPER2", "mentor": "keeper3"}
    assert [tuple(x) for x in docs["1"]["gear"]] == [(0, 1, "make4"), (1, 2, "make7")] and docs["3"]["gear"] == []
    assert [x["visit"] for x in docs["3"]["visits"]] == [23, 13, 3] and docs["11"]["visits"] == [] and docs["11"]["grades"] == []
    assert docs["3"]["best"] == "g3" and docs["3"]["grades"] == ["g3"] and docs["11"]["best"] is None


def test_stream(spark, tmp_path):
    """The same log through a stream; a batch that runs twice is applied once."""
    old = start()
    new, log = evolve(old, random.Random(5), 15)
    now = {"state": old}
    told = []
    s = DocumentStream(spark, [MAPPING], lambda session: frames(session, now["state"]), str(tmp_path / "docs"), listeners=[lambda df, batch: told.append(df.count())])
    s.load()
    changes = spark.createDataFrame(log, ch.CHANGE)
    changes.coalesce(1).write.json(str(tmp_path / "log"))
    now["state"] = new
    register(spark, frames(spark, new))
    s.start(file_changes(spark, str(tmp_path / "log")), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    store = Snapshots(spark, str(tmp_path / "docs"), "plot")
    assert plain(store.read()) == plain(build_view(spark, MAPPING)) and told and told[0] > 0
    version, stream = store.version(), s.stream_id(str(tmp_path / "cp"))
    s.apply(changes, 0, stream)
    assert store.version() == version
    assert s.rebuild(MAPPING) == version + 1
    s.apply(changes, 0, stream)
    assert store.version() == version + 1, "a rebuilt snapshot holds what the one before held"
    s.apply(changes, 1, stream)
    s.apply(changes, 0, s.stream_id(str(tmp_path / "cp2")))
    assert store.version() == version + 3 and plain(store.read()) == plain(build_view(spark, MAPPING)), "the next batch and a new checkpoint's are applied"


def requests(spark, rows):
    return spark.createDataFrame([("i", d, n, k, u, f) for n, (d, k, u, f) in enumerate(rows)], compact.REQUEST)


def test_trim_keeps_the_last(spark):
    rows = requests(spark, [(str(v), "update", False, {"a": "x"}) for v in (3, 1, 2, 2, 2, 2, 2, 1, 3)])
    assert [r["id"] for r in compact.trim(rows).orderBy("seq").collect()] == ["2", "1", "3"]


def test_trim_after_delete(spark):
    rows = requests(spark, [("1", "update", True, {"a": "1"}), ("1", "delete", False, None), ("1", "update", True, {"b": "2"}), ("1", "update", False, {"c": "3"})])
    assert [r["seq"] for r in compact.trim(rows).orderBy("seq").collect()] == [1, 2, 3]
    merged = compact.merge_adjacent(rows).orderBy("seq").collect()
    assert [(r["kind"], r["fields"] or {}) for r in merged][1:] == [("delete", {}), ("update", {"b": "2"}), ("update", {"c": "3"})]


def naive(docs, rows):
    docs = {k: dict(v) for k, v in docs.items()}
    for d, kind, upsert, fields in rows:
        if kind == "delete":
            docs.pop(d, None)
        elif d in docs or upsert:
            docs.setdefault(d, {}).update(fields)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_is_the_sequence(spark, seed):
    rng = random.Random(seed)
    rows = [(str(rng.randrange(6)), rng.choice(["update", "update", "update", "delete"]), rng.random() < 0.4, {rng.choice("abc"): str(n)}) for n in range(60)]
    docs = {str(i): {"z": "0"} for i in range(3)}
    frame = spark.createDataFrame([("i", k, v) for k, v in docs.items()], "index string, id string, fields map<string,string>")
    out = compact.apply_requests(frame, requests(spark, rows))
    assert {r["id"]: r["fields"] for r in out.collect()} == naive(docs, rows)


def test_merge_keeps_outcome(spark):
    rng = random.Random(9)
    rows = [(str(rng.randrange(3)), rng.choice(["update", "update", "delete"]), True, {rng.choice("abc"): str(n)}) for n in range(40)]
    merged = compact.merge_adjacent(requests(spark, rows)).orderBy("seq").collect()
    assert naive({}, [(r["id"], r["kind"], r["upsert"], r["fields"]) for r in merged]) == naive({}, rows)
    for size in (1, 3, 7):
        assert compact.merge_adjacent(requests(spark, rows), block_rows=size).orderBy("seq").collect() == merged, "blocks change nothing"


@pytest.mark.parametrize("leap", [1, 10**9])
def test_positions_are_numbered(spark, leap):
    """Positions of several parts, and numbers that leap, in blocks that hold about as many requests each."""
    kind = compact.REQUEST.replace("seq bigint", "seq struct<es: bigint, partition: int, offset: bigint>")
    rows = [("i", str(n % 7), (0 if n == 0 else leap + n // 3, n % 2, n), "update", True, {"a": str(n)}) for n in range(1000)]
    requests_ = spark.createDataFrame(rows, kind)
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: r[2]))}
    got = compact.numbered(requests_, block_rows=100)
    assert {int(r["fields"]["a"]): r["seq"] for r in got.collect()} == {k[2]: n for k, n in want.items()}
    blocks = [r["count"] for r in compact._blocked(requests_, 100).groupBy("block").count().collect()]
    assert sum(blocks) == 1000 and max(blocks) < 300
    assert compact.merge_adjacent(requests_, block_rows=100).count() == 7


class Receiver:
    """Takes at most so many bytes at once, and fails as a whole if a request is poisoned."""

    def __init__(self, most, poison, calls):
        self.most, self.poison, self.calls = most, poison, calls

    def __call__(self, rows):
        self.calls.add(1)
        if sum(map(compact._text_bytes, rows)) > self.most:
            raise compact.BulkTooLarge
        if any(r["seq"] in self.poison for r in rows):
            raise OSError("mapper_parsing_exception")
        return [200] * len(rows)


def test_bulks_are_halved(spark):
    rows = requests(spark, [(str(n), "update", True, {"a": "x" * (500 if n == 17 else 20)}) for n in range(40)])
    calls = spark.sparkContext.accumulator(0)
    bulks = compact.bulk_groups(rows, 1 << 20, 1000)
    got = {r["seq"]: (r["status"], r["action"]) for r in compact.send_bulks(bulks, Receiver(200, {5, 6, 30}, calls), attempts=2, pause_s=0).collect()}
    assert {s for s, x in got.items() if x == (500, "fail")} == {5, 6, 30} and got[17] == (413, "fail") and sum(x == (200, "done") for x in got.values()) == 36
    with pytest.raises(ValueError, match="numbered"):
        compact.send_bulks(bulks.withColumn("seq", F.struct("seq")), lambda rows: [])


def test_repeated_stamps_go(spark):
    rows = requests(spark, [("1", "update", False, {"a": "1"}), ("1", "update", False, {"at": "t"}), ("2", "update", False, {"at": "t"})])
    assert [r["seq"] for r in compact.drop_repeated_stamps(rows, "at").orderBy("seq").collect()] == [0, 2]


def test_changes_images(spark):
    df = spark.createDataFrame(
        [(1, "UPDATE", {"a": "1", "b": "2"}, {"a": "0", "b": "2"}), (2, "DELETE", {"a": "1"}, None), (3, None, {"a": "1", "c": None}, None), (4, "TRANSACTIONEND", {}, None)],
        "seq bigint, type string, data map<string,string>, old map<string,string>",
    ).selectExpr("*", "false is_ddl", "'d' db", "'t' table", "array('a') pk", "0L es", "0L ts")
    rows = {r["seq"]: r for r in ch.from_log(df).collect()}
    assert rows[1]["before"] == {"a": "0", "b": "2"} and rows[1]["after"] == {"a": "1", "b": "2"} and set(rows) == {1, 2, 3}
    assert rows[2]["before"] == {"a": "1"} and rows[2]["after"] is None and rows[3]["op"] == "INSERT" and rows[3]["before"] is None


def test_log_values_cast(spark):
    df = spark.createDataFrame([("1", "12345678901", "2024-01-02 03:04:05", "x")], "a string, b string, c string, d string")
    assert [t for _, t in ch.cast_log_values(df, {"a": "bit(1)", "b": "bigint(20)", "c": "datetime", "d": "varchar(9)"}).dtypes] == ["tinyint", "bigint", "timestamp", "string"]


def test_direct_updates_write_nulls_only_if_asked(spark):
    log = spark.createDataFrame([(1, "INSERT", False, "d", "plot", ["id"], 0, 0, None, {"id": "1", "label": None, "keeper_id": "2"})], ch.CHANGE)
    query = Analyser(spark).query(MAPPING.sql)
    assert incremental.direct_updates(log, query, "id").first()["doc"] == {"id": "1", "keeperId": "2"}
    assert incremental.direct_updates(log, query, "id", write_null=True).first()["doc"] == {"id": "1", "label": None, "keeperId": "2"}


def test_nested_order_matters_if_declared(spark):
    kind = "_id string, xs array<struct<i:int,s:string>>"
    a = spark.createDataFrame([("1", [(1, "a"), (2, "b")]), ("2", []), ("3", [(1, "a")])], kind)
    b = spark.createDataFrame([("1", [(2, "b"), (1, "a")]), ("2", None), ("3", [])], kind)
    assert [tuple(r) for r in reconcile.nested_changes(a, b, "xs").collect()] == [("3", ["xs"])]
    assert sorted(tuple(r) for r in reconcile.nested_changes(a, b, "xs", ordered=True).collect()) == [("1", ["xs.i", "xs.s"]), ("3", ["xs"])]


def test_digests_find_what_differs(spark):
    view = spark.range(3000).select(F.col("id").cast("string").alias("_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.array(F.struct("id")).alias("xs"))
    assert reconcile.differing_ranges(view, view)[0] is None and reconcile.check_ranges(view, view).count() == 0
    docs = view.filter("_id <> '5'").withColumn("v", F.when(F.col("_id") == "77", "x").otherwise(F.col("v"))).unionByName(view.limit(1).withColumn("_id", F.lit("z")))
    docs = docs.withColumn("xs", F.when(F.col("_id") == "88", F.array().cast("array<struct<id:bigint>>")).otherwise(F.col("xs")))
    ranges_, bits = reconcile.differing_ranges(view, docs)
    assert bits == 16 and 1 <= ranges_.count() <= 4
    assert plain(reconcile.check_ranges(view, docs, {"xs": False})) == plain(reconcile.check_all(view, docs, {"xs": False})) and reconcile.check_ranges(view, docs).count() == 3


def test_replay_moves_keys(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    log = spark.createDataFrame(
        [
            (1, "UPDATE", False, "d", "t", ["id"], 0, 0, {"id": "1", "v": "a"}, {"id": "9", "v": "a"}), (2, "DELETE", False, "d", "t", ["id"], 0, 0, {"id": "2", "v": "b"}, None),
            (3, "INSERT", False, "d", "t", ["id"], 0, 0, None, {"id": "1", "v": "it's", "#x": "1"}),
        ],
        ch.CHANGE,
    )
    assert sorted(map(tuple, replay.replayed(table, log, ["id"]).collect())) == [(1, "it's"), (3, "c"), (9, "a")]
    texts = [r["sql"] for r in replay.statements(log).orderBy("seq").collect()]
    assert texts == ["UPDATE `t` SET `id`='9' WHERE `id`='1'", "DELETE FROM `t` WHERE `id`='2'", "INSERT INTO `t` (`id`,`v`) VALUES ('1','it''s')"]


def test_deep_diff_paths(spark):
    kind = "id int, s struct<a:int,b:string>, xs array<string>"
    old = spark.createDataFrame([(1, (1, ""), ["p", "q"])], kind)
    new = spark.createDataFrame([(1, (2, None), ["p"])], kind)
    assert sorted(tuple(r)[1:] for r in history.deep_diff(old, new, "id").collect()) == [("s.a", "1", "2"), ("xs[1]", "q", None)]


@pytest.mark.parametrize(
    "args, expected",
    [((1, 10, 3), [(1, 4), (5, 7), (8, 10)]), ((5, 5, 4), [(5, 6)]), ((9, 1, 2), []), ((1, 3, 1), [(1, 3)]), ((1, 3, 3), [(1, 2), (2, 3), (3, 4)])],
)
def test_split_range(spark, args, expected):
    assert [(r["low"], r["high"]) for r in ranges.split_range(spark, *args).orderBy("part").collect()] == expected


def test_snapshots_are_versioned(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path), "x")
    assert s.version() is None and s.read() is None
    for n in range(3):
        assert s.write(spark.range(n + 1).withColumnRenamed("id", "_id")) == n
    assert s.write(spark.range(50), version=1) == 2 and s.read().count() == 3 and s.read(1).count() == 2
    s.prune(1)
    assert s.read().count() == 3


def test_entry_has_queries(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_orderless_fields(spark):
    docs = spark.createDataFrame([("1", 5), ("2", None)], "_id string, n int")
    assert [r["_id"] for r in reconcile.delete_range(docs, "n", 1, 9).collect()] == ["2"]
    assert ranges.search_after(docs, "1", 5, []).collect()[0]["_id"] == "2"
    assert compact.update_by_ids(docs.select(F.lit("i").alias("index"), F.col("_id").alias("id")), "f", F.lit(1)).count() == 2


def test_supervised_stream_restarts():
    class Query:
        def __init__(self, error):
            self.error = error

        def awaitTermination(self):  # noqa: N802
            if self.error:
                raise self.error

    sent, clock = [], iter(range(0, 5000, 400))
    alerts = Alerts(sent.append, every_s=600, clock=lambda: next(clock))
    runs = iter([Query(StreamingQueryException("lost")), Query(StreamingQueryException("lost")), Query(StreamingQueryException("lost")), Query(None)])
    assert supervised(lambda: next(runs), alerts, pause_s=0) == 3
    assert sent == ["lost", "lost"], "the second is too soon"
    rebuilt, more = [], iter([Query(StreamingQueryException("Cannot fetch offset: some data may have been lost (failOnDataLoss)")), Query(None)])
    assert supervised(lambda: next(more), alerts, pause_s=0, on_loss=lambda: rebuilt.append(1)) == 1 and rebuilt == [1]


def test_index_types(spark):
    text = '{"a": {"mappings": {"properties": {"x": {"type": "long"}}}}, "plot_1": {"mappings": {"properties": {"id": {"type": "long"}, "at": {"type": "date", "format": "s || ms"}, "visits": {"type": "nested", "properties": {"id": {"type": "integer"}}}}}}}'
    target = target_types(text, "plot")
    assert target == {"id": "long", "at": ("date", "s || ms"), "visits": {"id": "integer"}} and target_types(text) == {"x": "long"}
    docs = spark.createDataFrame([("1", 1, [(1, "c")])], "_id string, id bigint, visits array<struct<id:int,grade:string>>")
    with pytest.raises(MappingError, match="visits.grade"):
        check_strict(docs, target)
    assert check_strict(docs.drop("visits"), target).count() == 1


def test_names():
    assert clean_identifier("`a`.\"b\"") == "a.b" and to_snake("dataSourceKey") == "data_source_key" and to_camel("data_source_key") == "dataSourceKey"


def test_messages_of_several_partitions(spark):
    """Changes at one offset of two partitions or topics stay apart, deletes too, and follow commit time."""
    import json

    from docloom.operators.changes import notifications
    from docloom.operators.replay import final_rows
    from docloom.sources.changes import from_messages

    def message(es, kind, rows):
        return json.dumps({"database": "d", "table": "t", "type": kind, "isDdl": False, "pkNames": ["k"], "es": es, "ts": es, "data": [{"k": k, "v": v} for k, v in rows]})

    rows = [("a", 0, 7, message(20, "INSERT", [("1", "new"), ("2", "x")])), ("a", 1, 7, message(10, "INSERT", [("1", "old"), ("3", "y")])), ("b", 0, 7, message(30, "DELETE", [("3", "y")]))]
    out = from_messages(spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string"))
    assert out.count() == out.select("seq").distinct().count() == 5
    deps = out.selectExpr("*", "'i' as index", "'v' as view", "'main' as role")
    assert notifications(deps).count() == 5
    assert {r.key: r.row and r.row["v"] for r in final_rows(out).collect()} == {"1": "new", "2": "x", "3": None}


def test_write_jdbc(spark):
    """Final rows reach a relational table, twice with one outcome; keys that hold the parts' mark too."""
    url = "jdbc:derby:memory:docloom;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    made = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    made.executeUpdate("CREATE TABLE t (a VARCHAR(20), b INT, v VARCHAR(20))")
    made.executeUpdate("INSERT INTO t VALUES ('x|', 1, 'old'), ('y', 2, 'old'), ('|_', 3, 'old')")

    def row(a, b, v):
        return {"a": a, "b": str(b), "v": v}

    def there():
        return sorted(tuple(r) for r in spark.read.format("jdbc").options(url=url, dbtable="t", **options).load().collect())

    log = spark.createDataFrame(
        [
            (1, "UPDATE", False, "d", "t", ["a", "b"], 0, 0, row("x|", 1, "old"), row("x|", 1, "it's")), (2, "DELETE", False, "d", "t", ["a", "b"], 0, 0, row("|_", 3, "old"), None),
            (3, "INSERT", False, "d", "t", ["a", "b"], 0, 0, None, row("z", 4, "w")),
        ],
        ch.CHANGE,
    )
    target = spark.read.format("jdbc").options(url=url, dbtable="t", **options).load()
    for _ in range(2):
        replay.write_jdbc(spark, replay.final_rows(log), target, url, "t", ["a", "b"], **options)
        assert there() == [("x|", 1, "it's"), ("y", 2, "old"), ("z", 4, "w")]
    names = spark._jvm.java.sql.DriverManager.getConnection(url).getMetaData().getTables(None, None, "%STAGE%", None)
    assert not names.next(), "staging tables go"
    stale = spark.createDataFrame([(0, "UPDATE", False, "d", "t", ["a", "b"], 0, 0, row("z", 4, "w"), row("z", 4, "stale")), (2, "INSERT", False, "d", "t", ["a", "b"], 0, 0, None, row("|_", 3, "stale")), (9, "UPDATE", False, "d", "t", ["a", "b"], 0, 0, row("y", 2, "old"), row("y", 2, "new"))], ch.CHANGE)
    stale = stale.withColumn("seq", F.when(F.col("seq") == 2, 1).otherwise(F.col("seq")).cast("bigint"))
    replay.write_jdbc(spark, replay.final_rows(stale), target, url, "t", ["a", "b"], **options)
    assert there() == [("x|", 1, "it's"), ("y", 2, "new"), ("z", 4, "w")], "a later batch's older changes are passed over, also of rows that are gone"

    def writer(n):
        moves = [(s, "UPDATE", False, "d", "t", ["a", "b"], 0, 0, row("z", 4, "w"), row("z", 4, f"w{s}")) for s in range(20 + n, 40, 2)]
        replay.write_jdbc(spark, replay.final_rows(spark.createDataFrame(moves, ch.CHANGE)), target, url, "t", ["a", "b"], **options)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(writer, [0, 1]))
    assert ("z", 4, "w39") in there(), "of two writers at once, the newer change stands"
    assert replay.replay_tables(spark, log, url, {"t": ["a", "b"], "nowhere": ["k"]}, skip_missing=True, **options) == {"t": "written", "nowhere": "skipped"}
    with pytest.raises(LookupError, match="nowhere"):
        replay.replay_tables(spark, log, url, {"nowhere": ["k"]}, **options)
    skipped = spark.createDataFrame([("t", "y|_2", row("y", 2, "no")), ("t", "q|_9", row("q", 9, "yes"))], "table string, key string, row map<string,string>")
    replay.write_jdbc(spark, skipped, target, url, "t", ["a", "b"], insert_only=True, **options)
    assert ("y", 2, "new") in there() and ("q", 9, "yes") in there()


def test_ddl_text(spark):
    cases = [
        ("ALTER TABLE shop.t ADD x", "ALTER TABLE t ADD x"), ("ALTER TABLE `shop` . `t` ADD myshop.x", "ALTER TABLE `t` ADD myshop.x"),
        ("COMMENT 'shop.t it''s shop.x' ON \"shop.y\" shop.z", "COMMENT 'shop.t it''s shop.x' ON \"shop.y\" z"), ("x.shop.t", "x.shop.t"),
    ]
    df = spark.createDataFrame([(n, a, "shop") for n, (a, _) in enumerate(cases)], "n int, sql string, db string")
    assert [r.t for r in df.orderBy("n").select(replay.ddl_text(F.col("sql"), F.col("db")).alias("t")).collect()] == [b for _, b in cases]


def test_columns_without_alias(spark):
    register(spark, frames(spark, start()))
    q = Analyser(spark).query("SELECT p.id AS id, grade AS grade FROM plot p LEFT JOIN visit v ON v.plot_id = p.id")
    assert Analyser(spark).owner(q, "grade") == "v"
    with pytest.raises(MappingError):
        Analyser(spark).owner(q, "id")
    with pytest.raises(MappingError):
        Analyser(spark).owner(q, "nowhere")


class Failing:
    """A model that fails at its first request."""

    def __init__(self, calls):
        self.calls, self.failed = calls, False

    def __call__(self, texts):
        self.calls.add(len(texts))
        if not self.failed:
            self.failed = True
            raise OSError("limit_requests")
        return [[1.0, 2.0] for _ in texts]


def test_vectors_are_kept_and_tried_again(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    known = vectors(df.filter("id = 1").selectExpr("sha2(text, 256) as digest", "text"), hashed_model(2))
    calls = spark.sparkContext.accumulator(0)
    got = {r["id"]: r["v"] for r in embed(df, "text", "v", Failing(calls), known=known, per_minute=6000).collect()}
    assert got[2] == [1.0, 2.0] and len(got[1]) == 2 and got[1] != got[2] and calls.value == 2, "one text was sent, twice"


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_date_windows_keep_their_width_over_summer_time(spark, kind):
    """Times without a zone are counted as written in any session's zone; others by their instants."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York" if kind == "timestamp_ntz" else "UTC")
    try:
        times = ["2024-03-09 23:59:59.999", "2024-03-10 00:00:00", "2024-03-10 01:59:59.9999", "2024-03-10 02:30:00", "2024-03-10 03:30:00", "2024-03-11 00:10:00"]
        df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast(kind).alias("t"))
        got = ranges.date_windows(df, "t", "2024-03-10 00:00:00").selectExpr("window_no", "cast(window_start as string) as at").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, got)) == [(0, "2024-03-10 00:00:00"), (11, "2024-03-10 01:50:00"), (15, "2024-03-10 02:30:00"), (21, "2024-03-10 03:30:00"), (145, "2024-03-11 00:10:00")]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_date_windows_by_the_nearest_millisecond(spark, kind):
    """The last half millisecond counts to the next window, but not into the first one."""
    times = ["2024-01-01 05:59:59.9998", "2024-01-01 06:00:00", "2024-01-01 06:09:59.999499", "2024-01-01 06:09:59.9995", "2024-01-01 06:59:59.999999", "2024-01-01 07:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast(kind).alias("t"))
    got = ranges.date_windows(df, "t", "2024-01-01 06:00:00", nearest=True).selectExpr("window_no", "cast(window_start as string) as at").collect()
    assert sorted(map(tuple, got)) == [(0, "2024-01-01 06:00:00")] * 2 + [(1, "2024-01-01 06:10:00")] + [(6, "2024-01-01 07:00:00")] * 2


def test_date_windows_are_those_of_the_sql(spark, tmp_path):
    """Times just before a window's end, and sums that lie near half a unit of the fourth decimal."""
    sums = [[29.27, 0.00005], [1162.37005], [0.1, 0.2, 70000.00005], [122.79, 2.11, 0.00015], [1.00015], [26.11, 56.25, 50.91, 67.07, 7.94, 1.00035]] * 3
    rows = [(v * (1 + 0.001 * i), f"2024-01-01 {6 + i // 6:02d}:{i % 6}9:59.{999000 + 111 * j:06d}") for i, vs in enumerate(sums) for j, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("late", F.col("ts") + F.expr("interval 600 microseconds"))
    df.select("value", "ts").unionByName(df.select("value", F.col("late").alias("ts"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = q.QUERIES["range_date_windows"](spark, str(tmp_path)).collect()
    sql = q.ORACLE_SQL["range_date_windows"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duckdb.execute(sql).fetchall())


def test_small_blocks_are_cut_inside_few_ranges(spark):
    """Blocks of few requests do not make as many ranges, whose samples come to the driver; places keep to their order and stay together."""
    rows = spark.range(2000).selectExpr("'i' AS index", "cast(id % 9 AS string) AS id", "id div 2 AS seq", "'update' AS kind", "true AS upsert", "map('f', 'v') AS fields")
    got = compact._blocked(rows, 10).groupBy("block").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("block").collect()
    assert 1 < len({r["block"] >> 32 for r in got}) <= compact.MOST_RANGES
    assert sum(r["n"] for r in got) == 2000 and max(r["n"] for r in got) <= 11 and all(a["high"] < b["low"] for a, b in zip(got, got[1:], strict=False))


def test_list_diff_has_no_pass_before_the_shuffle(spark):
    """Keys that are nearly all different are not gathered in each task first; repeated and null keys are as before."""
    old, new = (spark.createDataFrame([(k, "x") for k in keys], "k bigint, v string") for keys in ([1, 2, 2, 3, None], [2, 4, 4, None, None]))
    out = history.list_diff(old, new, "k")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(4, "insert"), (1, "delete"), (3, "delete"), (None, "insert"), (None, "delete")], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_check_all_reads_each_side_once(spark, tmp_path):
    """All fields of all documents are compared by one join of both sides."""
    row = "_id string, a int, n array<struct<x: int>>"
    for name, rows in {"view": [("1", 1, [(1,)]), ("2", 2, []), ("3", 3, [(3,)])], "docs": [("1", 1, [(2,)]), ("2", 5, None), ("4", 4, [])]}.items():
        spark.createDataFrame(rows, row).write.parquet(str(tmp_path / name))
    view, docs = (spark.read.parquet(str(tmp_path / n)) for n in ("view", "docs"))
    work = reconcile.check_all(view, docs, {"n": False})
    assert sorted(map(tuple, work.collect())) == [("1", "update", ["n"]), ("2", "update", ["a"]), ("3", "insert", []), ("4", "delete", [])]
    assert work._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


ROW = "_id string, a int, n array<struct<x: int>>"
VIEW_ROWS = [("1", 1, [(1,)]), ("2", 2, []), ("3", 3, [(3,)]), ("5", 5, None), ("6", None, [(1,), (2,)]), (None, 9, [])]
DOC_ROWS = [("1", 1, [(2,)]), ("2", 7, None), ("4", 4, []), ("5", 5, []), ("6", None, [(2,), (1,)]), (None, 8, [])]


@pytest.mark.parametrize("orphans", [True, False])
@pytest.mark.parametrize("change", [{}, {"a": "string"}, {"extra": "int"}, {"a": "string", "extra": "int"}], ids=["same", "types", "more", "both"])
def test_mended_is_repaired_after_check_all(spark, change, orphans):
    """one outer join gives what the list of work and two joins give, also for null ids and fields of one side."""
    view, docs = spark.createDataFrame(VIEW_ROWS, ROW), spark.createDataFrame(DOC_ROWS, ROW)
    for name, kind in change.items():
        docs = docs.withColumn(name, F.col("a").cast(kind))
    view = view.withColumn("own", F.col("a") + 1)
    work = reconcile.check_all(view, docs, {"n": False})
    want = reconcile.repaired(view, docs, work if orphans else work.filter("action <> 'delete'"))
    got = reconcile.mended(view, docs, {"n": False}, orphans=orphans)
    assert got.columns == want.columns and got.dtypes == want.dtypes and plain(got) == plain(want)


def test_mended_holds_each_document_once(spark):
    view, docs = spark.createDataFrame(VIEW_ROWS[:2], ROW), spark.createDataFrame([*VIEW_ROWS[:2], VIEW_ROWS[0], ("2", 7, [])], ROW)
    assert plain(reconcile.mended(view, docs, {"n": False})) == plain(view.withColumn("n", F.coalesce("n", F.array())))


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(9,0)"])
def test_check_and_repair_shuffles_each_side_once(spark, kind):
    """documents whose key is a whole number or a text lie by their ids when they meet; the result does not read them again."""
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = start()
        old, new = frames(spark, state), frames(spark, evolve(state, random.Random(3), 30)[0])
        for t in (old, new):
            t["plot"], t["visit"] = t["plot"].withColumn("id", F.col("id").cast(kind)), t["visit"].withColumn("plot_id", F.col("plot_id").cast("int" if kind == "bigint" else kind))
        register(spark, old)
        docs = build_view(spark, MAPPING)
        register(spark, new)
        view = build_view(spark, MAPPING)
        assert view.columns == ["id", "label", "keeperId", "_id", "keeper", "gear", "visits", "best", "grades"]
        got, work = load.check_and_repair(spark, MAPPING, docs)
        assert exchanges(got) == exchanges(view) + exchanges(docs) + (2 if kind.startswith("decimal") else 0)
        assert plain(got) == plain(view) and work.count() > 0 and load.check_and_repair(spark, MAPPING, got)[1].count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_a_receiver_has_one_file_for_all_its_bulks(spark, tmp_path):
    """a file for each bulk is a million files for a large table."""
    from docloom.more_queries import FolderReceiver

    receiver = FolderReceiver(str(tmp_path), 1000)
    for n in range(1, 6):
        assert receiver([{"seq": 10 * n, "kind": "update", "fields": None}]) == [200]
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(r["seq"] for r in spark.read.schema("seq bigint, kind string").json(str(tmp_path)).collect()) == [10, 20, 30, 40, 50]


def test_requests_are_measured_once_and_bulks_stay_apart(spark, monkeypatch):
    """a bulk that is halved again and again measured each request at every step."""
    asked, rows = [], [{"id": str(n), "seq": n, "fields": {"a": "x" * 20}} for n in range(64)]
    size = compact._text_bytes
    monkeypatch.setattr(compact, "_text_bytes", lambda r: asked.append(r["seq"]) or size(r))

    def send(part):
        if len(part) > 4:
            raise compact.BulkTooLarge
        return [200] * len(part)

    assert compact._Delivery(send, 1, 0)(rows) == [200] * 64 and len(asked) == 64
    bulks = compact.bulk_groups(requests(spark, [("one", "update", True, {"a": str(n)}) for n in range(100)]), 1 << 20, 3)
    sent = spark.sparkContext.accumulator(0)
    got = compact.send_bulks(bulks, Receiver(1 << 20, set(), sent), attempts=1, pause_s=0).collect()
    assert sorted(r["seq"] for r in got) == list(range(100)) and sent.value == bulks.select("lane", "block", "bulk").distinct().count()


def test_lists_are_sorted_without_an_expression_for_each_comparison(spark):
    """the order of a list without a declared one is that of its rows, by their own comparison."""
    register(spark, frames(spark, start() | {"visit": {i: (i, i % 3, None if i % 4 == 0 else f"g{i % 5}") for i in range(25)}}))
    m = Mapping("plot", MAPPING.sql, fields=(Field("visits", "array-sql", sql="SELECT v.grade AS grade, v.id AS visit FROM visit v", on_main="WHERE v.plot_id = #{id}"), MAPPING.fields[5]))
    out = build_view(spark, m)
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.filter("id < 3").collect():
        own = [(None if i % 4 == 0 else f"g{i % 5}", i) for i in range(25) if i % 3 == r["id"]]
        assert [tuple(v) for v in r["visits"]] == sorted(own, key=lambda v: (v[0] is not None, v[0] or "", v[1])) and r["grades"] == sorted({g for g, _ in own}, key=lambda g: (g is not None, g or ""))


def test_what_a_change_concerns_is_told_without_lists(spark):
    """no map or list of changed columns is made for each change and route, and the answer is that of the list."""
    images = [None, {"id": "1", "A": "x"}, {"id": "1", "A": "y"}, {"id": "1", "A": None}, {"id": "1"}, {"id": "2", "A": "x"}, {}]
    log = [(n, "UPDATE", False, "db", "t", ["id"], 1, 0, b, a) for n, (b, a) in enumerate((b, a) for b in images for a in images)]
    changes = spark.createDataFrame(log, ch.CHANGE)
    lower = F.transform(ch.changed_columns(F.col("before"), F.col("after")), F.lower)
    for columns in (("a",), ("a", "id"), ("other",), ("*",)):
        route = Route("t", "", "t", "t", "main", columns)
        found = ch.concerning(changes, route)
        want = changes if columns == ("*",) else changes.filter(F.arrays_overlap(lower, F.array(*[F.lit(c) for c in columns])))
        assert {r["seq"] for r in found.collect()} == {r["seq"] for r in want.collect()} == {r["seq"] for r in ch.dependents(changes, [route]).collect()}
        assert "map_filter" not in found._jdf.queryExecution().optimizedPlan().toString()
