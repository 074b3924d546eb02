"""Registered queries of what is stored between batches, of streams, bulks and replays, and DuckDB SQL that says the same."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import queries as q
from .functions import equality
from .functions.embed import embed, limits
from .operators import changes as ch
from .operators import compact, load, reconcile, replay
from .operators.view import build_view, register, typed
from .plans.index_types import target_types
from .plans.mapping import Field, Mapping, load_mappings
from .queries import CUSTOMER, CUSTOMERS, FLAGS, FULL, LINES, ORDERS_NOW_SQL, ORDERS_SQL, orders_mapping, query, tables, view
from .sources.capture import capture_log, retained
from .sources.changes import file_changes
from .sources.indices import Indices
from .sources.snapshots import Snapshots, scratch
from .sources.vectors import KeptVectors
from .streaming.maintain import DocumentStream
from .streaming.owners import OwnerIndex
from .streaming.supervise import Alerts, lost_since, supervised

#: Buckets that split, and deltas that are compacted, at the size of the given tables.
SMALL = {"buckets": 4, "bucket_bytes": 200_000, "most_deltas": 2}

# Stored documents


@query(ORDERS_NOW_SQL)
def snap_merge_on_read(spark, d):
    """The earlier orders' documents, brought up to date by deltas of whole documents, deletions and parts, with a compaction and a split between them."""
    t, m = tables(spark, d, *FULL), orders_mapping(CUSTOMER, LINES)
    store = Snapshots(spark, scratch(spark), m.index, **SMALL)
    old, now = (q._before(spark, t | {"orders": o}, m) for o in (q.earlier_orders(t["orders"]), t["orders"]))
    store.write(old)
    kind = F.col("_id").cast("bigint") % 10
    none = now.select("_id").limit(0)
    store.update(now.filter(kind == 0), old.select("_id").filter(F.col("_id").cast("bigint") >= q.GONE))
    store.update(now.limit(0), none, parts=[(["price"], now.filter(kind.isin(1, 2)).select("_id", "price")), (["customerId"], now.filter(kind == 3).select("_id", "customerId"))])
    store.compact()
    store.update(now.limit(0), none, parts=[(["customer"], now.filter(kind == 3).select("_id", "customer"))])
    store.prune(1)
    return q._flat(store.read())


#: An index's own mapping of the orders' documents.
ORDER_TYPES = json.dumps({"orders_1": {"mappings": {"properties": {
    "id": {"type": "keyword"}, "customerId": {"type": "byte"}, "status": {"type": "text"}, "price": {"type": "integer"}, "orderDate": {"type": "date", "format": "yyyy-MM-dd"}, "priority": {"type": "keyword"},
}}}})


@query(q.ORACLE_SQL["doc_typed"])
def snap_reindex(spark, d):
    """The earlier orders behind an alias, copied into an index of other types while they are brought up to date in two writes, of
    which one falls into the copying and one into the catching up; then the alias moves."""
    t, m = tables(spark, d, "orders"), orders_mapping()
    old, now = (q._before(spark, {"orders": o}, m) for o in (q.earlier_orders(t["orders"]), t["orders"]))
    indices = Indices(spark, scratch(spark), **SMALL)
    indices.create("orders_1")
    indices.write("orders_1", old)
    indices.point({"orders": "orders_1"})
    indices.create("orders_2", ORDER_TYPES)
    store, kind = indices.open("orders"), F.col("_id").cast("bigint") % 10
    writes = [
        lambda: store.update(now.filter(kind == 0), old.select("_id").filter(F.col("_id").cast("bigint") >= q.GONE)),
        lambda: store.update(now.limit(0), now.select("_id").limit(0), parts=[(["price"], now.filter(kind.isin(1, 2)).select("_id", "price")), (["customerId"], now.filter(kind == 3).select("_id", "customerId"))]),
    ]

    def meanwhile(docs: DataFrame) -> DataFrame:
        if writes:
            writes.pop(0)()
        return docs

    indices.reindex("orders", "orders_2", meanwhile)
    indices.drop("orders_1")
    return indices.read("orders")


def _line_changes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines before, and the changes since: of parts with key % 9 = 1 moved from the next order, of key % 9 = 0 new."""
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    k = F.col("l_partkey") % 9
    old = lines.filter(k != 0).withColumn("l_orderkey", F.when(k == 1, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")))
    after = q.image(columns)
    before = F.map_concat(F.map_filter(after, lambda c, _: c != "l_orderkey"), F.create_map(F.lit("l_orderkey"), (F.col("l_orderkey") + 1).cast("string")))
    log = lines.filter(k < 2).select(
        F.col("l_orderkey").alias("seq"), F.when(k == 0, "INSERT").otherwise("UPDATE").alias("op"), F.lit(False).alias("is_ddl"), F.lit("shop").alias("db"), F.lit("lineitem").alias("table"),
        F.array(F.lit("l_orderkey"), F.lit("l_linenumber")).alias("pk"), F.lit(0).cast("bigint").alias("es"), F.lit(0).cast("bigint").alias("ts"), F.when(k == 1, before).alias("before"), after.alias("after"),
    )
    return old, log


@query(ORDERS_NOW_SQL)
def cdc_stream_parts(spark, d):
    """Batches of lines, of customers and of orders, each of which writes the fields that it concerns; owners come from their index."""
    root, m, t = scratch(spark), orders_mapping(CUSTOMER, LINES), tables(spark, d, *FULL)
    old_lines, line_log = _line_changes(t["lineitem"])
    states = [{"orders": q.earlier_orders(t["orders"]), "customer": q.earlier_customers(t["customer"])}, {"orders": q.earlier_orders(t["orders"])}, {}]
    now = {"tables": t | states[0] | {"lineitem": old_lines}}
    stream = DocumentStream(spark, [m], lambda session: now["tables"], f"{root}/docs", snapshots=SMALL)
    stream.load()
    for batch, log in enumerate([line_log, q.customer_changes(t["customer"]), q.order_changes(t["orders"])]):
        now["tables"] = t | states[batch]
        stream.apply(log, batch, "log")
    return q._flat(Snapshots(spark, f"{root}/docs", m.index).read())


@query("select distinct o_orderkey::varchar as _id from orders join customer on c_custkey = o_custkey where c_custkey % 7 = 0")
def cdc_owner_index(spark, d):
    """The documents of changed customers, from the index alone: it was loaded from the earlier orders and followed their changes."""
    t, m = tables(spark, d, "orders", "customer", "nation"), orders_mapping(CUSTOMER)
    register(spark, t | {"orders": q.earlier_orders(t["orders"])})
    index = OwnerIndex(spark, m, scratch(spark), **SMALL)
    index.load()
    changes = q.order_changes(t["orders"])
    index.apply(changes.filter("seq % 2 = 0"), "log", 0)
    index.apply(changes.filter("seq % 2 = 1"), "log", 1)
    return index.owners(index.fields[0], t["customer"].filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("_k0")))


@query("""select 'orders' as index, o_orderkey::varchar as _id, c_name as name from orders left join customer on c_custkey = o_custkey
union all select 'customers', c_custkey::varchar, n_name from customer left join nation on n_nationkey = c_nationkey""")
def cdc_stream_two_mappings(spark, d):
    """One stream that keeps the documents of two mappings, which read the same changed table."""
    root, mappings, t = scratch(spark), [orders_mapping(CUSTOMER), CUSTOMERS], tables(spark, d, "orders", "customer", "nation", "region")
    register(spark, t | {"customer": q.earlier_customers(t["customer"])})
    for m in mappings:
        Snapshots(spark, f"{root}/docs", m.index).write(build_view(spark, m))
    q.customer_changes(t["customer"]).write.json(f"{root}/log")
    stream = DocumentStream(spark, mappings, lambda session: tables(session, d, *t), f"{root}/docs")
    stream.start(file_changes(spark, f"{root}/log", files_per_trigger=1000), f"{root}/checkpoint", available_now=True).awaitTermination()
    orders, customers = (Snapshots(spark, f"{root}/docs", m.index).read() for m in mappings)
    return orders.select(F.lit("orders").alias("index"), "_id", F.col("customer.name").alias("name")).unionByName(customers.select(F.lit("customers").alias("index"), "_id", F.col("nation").alias("name")))


def _land(spark, lines: DataFrame, folder: str, name: str) -> None:
    """Lines as log files of a folder, whose names begin with name: a log's files follow one another by name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    made, log = hadoop.Path(f"{folder}-{name}"), hadoop.Path(folder)
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    lines.write.text(made.toString())
    fs.mkdirs(log)
    for n, s in enumerate(sorted(str(x.getPath()) for x in fs.listStatus(made) if x.getPath().getName().startswith("part-"))):
        fs.rename(hadoop.Path(s), hadoop.Path(log, f"{name}-{n:05d}.log"))


@query(f"with {q.ORDER_CHANGES_SQL} select seq, op, a_price as price, 1::bigint as times from c")
def cdc_capture_log(spark, d):
    """A capturer's log read as a stream, stopped, grown and read on from its place: each row once."""
    root, changes = scratch(spark), q.orders_log(spark, d)
    rows = changes.select("seq", F.col("op").alias("type"), "is_ddl", "db", "table", "pk", "es", "ts", "before", "after", F.map_keys(F.coalesce("after", "before")).alias("updated"))
    lines, out = rows.select(F.to_json(F.struct("*")).alias("value"), (F.col("seq") % 2).alias("part")), f"{root}/changes"
    for part in (0, 1):
        _land(spark, lines.filter(F.col("part") == part).select("value"), f"{root}/log", f"{part:06d}")
        reading = capture_log(spark, f"{root}/log", rangeBytes=50_000).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        running = reading.option("path", out).start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    found = spark.read.parquet(out)
    return found.groupBy("seq", "op").agg(F.max(F.element_at("after", "o_totalprice").try_cast("double")).alias("price"), F.count("*").alias("times"))


class _ToItsEnd:
    """A stream that ends when all that is there is read."""

    def __init__(self, query):
        self.query = query

    def awaitTermination(self):  # noqa: N802
        try:
            self.query.processAllAvailable()
        finally:
            self.query.stop()


@query(ORDERS_NOW_SQL)
def cdc_lost_log(spark, d):
    """A log that drops a third of the changes before they are read: the gap is found by its place, the documents are rebuilt in a new
    index behind their alias, and a new stream goes on with what the log still holds."""
    root, m, t = scratch(spark), orders_mapping(CUSTOMER, LINES), tables(spark, d, *FULL)
    rows = q.orders_log(spark, d).select("seq", F.col("op").alias("type"), "is_ddl", "db", "table", "pk", "es", "ts", "before", "after", F.map_keys(F.coalesce("after", "before")).alias("updated"))
    lines, log, docs = rows.select(F.to_json(F.struct("*")).alias("value"), (F.col("seq") % 3).alias("part")), f"{root}/log", f"{root}/docs"
    stream = DocumentStream(spark, [m], lambda session: tables(session, d, *FULL), docs)
    indices, state, sent = Indices(spark, docs), {"checkpoint": f"{root}/first"}, []
    indices.create("orders_1")
    indices.write("orders_1", q._before(spark, t | {"orders": q.earlier_orders(t["orders"])}, m))
    indices.point({m.index: "orders_1"})

    def start():
        return _ToItsEnd(stream.start(capture_log(spark, log), state["checkpoint"]))

    def rebuild():
        stream.rebuild(m, "orders_2")
        state["checkpoint"] = f"{root}/second"

    lost = lost_since(spark, lambda: state["checkpoint"], lambda: retained(log))
    run = lambda: supervised(start, Alerts(sent.append), pause_s=0, attempts=1, lost=lost, on_loss=rebuild)
    _land(spark, lines.filter("part = 0").select("value"), log, "000000")
    run()
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    _land(spark, lines.filter("part = 1").select("value"), log, "000001")
    for s in fs.listStatus(folder):
        fs.delete(s.getPath(), False)
    _land(spark, lines.filter("part = 2").select("value"), log, "000002")
    run()
    if len(sent) != 1 or indices.resolve(m.index) != "orders_2":
        raise RuntimeError(f"one gap was to be found: {sent}")
    return q._flat(indices.read(m.index))


# Write sets


def _placed(requests: DataFrame) -> DataFrame:
    """Requests whose seq is a message's place, in two partitions and with leaps of commit time."""
    at = F.col("seq")
    return requests.withColumn("seq", F.struct((F.expr("seq div 100") * 1_000_000 + F.when(at < 5, -(10**15)).otherwise(0)).alias("es"), F.lit("log").alias("topic"), F.expr("cast(seq div 50 % 2 as int)").alias("partition"), at.alias("offset"), F.lit(0).alias("idx")))


@query(f"""with {q.REQUESTS_SQL}, p as (select *, row_number() over (order by seq) - 1 as place from r),
s as (select *, case when kind = 'delete' or lag(kind) over w is null or lag(kind) over w <> kind or lag(upsert) over w <> upsert then 1 else 0 end as start from p window w as (partition by id order by seq)),
g as (select *, sum(start) over (partition by id order by seq) as run from s)
select id, max(place) as seq, kind, upsert, count(distinct case when kind = 'update' then field end) as n_fields from g group by id, kind, upsert, run""")
def compact_kafka(spark, d):
    """Requests by their places in a log are numbered without gaps, and merged in that order."""
    numbered = compact.numbered(_placed(q.event_requests(tables(spark, d, "events")["events"])), block_rows=2000)
    out = compact.merge_adjacent(numbered, block_rows=2000)
    return out.select("id", "seq", "kind", "upsert", F.greatest(F.size("fields"), F.lit(0)).cast("bigint").alias("n_fields"))


@query("select count(*) as n, true as even, true as in_order from events")
def compact_sparse_places(spark, d):
    """Blocks hold about as many requests each, also where one place lies far before all others, and follow the places."""
    rows = compact.bulk_groups(_placed(q.event_requests(tables(spark, d, "events")["events"])), 64, 20, block_rows=500)
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    return blocks.agg(F.sum("n").alias("n"), (F.max("n") <= 2000).alias("even"), F.bool_and(F.col("low") <= F.col("high")).alias("in_order"))


class FolderReceiver:
    """A receiver that appends what it takes to a folder: it refuses too many bytes at once, and whole bulks with a request it cannot read.

    Each task's copy of it has one file, to which every bulk that it takes is appended and closed before it answers. A store whose files
    cannot grow has a file for each bulk."""

    def __init__(self, folder: str, most_bytes: int):
        self.folder, self.most_bytes, self.store = folder, most_bytes, None

    def __call__(self, requests: list[dict]) -> list[int]:
        if sum(len(k) + len(v or "") for r in requests for k, v in (r["fields"] or {}).items()) > self.most_bytes:
            raise compact.BulkTooLarge
        if any(r["seq"] % 997 == 7 for r in requests):
            raise OSError("a request cannot be read")
        if self.store is None:
            self.store, self.at = pafs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
            self.store.create_dir(self.at, recursive=True)
            self.file = f"{self.at}/{uuid.uuid4().hex}.json"
        try:
            out = self.store.open_append_stream(self.file)
        except NotImplementedError:
            out = self.store.open_output_stream(f"{self.at}/{uuid.uuid4().hex}.json")
        with out:
            out.write("".join(json.dumps({"seq": r["seq"], "kind": r["kind"]}) + "\n" for r in requests).encode())
        return [200] * len(requests)


@query("""select event_id as seq, case when event_id % 997 = 7 then 'fail' else 'done' end as action, event_id % 997 <> 7 as received from events""")
def compact_bulk_bisect(spark, d):
    """Bulks that are too large are halved, and requests that cannot be read are found and alone fail; the rest is in the receiver's folder."""
    folder = f"{scratch(spark)}/received"
    bulks = compact.bulk_groups(q.event_requests(tables(spark, d, "events")["events"]), 1 << 20, 200)
    sent = compact.send_bulks(bulks, FolderReceiver(folder, 1000), attempts=1, pause_s=0)
    path = f"{folder}-answers"
    sent.select("seq", "action").write.parquet(path)
    received = spark.read.schema("seq bigint, kind string").json(folder).select("seq").distinct().withColumn("received", F.lit(True))
    return spark.read.parquet(path).join(received, "seq", "left").select("seq", "action", F.coalesce("received", F.lit(False)).alias("received"))


@query("select o_orderkey as id, o_totalprice as price from orders where o_orderkey % 10 <> 7")
def replay_out_of_order(spark, d):
    """A relational table after two batches of which the second is the older: what it has had stays, and what is gone stays gone."""
    url, table = f"jdbc:derby:memory:docloom{uuid.uuid4().hex};create=true", "replayed"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().executeUpdate(f"CREATE TABLE {table} (id BIGINT, price DOUBLE)")
    connection.close()
    orders = tables(spark, d, "orders")["orders"]
    none = F.lit(None).cast("map<string,string>")

    def log(seq: int, after, before) -> DataFrame:
        op = F.when(after.isNull(), "DELETE").when(before.isNull(), "INSERT").otherwise("UPDATE")
        return orders.select(
            F.lit(seq).cast("bigint").alias("seq"), op.alias("op"), F.lit(False).alias("is_ddl"), F.lit("shop").alias("db"), F.lit(table).alias("table"), F.array(F.lit("id")).alias("pk"),
            F.lit(0).cast("bigint").alias("es"), F.lit(0).cast("bigint").alias("ts"), before.alias("before"), after.alias("after"),
        )

    row = lambda plus: F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("price"), (F.col("o_totalprice") + plus).cast("string"))
    last = F.when(F.col("o_orderkey") % 10 == 7, none).otherwise(row(0))
    for changes in (log(2, last, row(1)), log(1, row(1), none)):
        replay.replay_tables(spark, changes, url, {table: ["id"]}, **options)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(F.col("ID").cast("bigint").alias("id"), F.col("PRICE").alias("price"))


# Nested children, vectors


EVENTS = Field("events", "array-sql", sql="SELECT e.event_id AS event, e.props AS props FROM events e", on_main="WHERE e.user_id = #{c_custkey} ORDER BY e.event_id DESC")
FIRST = Field("first", "object-sql", sql="SELECT e.event_id AS event, e.props AS props FROM events e", on_main="WHERE e.user_id = #{c_custkey}")
PROPS = (Field("events$props", "object"), Field("first$props", "object"))


@query("""select c_custkey::varchar as _id, row_number() over (partition by c_custkey order by event_id desc) - 1 as pos, event_id as event, json_extract_string(props, '$.k') as k,
min(event_id) over (partition by c_custkey) as first, json_extract_string(first_value(props) over (partition by c_custkey order by event_id), '$.k') as first_k from customer join events on user_id = c_custkey""")
def doc_nested_json(spark, d):
    """JSON children of a nested list and of a nested object."""
    m = Mapping("told", "SELECT c.c_custkey AS id FROM customer c", fields=(EVENTS, FIRST, *PROPS)).check()
    out = view(spark, d, m, "customer", "events").select("_id", F.col("first.event").alias("first"), F.element_at("first.props", "k").alias("first_k"), F.posexplode("events").alias("pos", "e"))
    return out.select("_id", F.col("pos").cast("bigint").alias("pos"), F.col("e.event").alias("event"), F.element_at("e.props", "k").alias("k"), "first", "first_k")


@query("""select o_orderkey::varchar as _id, length(c_name)::float as customer_length, string_agg(distinct length(l_returnflag)::varchar || l_returnflag, ',' order by length(l_returnflag)::varchar || l_returnflag) as flags
from orders left join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by o_orderkey, c_name""")
def doc_nested_vector(spark, d):
    """Vector children of a nested object and of a nested list, which stays in the order of its texts."""
    params = {"modelClass": "letters", "qpm": 0, "requestMaxContentSize": 50}
    who = Field("customer", "object-sql", sql="SELECT c.c_custkey AS id, c.c_name AS name FROM customer c", on_main="WHERE c.c_custkey = #{o_custkey}")
    flags = Field("flags", "array-sql", sql="SELECT DISTINCT l.l_returnflag AS flag, l.l_returnflag AS text FROM lineitem l", on_main="WHERE l.l_orderkey = #{o_orderkey}")
    fields = (who, flags, Field("customer$name", "llm-vector", params=params), Field("flags$flag", "llm-vector", params=params))
    out = view(spark, d, Mapping("embedded", ORDERS_SQL, fields=fields).check(), "orders", "customer", "lineitem", models={"letters": q._letters})
    lengths = F.transform("flags", lambda x: F.concat(x["flag"][0].cast("int").cast("string"), x["text"]))
    return out.select("_id", F.get("customer.name", F.lit(0)).alias("customer_length"), F.when(F.size("flags") > 0, F.array_join(lengths, ",")).alias("flags"))


class CountedLetters:
    """A model that tells how often it was asked, and for how many texts."""

    def __init__(self, requests, texts):
        self.requests, self.texts = requests, texts

    def __call__(self, texts: list[str]) -> list[list[float]]:
        self.requests.add(1)
        self.texts.add(len(texts))
        return q._letters(texts)


@query("""with t as (select distinct c_mktsegment as x from customer union select distinct c_name from customer where c_custkey % 2 = 0),
u as (select distinct c_name as x from customer where c_custkey % 2 = 1 and c_name not in (select x from t))
select c_custkey::varchar as _id, length(c_name)::float as name, length(c_mktsegment)::float as segment, (select count(*) from t) as first_run, (select count(*) from u) as second_run, true as in_size from customer""")
def embed_two_runs(spark, d):
    """Two vector fields of one queue over two runs: each text is asked for once, in requests of the size that the mapping sets, and kept."""
    c, sc = tables(spark, d, "customer")["customer"], spark.sparkContext
    params = {"modelClass": "letters", "qpm": -1, "requestMaxContentSize": 7, "requestQueueName": "shared"}
    m = Mapping("named", "SELECT c.c_custkey AS id, c.c_name AS name, c.c_mktsegment AS segment FROM customer c", fields=(Field("name", "llm-vector", params=params), Field("segment", "llm-vector", params=params))).check()
    kept, asked, out = KeptVectors(spark, scratch(spark)), [], None
    for rows in (c.filter("c_custkey % 2 = 0"), c):
        counts = sc.accumulator(0), sc.accumulator(0)
        register(spark, {"customer": rows})
        out = build_view(spark, m, models={"letters": CountedLetters(*counts)}, vectors=kept)
        out.count()
        asked.append((counts[0].value, counts[1].value))
    in_size = all(n * 7 >= texts for n, texts in asked) and limits(params).request_size == 7
    return out.select(
        "_id", F.get("name", F.lit(0)).alias("name"), F.get("segment", F.lit(0)).alias("segment"), F.lit(asked[0][1]).cast("bigint").alias("first_run"),
        F.lit(asked[1][1]).cast("bigint").alias("second_run"), F.lit(in_size).alias("in_size"),
    )


@query("select conv_id, turn, case when trim(text) <> '' then length(trim(text))::float end as length, case when trim(text) <> '' then (length(trim(text)) - length(replace(trim(text), 'e', '')))::float end as n_e from conversations")
def embed_letters(spark, d):
    """Vectors of all conversation texts, by a model whose vectors SQL can tell."""
    out = embed(tables(spark, d, "conversations")["conversations"], "text", "vector", q._letters)
    return out.select("conv_id", "turn", F.get("vector", F.lit(0)).alias("length"), F.get("vector", F.lit(2)).alias("n_e"))


# Reconciliation and declarations


@query(q.ORACLE_SQL["rec_check_all"])
def rec_check_tree(spark, d):
    """What rec_check_all finds, by a tree of digests."""
    now, docs = q._stale(spark, d)
    return reconcile.check_ranges(now, docs, {"lines": False}).groupBy("action").agg(F.count("*").alias("n"))


@query(q.ORACLE_SQL["doc_typed"])
def doc_typed_by_index(spark, d):
    """Target types as an index's own mapping states them."""
    target = target_types(ORDER_TYPES, "orders")
    return typed(view(spark, d, orders_mapping(), "orders"), target)


@query(q.ORACLE_SQL["doc_grouped_array"])
def doc_from_yaml_folder(spark, d):
    """Mappings read from a folder's files: those of another environment, and switched off ones, are left out."""
    brands = q.BRANDS
    text = lambda env, enable, sql: (
        f"destination: shop\nesMapping:\n  _index: orders\n  env: {env}\n  enable: {enable}\n  sql: \"{sql}\"\n  objFields:\n"
        f"    brands:\n      type: array-sql\n      param-sql:\n        sql: \"{brands.sql}\"\n        on-main-table-change-where-sql: \"{brands.on_main}\"\n"
        "    brands$flags:\n      type: array\n      paramArray:\n        split: ','\n"
    )
    with tempfile.TemporaryDirectory() as folder:
        for name, args in {"orders": ("prod", "true", ORDERS_SQL), "test": ("dev", "true", "SELECT 1 AS id FROM nowhere n"), "off": ("prod", "false", ORDERS_SQL)}.items():
            Path(folder, f"{name}.yml").write_text(text(*args))
        found = load_mappings(folder, env="prod")
    assert list(found) == ["orders.yml"] and FLAGS.name in {f.name for f in found["orders.yml"].fields}
    out = view(spark, d, found["orders.yml"], "orders", "lineitem", "part")
    return out.select("_id", F.explode("brands").alias("b")).select("_id", "b.brand", F.array_join("b.flags", "|").alias("flags"), "b.n")


@query("select c_custkey as seq, c_custkey || '|_' || replace(c_name || '|x', '|', '||') as key from customer")
def replay_keys(spark, d):
    """Keys of several columns as one text, with their mark escaped."""
    c = tables(spark, d, "customer")["customer"].withColumn("c_name", F.concat("c_name", F.lit("|x")))
    out = ch.rows_as_changes(c, "shop", "customer", ["c_custkey", "c_name"], seq="c_custkey")
    return out.select("seq", replay.key_of(F.col("after"), F.col("pk")).alias("key"))


@query("select event_id, event_id % 2 = 0 as number, event_id % 3 <> 0 as items, true as order_free from events")
def rec_field_equal(spark, d):
    """Fields by their types: numbers against texts, and lists with an item changed or in another order."""
    e, k = tables(spark, d, "events")["events"], F.col("event_id")
    text = F.when(k % 2 == 0, k.cast("string")).otherwise((k + 1).cast("string"))
    listed = T.ArrayType(T.StringType())
    items, other = F.array(F.lit("a"), k.cast("string")), F.array(F.when(k % 3 == 0, "b").otherwise("a"), k.cast("string"))
    return e.select(
        "event_id", equality.field_equal(k, T.LongType(), text, T.StringType()).alias("number"), equality.field_equal(items, listed, other, listed, True).alias("items"),
        equality.field_equal(items, listed, F.reverse(items), listed).alias("order_free"),
    )


@query("select o_orderkey::varchar as _id, o_totalprice as price from orders")
def load_check_twice(spark, d):
    """A second check of repaired documents finds nothing to do, and leaves them as they are."""
    t, m = tables(spark, d, "orders"), orders_mapping()
    docs = q._before(spark, {"orders": q.earlier_orders(t["orders"])}, m)
    register(spark, t)
    store = Snapshots(spark, scratch(spark), m.index)
    store.write(load.check_and_repair(spark, m, docs)[0])
    again, work = load.check_and_repair(spark, m, store.read())
    return again.join(work.select("_id"), "_id", "left_anti").select("_id", "price")
