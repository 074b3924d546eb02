"""Versioned document snapshots in buckets of ids: a version names, for each bucket, the folder that holds it."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir, which driver and executors share. Only where all run in one process, and it
    is unset, a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _cleaning_lock = {}, threading.Lock()


@contextmanager
def no_shuffles_left(spark: SparkSession):
    """What is written inside leaves no shuffle files once it is written: else they lie on disk until the driver happens to collect its
    garbage. Several threads of a session may be inside; the last one puts the session's setting back."""
    key = spark._jsparkSession.sessionUUID()
    with _cleaning_lock:
        n, before = _cleaning.get(key, (0, None))
        _cleaning[key] = (n + 1, spark.conf.get(_CLEANUP, "false") if n == 0 else before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            n, before = _cleaning.pop(key)
            if n > 1:
                _cleaning[key] = (n - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once: written to a scratch folder, which goes with the session, and read again, which also cuts its lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    with no_shuffles_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Columns of a delta beside the documents': the version that wrote a row, whether it deletes, and the fields it sets (null: all).
DELTA = "_v bigint, _gone boolean, _set array<string>"


class Commits:
    """Numbered states of something under a path: each is a JSON file, committed-v, which appears in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._root)] if self._fs.exists(self._root) else []

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"committed-(\d+)", n) for n in self._names()) if m)

    def version(self) -> int | None:
        """The current version: the highest that was committed."""
        return max(self._versions(), default=None)

    def _commit(self, version: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/committed-{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, commit: dict) -> int:
        half, whole = (self._hadoop.Path(f"{self.path}/{n}") for n in (f"writing-{uuid.uuid4().hex}", f"committed-{version}"))
        out = self._fs.create(half, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if self._fs.exists(whole) or not self._fs.rename(half, whole):  # a local rename would replace a file
            self._fs.delete(half, False)
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")
        return version


#: Bits of the bitmap of ids in deltas, which goes through the driver to all executors: 8 MB. Beyond some 10^7 such ids more base rows
#: are shuffled to find that nothing lies over them.
MOST_BITS = 26

#: About as many buckets as a store splits into at most, as long as none of them has more than BUCKET_BYTES.
MOST_BUCKETS, BUCKET_BYTES = 64, 256 << 20


class Sealed(RuntimeError):
    """An index that takes no more writes, since another stands in for it."""


class Snapshots(Commits):
    """An index's documents under root/index, merged on read, in buckets by a hash of their key.

    Version v is the file committed-v, which appears in one step. It names what a version changes: for each touched bucket
    its base folder and the folders of deltas over it, and for each stream the last batch that is in it. Every sixteenth is
    whole, so a state is read from sixteen small files at most.

    An update writes one delta: whole documents, deletions, and parts of documents (some fields of them). It reads and
    rewrites nothing that is there, so it costs what it holds. Reading overlays the deltas on their base rows; base rows whose
    ids are in no delta pass by a bitmap of those ids (8 MB at most) without a shuffle. compact() rewrites the buckets that have many or large deltas, and
    splits those that have grown beyond bucket_bytes in two, again and again; other buckets stay as they are. Of a store of many
    such buckets, larger ones are left whole, up to 256 MB: a bucket costs a folder and files at each version.

    by is the column that buckets go by, _id unless all rows of another value are to lie together."""

    def __init__(self, spark: SparkSession, root: str, index: str, buckets: int = 32, *, by: str = "_id", bucket_bytes: int = 256 << 20, most_deltas: int = 8):
        super().__init__(spark, f"{root.rstrip('/')}/{index}")
        self.buckets, self.by, self.bucket_bytes, self.most_deltas = buckets, by, bucket_bytes, most_deltas

    def state(self, version: int) -> dict:
        """schema, marks and all buckets of a version: the changes since the last whole commit, one over the other."""
        log = [self._commit(version)]
        while not log[-1]["whole"]:
            log.append(self._commit(version - len(log)))
        buckets: dict[int, dict] = {}
        for commit in reversed(log):
            for b in commit["gone"]:
                buckets.pop(b, None)
            buckets |= {int(b): x for b, x in commit["buckets"].items()}
        return {"schema": log[0]["schema"], "marks": log[0]["marks"], "buckets": buckets, "sealed": log[0].get("sealed", False)}

    def applied(self, stream: str) -> int:
        """The last batch of a stream that the current version holds; -1 if none."""
        v = self.version()
        return -1 if v is None else self._commit(v)["marks"].get(stream, -1)

    def read(self, version: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The documents of a version, the current one by default. With only, those of the buckets that its keys (a column named
        as by) lie in: a superset of what the keys name, from as few files."""
        v = self.version() if version is None else version
        if v is None:
            return None
        state = self.state(v)
        if only is None:
            return self._merged(state, list(state["buckets"]))
        touched = only.select(self._bucket(list(state["buckets"])).alias("_bucket")).distinct().collect()  # at most a row a bucket
        return self._merged(state, [r["_bucket"] for r in touched])

    def _merged(self, state: dict, buckets: list[int]) -> DataFrame:
        """The documents of some buckets: base rows with the deltas over them."""
        own = [(b, state["buckets"][b]) for b in buckets]
        base_paths = [f"{self.path}/{x['base']}/_bucket={b}" for b, x in own if x["base"]]
        delta_paths = [f"{self.path}/{folder}/_bucket={b}" for b, x in own for folder in x["deltas"]]
        reader = lambda schema: self.spark.read.schema(schema)
        base = reader(state["schema"]).parquet(*base_paths) if base_paths else self.spark.createDataFrame([], state["schema"])
        if not delta_paths:
            return base
        deltas = reader(f"{state['schema']}, {DELTA}").parquet(*delta_paths)
        bits = min(MOST_BITS, max(15, (4 * sum(x["added"] for _, x in own)).bit_length()))  # an id takes some bytes: about 16 places each
        place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << bits))
        marks = deltas.select(F.bitmap_bucket_number(place + 1).alias("_at"), F.bitmap_bit_position(place + 1).alias("_bit"))
        marks = marks.groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_map"))
        rows = base.withColumn("_at", F.bitmap_bucket_number(place + 1)).withColumn("_bit", F.bitmap_bit_position(place + 1))
        rows = rows.join(F.broadcast(marks), "_at", "left")  # 2**(bits - 3) bytes at most
        byte = F.conv(F.hex(F.substring("_map", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
        names = [f"`{c}`" for c in base.columns]
        passed = rows.filter(~hit).select(*names)
        under = rows.filter(hit).select(*names, F.lit(-1).cast("bigint").alias("_v"), F.lit(False).alias("_gone"), F.lit(None).cast("array<string>").alias("_set"))
        both, whole = under.unionByName(deltas), F.when(F.col("_set").isNull(), F.col("_v"))
        fields = [c for c in base.columns if c != "_id"]
        latest = [F.max_by(F.col(f"`{c}`"), F.when(F.col("_set").isNull() | F.array_contains("_set", c), F.col("_v"))).alias(c) for c in fields]
        found = both.groupBy("_id").agg(*latest, F.max(whole).alias("_whole"), F.max_by("_gone", whole).alias("_gone"))
        return passed.unionByName(found.filter("_whole is not null and not _gone").select(*names))

    def _bucket(self, leaves: list[int], key: Column | None = None) -> Column:
        """A row's bucket. Buckets are leaves of a binary tree over the hash's low bits; a leaf's number is a 1 before its bits."""
        h = F.xxhash64((F.col(f"`{self.by}`") if key is None else key).cast("string"))
        by_depth: dict[int, list[int]] = {}
        for leaf in leaves:
            by_depth.setdefault(leaf.bit_length() - 1, []).append(leaf)
        at = {d: (F.pmod(h, F.lit(1 << d)) + F.lit(1 << d)).cast("bigint") for d in by_depth}
        most = max(by_depth, key=lambda d: len(by_depth[d]))
        out = at[most]
        for d in by_depth:
            if d != most:
                out = F.when(at[d].isin(by_depth[d]), at[d]).otherwise(out)
        return out

    def changed_since(self, version: int) -> tuple[DataFrame, Callable[[Column], Column]]:
        """The current documents of the buckets that differ from a version's, and a test whether a key lies in one of them: what
        such a bucket does not hold is gone. Other buckets are not read."""
        then, now = self.state(version)["buckets"], self.state(self.version())
        touched = [b for b, x in now["buckets"].items() if then.get(b) != x]
        leaves = list(now["buckets"])
        return self._merged(now, touched), lambda key: self._bucket(leaves, key).isin(touched)

    def _open_to_writes(self, state: dict) -> None:
        if state.get("sealed"):
            raise Sealed(f"{self.path} takes no more writes")

    def seal(self, version: int, sealed: bool = True) -> bool:
        """Ends writing, if version is the current one still: False if another writer has committed the next. The seal is a commit
        of its own, so that of a seal and a write at one time only one succeeds. sealed=False takes a seal back."""
        state = self.state(version)
        try:
            self._follow(version + 1, state, {}, [], state["schema"], state["marks"], sealed)
            return True
        except RuntimeError:
            return False

    def drop(self) -> None:
        """Deletes the index with all its versions."""
        self._fs.delete(self._root, True)

    def _put(self, rows: DataFrame, version: int, leaves: list[int], together: bool = True) -> tuple[str, dict[int, int]]:
        """Writes rows by their buckets; the folder, and the bytes of each bucket that has any. Unless rows are brought together by
        buckets first, which shuffles them, each task has a file in every bucket."""
        folder = f"v-{version}-{uuid.uuid4().hex[:8]}"
        rows = rows.withColumn("_bucket", self._bucket(leaves))
        if together:  # Spark splits a bucket that is too large for a task, and joins small ones
            rows = rows.hint("rebalance", "_bucket")
        with no_shuffles_left(rows.sparkSession):
            rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        listed = self._fs.listStatus(self._hadoop.Path(f"{self.path}/{folder}"))
        found = [(m[1], s.getPath()) for s in listed if (m := re.fullmatch(r"_bucket=(\d+)", s.getPath().getName()))]
        return folder, {int(b): self._fs.getContentSummary(at).getLength() for b, at in found}

    def _follow(self, version: int, state: dict, changed: dict[int, dict], gone: list[int], schema: str, marks: dict, sealed: bool = False) -> int:
        """Commits what a version changes of the state before it, or every sixteenth time all of it."""
        whole = version % 16 == 0
        if whole:
            changed = {b: x for b, x in state["buckets"].items() if b not in gone} | changed
        return self._publish(version, {"whole": whole, "schema": schema, "marks": marks, "buckets": changed, "gone": [] if whole else gone, "sealed": sealed})

    def write(self, docs: DataFrame, version: int | None = None, marks: dict[str, int] | None = None) -> int:
        """Writes docs as the next version. A version that is committed already is not written again. The batches that the
        version before held count as held: its documents are those of the tables as they are now."""
        current = self.version()
        v = (0 if current is None else current + 1) if version is None else version
        if current is not None and v <= current:
            return current
        last = {} if current is None else self._commit(current)
        self._open_to_writes(last)
        before = last.get("marks", {})
        depth = max(0, self.buckets - 1).bit_length()
        leaves = list(range(1 << depth, 2 << depth))
        folder, sizes = self._put(docs, v, leaves, together=False)
        buckets = {b: {"base": folder if b in sizes else None, "deltas": [], "size": sizes.get(b, 0), "added": 0} for b in leaves}
        return self._publish(v, {"whole": True, "schema": _ddl(docs), "marks": before | (marks or {}), "buckets": buckets, "gone": []})

    def update(self, upserts: DataFrame, deletes: DataFrame, marks: dict[str, int] | None = None, parts: list[tuple[list[str], DataFrame]] = ()) -> int:
        """The next version: upserts (whole documents) in, deletes (_id) out, and for each of parts its fields set in the
        documents that are there (_id and the fields). A document is in one of upserts and deletes, or in parts of different fields."""
        current = self.version()
        state, v = self.state(current), current + 1
        self._open_to_writes(state)

        def delta(rows: DataFrame, gone: bool, fields: list[str] | None) -> DataFrame:
            names = F.array(*[F.lit(c) for c in fields]) if fields is not None else F.lit(None).cast("array<string>")
            return rows.withColumn("_v", F.lit(v).cast("bigint")).withColumn("_gone", F.lit(gone)).withColumn("_set", names)

        keys = ["_id"] if self.by == "_id" else ["_id", self.by]
        rows = delta(upserts, False, None).unionByName(delta(deletes.select(*keys), True, None), allowMissingColumns=True)
        for fields, part in parts:
            rows = rows.unionByName(delta(part.select("_id", *fields), False, fields), allowMissingColumns=True)
        folder, sizes = self._put(rows, v, list(state["buckets"]))
        changed = {}
        for b, size in sizes.items():
            x = state["buckets"][b]
            changed[b] = x | {"deltas": [*x["deltas"], folder], "added": x["added"] + size}
        docs = self.spark.createDataFrame([], state["schema"]).unionByName(rows.drop("_v", "_gone", "_set").limit(0), allowMissingColumns=True)
        return self._follow(v, state, changed, [], _ddl(docs), state["marks"] | (marks or {}))

    def compact(self, ratio: float = 0.3) -> int | None:
        """The next version with the same documents, where buckets with too many or too large deltas are rewritten and those
        that are too large are split; None if there is nothing to do."""
        current = self.version()
        state, v = self.state(current), current + 1
        if state["sealed"]:
            return None
        total = sum(x["size"] + x["added"] for x in state["buckets"].values())
        most = max(self.bucket_bytes, min(BUCKET_BYTES, -(-total // MOST_BUCKETS)))
        large = lambda x: x["size"] + x["added"] > most
        much = lambda x: x["added"] > max(ratio * x["size"], most / 64)
        due = {b: x for b, x in state["buckets"].items() if len(x["deltas"]) >= self.most_deltas or much(x) or large(x)}
        if not due:
            return None
        children = []
        for b, x in due.items():
            levels = max(0, -(-(x["size"] + x["added"]) // most) - 1).bit_length() if large(x) else 0
            half = 1 << b.bit_length() - 1  # a bucket's number is a 1 before the hash's low bits
            children += [(half << levels) + (b - half) + k * half for k in range(1 << levels)]
        leaves = [b for b in state["buckets"] if b not in due] + children
        folder, sizes = self._put(self._merged(state, list(due)), v, leaves)
        fresh = {b: {"base": folder if b in sizes else None, "deltas": [], "size": sizes.get(b, 0), "added": 0} for b in children}
        return self._follow(v, state, fresh, [b for b in due if b not in fresh], state["schema"], state["marks"])

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and the folders that none of those needs."""
        versions = self._versions()
        kept = versions[-keep:]
        needed = {f for v in kept for x in self.state(v)["buckets"].values() for f in [x["base"], *x["deltas"]]}
        first = kept[0] if kept else 0
        while first in versions and not self._commit(first)["whole"]:
            first -= 1
        newest = max(versions, default=-1)
        for n in self._names():
            m, c = re.fullmatch(r"v-(\d+)-\w+", n), re.fullmatch(r"committed-(\d+)", n)
            if c and int(c[1]) < first or m and n not in needed and int(m[1]) <= newest:
                self._fs.delete(self._hadoop.Path(f"{self.path}/{n}"), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
