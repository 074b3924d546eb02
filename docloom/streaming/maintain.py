"""Documents kept current from a stream of changes: one foreachBatch, idempotent by stream and batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import batch_statistics, dependents, notifications, wanted
from ..operators.incremental import recompute_parts
from ..functions.embed import Vectors
from ..operators.view import Methods, Models, build_view, register, typed
from ..plans.lineage import Analyser, routes
from ..plans.mapping import Mapping
from ..sources.indices import Indices
from ..sources.snapshots import Sealed, Snapshots
from .owners import OwnerIndex

Listener = Callable[[DataFrame, int], None]


@dataclass
class DocumentStream:
    """Keeps the snapshots of several mappings at view(current tables).

    tables is called for every batch with the batch's session, so that it sees the tables as they are then. A version of a
    snapshot names the last batch of each stream that it holds, a stream being a checkpoint: a batch that runs again after
    a failure finds itself held and changes nothing, while rebuilt snapshots and new checkpoints lose no batch. The
    stream's position moves only when all mappings and listeners are through.

    A batch writes what it changes: whole documents where rows came or went, else the fields that it concerns. Which documents
    hold a nested key comes from an index that is kept beside the documents (see owners). snapshots goes to Snapshots."""

    spark: SparkSession
    mappings: list[Mapping]
    tables: Callable[[SparkSession], dict[str, DataFrame]]
    root: str
    methods: Methods = field(default_factory=dict)
    models: Models = field(default_factory=dict)
    vectors: Vectors | None = None
    snapshots: dict = field(default_factory=dict)
    listeners: list[Listener] = field(default_factory=list)
    ignore_until: int | None = None
    parallel: int = 4
    patience: int = 120  # how often a batch looks for the index that stands in for a sealed one, every half second
    last_es: int | None = None  # the latest commit time of a change that was applied, in epoch ms

    def _how(self) -> dict:
        return {"methods": self.methods, "models": self.models, "vectors": self.vectors}

    def _store(self, spark: SparkSession, m: Mapping) -> Snapshots:
        return Indices(spark, self.root, **self.snapshots).open(m.index)

    def load(self) -> None:
        """The first version of each snapshot and its indices, from the tables."""
        register(self.spark, self.tables(self.spark))
        for m in self.mappings:
            store = self._store(self.spark, m)
            if store.version() is None:
                Indices(self.spark, self.root, **self.snapshots).write(m.index, build_view(self.spark, m, **self._how()))
            OwnerIndex(self.spark, m, self.root, **self.snapshots).load()

    def rebuild(self, mapping: Mapping, to: str | None = None) -> int:
        """A fresh version from the tables alone. With to, in a new index of that name, to which the mapping's alias then moves:
        batches that come meanwhile wait and are in the new index, readers have the old one until then."""

        def docs() -> DataFrame:
            register(self.spark, self.tables(self.spark))
            OwnerIndex(self.spark, mapping, self.root, **self.snapshots).load()
            return build_view(self.spark, mapping, **self._how())

        indices = Indices(self.spark, self.root, **self.snapshots)
        return indices.write(mapping.index, docs()) if to is None else indices.replace(mapping.index, to, docs)

    def apply(self, changes: DataFrame, batch: int, stream: str = "") -> None:
        spark = changes.sparkSession  # a batch has a session of its own, and so have the names in it
        changes = wanted(changes, self.ignore_until).persist()
        try:
            register(spark, self.tables(spark))
            analyser = Analyser(spark)
            listed = [r for m in self.mappings for r in routes(analyser, m)]
            concerned = {r["index"] for r in dependents(changes, listed).select("index").distinct().collect()}  # at most one row a mapping
            with ThreadPoolExecutor(self.parallel) as pool:  # the mappings' jobs run side by side; the batch waits for all
                list(pool.map(lambda m: self._bring(spark, m, changes, batch, stream), [m for m in self.mappings if m.index in concerned]))
            self.last_es = batch_statistics(changes).first()["last_es"] or self.last_es
            told = notifications(dependents(changes, listed))
            for listener in self.listeners:
                listener(told, batch)
        finally:
            changes.unpersist()

    def _bring(self, spark: SparkSession, m: Mapping, changes: DataFrame, batch: int, stream: str) -> None:
        """One mapping's snapshot with the batch in it, unless it is there already. A mapping's index may be an alias; where its
        index was sealed meanwhile, the batch waits for the alias to move and goes into the index that it then stands for."""
        for n in range(self.patience):
            try:
                return self._put(spark, m, changes, batch, stream)
            except Sealed:
                if n + 1 == self.patience:
                    raise
                time.sleep(0.5)

    def _put(self, spark: SparkSession, m: Mapping, changes: DataFrame, batch: int, stream: str) -> None:
        store, index = self._store(spark, m), OwnerIndex(spark, m, self.root, **self.snapshots)
        index.load()
        index.apply(changes, stream, batch)
        if store.version() is None:
            Indices(spark, self.root, **self.snapshots).write(m.index, build_view(spark, m, **self._how()), {stream: batch})
        elif store.applied(stream) < batch:
            upserts, deletes, parts = recompute_parts(spark, m, changes, known=index.owners, **self._how())
            if target := Indices(spark, self.root).target(m.index):
                upserts, parts = typed(upserts, target), [(fields, typed(part, target)) for fields, part in parts]
            store.update(upserts, deletes, {stream: batch}, parts)
            store.compact()
            store.prune()

    def stream_id(self, checkpoint: str) -> str:
        """The name of a checkpoint, kept in it: a new checkpoint is a new stream, whose batches count from 0 again."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{checkpoint.rstrip('/')}/docloom-stream")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path, False)
            out.write(bytearray(uuid.uuid4().hex.encode()))
            out.close()
        inside = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(inside, "UTF-8")
        finally:
            inside.close()

    def start(self, changes: DataFrame, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
        stream = self.stream_id(checkpoint)
        writer = changes.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch, stream)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def server_sent(events: DataFrame, name: str = "change") -> DataFrame:
    """Notifications as server-sent events: id, event and data lines and a blank line."""
    data = F.to_json(F.struct("table", "op", "views"))
    return events.select("seq", F.concat(F.lit("id:"), F.col("seq").cast("string"), F.lit(f"\nevent:{name}\ndata:"), data, F.lit("\n\n")).alias("message"))


def first_in_watermark(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of changes without repeated deliveries within a delay."""
    timed = changes.withColumn("at", F.timestamp_millis("es")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["table", "seq"]).drop("at")
