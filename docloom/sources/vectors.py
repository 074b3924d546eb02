"""Vectors kept over runs: what a model has answered is not asked again."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Limits, Model, Rate, vectors
from .snapshots import Snapshots, stored


class KeptVectors:
    """The vectors of each queue under root, by the digest of their text: a Snapshots index whose documents are vectors.

    New texts of a call are embedded once, in one job for each queue at a time, and kept before they are used; so a query
    that reads them twice, or a task that runs again, asks for nothing. Fields and mappings of one queue share its rate."""

    def __init__(self, spark: SparkSession, root: str, streams: int = 1):
        self.spark, self.root, self.streams = spark, root, streams

    def _store(self, queue: str) -> Snapshots:
        return Snapshots(self.spark, self.root, f"vectors-{hashlib.md5(queue.encode()).hexdigest()[:12]}")

    def known(self, queue: str, digests: DataFrame | None = None) -> DataFrame | None:
        """(digest, vector) of a queue, all or those whose buckets digests (_id) reach."""
        store = self._store(queue)
        found = store.read() if digests is None else store.read(only=digests)
        return None if found is None else found.select(F.col("_id").alias("digest"), "vector")

    def embed(self, df: DataFrame, text_col: str, out_col: str, model: Model, limit: Limits) -> DataFrame:
        """df with out_col, the vector of the trimmed text; blank and null texts have none."""
        key = f"_{out_col}_key"
        text = F.trim(F.col(f"`{text_col}`"))
        keyed = df.withColumn(key, F.when(text != "", F.sha2(text, 256)))
        texts = stored(keyed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(text).alias("text")))
        rate = Rate.of(limit.queue)
        with rate.lock:  # one job of a queue at a time: its tasks have the whole rate
            known = self.known(limit.queue, texts)
            new = texts if known is None else texts.join(known.select(F.col("digest").alias("_id")), "_id", "left_anti")
            new = stored(new)
            if not new.isEmpty():
                if limit.per_minute:
                    time.sleep(max(0.0, rate.free_at - time.monotonic()))
                made = vectors(new.toDF("digest", "text"), model, request_size=limit.request_size, per_minute=limit.per_minute, streams=self.streams)
                made = stored(made)  # the requests are made here, once
                if limit.per_minute:
                    rate.free_at = time.monotonic() + 60 * self.streams / limit.per_minute
                made = made.select(F.col("digest").alias("_id"), "vector")
                store = self._store(limit.queue)
                store.write(made) if store.version() is None else store.update(made, made.select("_id").limit(0))
            known = self.known(limit.queue, texts)
        if known is None:
            return keyed.drop(key).withColumn(out_col, F.lit(None).cast("array<float>"))
        return keyed.drop(out_col).join(known.toDF(key, out_col), key, "left").drop(key)
