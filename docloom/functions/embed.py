"""Vector fields: texts embedded once each, in batches, by a pluggable model."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model: texts -> one vector each. It is sent to the tasks, so it loads what it needs there.
Model = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Limits:
    """What a vector field's parameters allow: texts of one request, requests of one minute (None: any), and the queue
    that shares them. Fields that name one queue, in any mapping, keep to its rate together."""

    request_size: int = 6
    per_minute: int | None = 60
    queue: str = ""

    def of(self, model: Model) -> Limits:
        """These limits for a model: the rate is a service's, so one that computes in the task (see in_task) has none."""
        return replace(self, per_minute=None) if getattr(model, "in_task", False) else self


def in_task(model: Model) -> Model:
    """Marks a model that computes its vectors in the task and asks no service."""
    model.in_task = True
    return model


def limits(params: dict) -> Limits:
    """Limits from a mapping's paramLlmVector; a rate of 0 or below is none. Without a queue name, the model's class and name stand for it."""
    own = {str(k).replace("-", "").replace("_", "").lower(): v for k, v in params.items()}
    rate = int(own.get("qpm", 60))
    queue = own.get("requestqueuename") or "/".join(str(own.get(k) or "") for k in ("modelclass", "baseurl", "modelname"))
    return Limits(max(1, int(own.get("requestmaxcontentsize", 6))), rate if rate > 0 else None, str(queue))


class Vectors(Protocol):
    """Where vectors are kept over runs; see sources.vectors."""

    def embed(self, df: DataFrame, text_col: str, out_col: str, model: Model, limit: Limits) -> DataFrame: ...


class Rate:
    """The requests of one queue: its jobs go one after another, and the first request of one waits for the last of the one before."""

    _queues: dict[str, Rate] = {}
    _guard = threading.Lock()

    def __init__(self):
        self.lock, self.free_at = threading.Lock(), 0.0

    @classmethod
    def of(cls, queue: str) -> Rate:
        with cls._guard:
            return cls._queues.setdefault(queue, cls())


def hashed_model(dimensions: int) -> Model:
    """A deterministic stand-in for an embedding service: unit vectors from a text's digest."""

    @in_task
    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dimensions)
            out.append((v / np.linalg.norm(v)).astype("float32").tolist())
        return out

    return run


def embed(
    df: DataFrame, text_col: str, out_col: str, model: Model, *, request_size: int = 6, known: DataFrame | None = None, per_minute: int | None = None, streams: int = 1, attempts: int = 3
) -> DataFrame:
    """df with out_col, the vector of the trimmed text; blank and null texts have none.

    Distinct texts are embedded once, in requests of request_size, and joined back on a digest of the text. known (digest,
    vector) holds vectors from earlier runs, as vectors() returns them; such texts are not sent. With per_minute, texts
    go out from streams tasks that together keep to so many requests a minute. A request that fails is tried attempts
    times, with growing pauses, before the task fails."""
    key = f"_{out_col}_key"
    text = F.trim(F.col(f"`{text_col}`"))
    keyed = df.withColumn(key, F.when(text != "", F.sha2(text, 256)))
    found = vectors(keyed.select(F.col(key).alias("digest"), text.alias("text")), model, request_size=request_size, known=known, per_minute=per_minute, streams=streams, attempts=attempts)
    return keyed.drop(out_col).join(found.toDF(key, out_col), key, "left").drop(key)


def vectors(texts: DataFrame, model: Model, *, request_size: int = 6, known: DataFrame | None = None, per_minute: int | None = None, streams: int = 1, attempts: int = 3) -> DataFrame:
    """(digest, vector) for each distinct digest of texts (digest, text): what to keep as known for the next run."""
    distinct = texts.filter("digest is not null").groupBy("digest").agg(F.min("text").alias("text"))
    if known is not None:
        distinct = distinct.join(known.select("digest"), "digest", "left_anti")
    if per_minute:
        distinct = distinct.repartition(streams)  # as many tasks as may ask at a time
    pause = 60 * streams / per_minute if per_minute else 0

    def ask(some: list[str]) -> list[list[float]]:
        for n in range(attempts):
            try:
                return model(some)
            except Exception:
                if n == attempts - 1:
                    raise
                time.sleep(max(pause, 0.1) * 2**n)
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = 0.0
        for frame in frames:
            some, out = frame["text"].tolist(), []
            for at in range(0, len(some), request_size):
                time.sleep(max(0.0, after - time.monotonic()))
                after = time.monotonic() + pause
                out += ask(some[at : at + request_size])
            yield pd.DataFrame({"digest": frame["digest"], "vector": out})

    new = distinct.mapInPandas(run, "digest string, vector array<float>")
    return new if known is None else new.unionByName(known.select("digest", "vector"))
