"""A stream that is started again after failures, with alerts that do not repeat too often."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

Alert = Callable[[str], None]


class Alerts:
    """Passes a message on unless the same one went out within an interval."""

    def __init__(self, send: Alert, every_s: float = 600, clock: Callable[[], float] = time.monotonic):
        self.send, self.every_s, self.clock = send, every_s, clock
        self._sent: dict[str, float] = {}

    def __call__(self, message: str) -> bool:
        now = self.clock()
        if now - self._sent.get(message, float("-inf")) < self.every_s:
            return False
        self._sent[message] = now
        self.send(message)
        return True


def committed_offsets(spark: SparkSession, checkpoint: str) -> list[dict]:
    """How far a checkpoint's last finished batch had read each of its sources; empty before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(checkpoint.rstrip("/"))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    commits = hadoop.Path(root, "commits")
    batches = [int(s.getPath().getName()) for s in fs.listStatus(commits) if s.getPath().getName().isdigit()] if fs.exists(commits) else []
    if not batches:
        return []
    stream = fs.open(hadoop.Path(root, f"offsets/{max(batches)}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [json.loads(line) for line in text.splitlines()[2:] if line.startswith("{")]


def gaps(committed: dict, retained: dict) -> list[str]:
    """The parts of a source that no longer hold what follows a committed place.

    Both are offsets by topic and partition, as Kafka has them, retained being the earliest that are there; or file and
    position of a capture log, retained being the first file and its size. A topic or partition that is not retained at all is a gap too."""
    if "file" in committed:
        at, first = committed["file"], retained.get("file", "")
        short = at == first and retained.get("size", committed["position"]) < committed["position"]
        return [at] if at and (first > at or short) else []
    out = []
    for topic, parts in committed.items():
        for part, offset in parts.items():
            earliest = retained.get(topic, {}).get(part)
            if earliest is None or earliest > offset:
                out.append(f"{topic}-{part}")
    return out


def lost_since(spark: SparkSession, checkpoint: Callable[[], str], retained: Callable[[], dict]) -> Callable[[], list[str]]:
    """For supervised: which parts of a stream's source have a gap behind its checkpoint, whatever an error's message says."""
    return lambda: [g for committed in committed_offsets(spark, checkpoint()) for g in gaps(committed, retained())]


def supervised(
    start: Callable[[], StreamingQuery],
    alerts: Alerts,
    *,
    attempts: int | None = None,
    pause_s: float = 0.5,
    lost: Callable[[], list[str]] | None = None,
    on_loss: Callable[[], None] | None = None,
) -> int:
    """Runs a stream to its end, starting it again from its checkpoint after each failure. Returns how often it failed.

    Where the source has lost changes, on_loss is called before the next start: there a caller rebuilds the documents and
    gives start a new checkpoint. lost (see lost_since) is asked before every start, by comparing places; without it, what
    the source's error says decides."""
    failed = 0
    while True:
        if lost and on_loss and (missing := lost()):
            alerts(f"lost: {', '.join(missing)}"[:500])
            on_loss()
        query = start()
        try:
            query.awaitTermination()
            return failed
        except StreamingQueryException as error:
            failed += 1
            alerts(str(error).splitlines()[0][:500])
            if on_loss and not lost and re.search("data loss|failOnDataLoss|OffsetOutOfRange", str(error), re.I):
                on_loss()
            if attempts is not None and failed >= attempts:
                raise
            time.sleep(pause_s)


def status(query: StreamingQuery, last_es: int | None = None) -> dict:
    """Where a stream is: its last batch and rows, and how far the documents are (last_es, from DocumentStream)."""
    p = query.lastProgress
    return {"active": query.isActive, "batch": p["batchId"] if p else None, "rows": p["numInputRows"] if p else 0, "message": query.status["message"], "last_es": last_es}
