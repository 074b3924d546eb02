"""Write sets: requests in order, compacted, applied to documents, and sent in bulks."""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import stored

#: kind is update or delete; upsert says whether an update may create its document; fields holds the written values.
REQUEST = "index string, id string, seq bigint, kind string, upsert boolean, fields map<string,string>"


#: Ranges of seq: at most MOST_RANGES, as long as none of them has more than RANGE_ROWS requests.
MOST_RANGES, RANGE_ROWS = 64, 100_000


def _key_set(fields: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(fields)), "\u0000")


def trim(requests: DataFrame) -> DataFrame:
    """Requests without those that a later one makes void: an update by a later update of the same document, upsert flag
    and field names, or by a later delete; a delete by a later delete.

    Where an upsert is trimmed, an update in between that may not create a document meets none: use fold for the
    exact outcome of the untrimmed sequence."""
    rows = _with_last_delete(requests).filter(F.col("_deleted").isNull() | (F.col("seq") >= F.col("_deleted")))
    same = rows.withColumn("_keys", _key_set(F.col("fields"))).groupBy("index", "id", "kind", "upsert", "_keys")
    return same.agg(F.max("seq").alias("seq"), F.max_by("fields", "seq").alias("fields")).drop("_keys")


def _with_last_delete(requests: DataFrame) -> DataFrame:
    """requests with _deleted, the document's last delete: a sum with partial sums and a join, so a document with very many
    requests is no single task's work."""
    last = requests.filter("kind = 'delete'").groupBy("index", "id").agg(F.max("seq").alias("_deleted"))
    return requests.join(last, ["index", "id"], "left")


def _blocked(requests: DataFrame, block_rows: int) -> DataFrame:
    """requests with block: runs of consecutive seq, of about block_rows requests each, however seq is spread and of whatever type.

    Ranges come from a sample of seq, so they follow the number of requests and not the span of seq. Since another run may
    draw another sample, the blocks are written once. A range holds RANGE_ROWS requests, and less only as long as there are few ranges, since the
    driver keeps a sample and sizes for each; blocks that are smaller are cut inside their range."""
    n = requests.count()
    if n <= block_rows:
        return requests.withColumn("block", F.lit(0).cast("bigint"))
    parts = -(-n // max(block_rows, min(RANGE_ROWS, -(-n // MOST_RANGES))))
    ranges = requests.repartitionByRange(parts, "seq").withColumn("block", F.spark_partition_id().cast("bigint"))
    if n > parts * block_rows:
        ranges = stored(ranges)
        place = F.rank().over(Window.partitionBy("block").orderBy("seq")) - 1  # requests of one place stay together
        ranges = ranges.withColumn("_place", place).withColumn("block", F.shiftleft("block", 32) + F.floor(F.col("_place") / block_rows).cast("bigint")).drop("_place")
    return stored(ranges)


def numbered(requests: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """requests with seq as whole numbers from 0 without gaps, in the order that seq had: for positions of several parts, as
    messages have them, and for numbers that leap. Each block is numbered by itself, behind the rows of the blocks before it."""
    rows = _blocked(requests, block_rows)
    counts = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    counts = counts.select("block", F.coalesce(before, F.lit(0).cast("bigint")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("seq")) - 1
    out = rows.withColumn("_n", within).join(counts, "block").withColumn("seq", F.col("_before") + F.col("_n"))
    return out.select(*requests.columns)


def merge_adjacent(requests: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Neighbouring updates of a document with one upsert flag become one. Where several of them write a field the last
    value stands, so the outcome is that of the sequence. One row for each merged run.

    Runs are numbered inside blocks of consecutive seq (see _blocked), and each block goes on from the last request and the number of
    runs of the document's blocks before it; so a document with very many requests is no single task's work."""
    own = F.struct("kind", "upsert")
    within, blocks = Window.partitionBy("index", "id", "block").orderBy("seq"), Window.partitionBy("index", "id").orderBy("block")
    rows = _blocked(requests, block_rows)
    ends = rows.groupBy("index", "id", "block").agg(F.max_by(own, "seq").alias("end"))
    rows = rows.join(ends.select("index", "id", "block", F.lag("end").over(blocks).alias("_before")), ["index", "id", "block"])
    before = F.coalesce(F.lag(own).over(within), F.col("_before"))
    rows = rows.withColumn("_start", (before.isNull() | (before != own) | (F.col("kind") == "delete")).cast("int"))
    starts = rows.groupBy("index", "id", "block").agg(F.sum("_start").alias("n"))
    starts = starts.select("index", "id", "block", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    runs = rows.withColumn("_run", F.sum("_start").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(starts, ["index", "id", "block"])
    runs = runs.withColumn("_run", F.col("_run") + F.col("_earlier"))
    each = runs.select("index", "id", "seq", "kind", "upsert", "_run", F.explode_outer("fields").alias("field", "value"))
    last = each.groupBy("index", "id", "kind", "upsert", "_run", "field").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    entry = F.when(F.col("field").isNotNull(), F.struct("field", "value"))
    return (
        last.groupBy("index", "id", "kind", "upsert", "_run")
        .agg(F.max("seq").alias("seq"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))
        .drop("_run")
    )


def drop_repeated_stamps(requests: DataFrame, stamp: str) -> DataFrame:
    """Updates that only stamp the time go where the document already has an earlier update."""
    first = requests.filter("kind = 'update'").groupBy("index", "id").agg(F.min("seq").alias("_first"))
    only = (F.col("kind") == "update") & (F.size("fields") == 1) & F.map_contains_key("fields", stamp)
    return requests.join(first, ["index", "id"], "left").filter(~(only & (F.col("seq") > F.col("_first")))).drop("_first")


def fold(requests: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """The outcome of the whole sequence for each document: index, id, deleted, created, fields.

    present (index, id) says which documents exist before. After the last delete, or from the start for documents that
    do not exist, plain updates are void until the first upsert; from there each field's last value stands. A document
    that exists and is not deleted takes all updates. Documents that no request touches in the end are left out."""
    rows = _with_last_delete(requests)
    if present is not None:
        rows = rows.join(present.select("index", "id", F.lit(True).alias("_present")).distinct(), ["index", "id"], "left")
    else:
        rows = rows.withColumn("_present", F.lit(None).cast("boolean"))
    exists = F.col("_deleted").isNull() & F.coalesce("_present", F.lit(False))
    after = F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))
    first = rows.filter(after & (F.col("kind") == "update") & (exists | F.col("upsert"))).groupBy("index", "id").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, ["index", "id"], "left")
    live = after & (F.col("kind") == "update") & (F.col("seq") >= F.col("_first"))
    each = rows.select("index", "id", "seq", (F.col("_deleted").isNotNull()).alias("deleted"), F.col("_first").isNotNull().alias("created"), F.explode_outer(F.when(live, F.col("fields"))).alias("field", "value"))
    last = each.groupBy("index", "id", "deleted", "created", "field").agg(F.max_by("value", "seq").alias("value"))
    entry = F.when(F.col("field").isNotNull(), F.struct("field", "value"))
    out = last.groupBy("index", "id", "deleted", "created").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))
    return out.filter("deleted or created")


def apply_requests(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """docs (index, id, fields) after the requests: one full outer join with the folded write set."""
    folded = fold(requests, docs).withColumnRenamed("fields", "new")
    both = docs.join(folded, ["index", "id"], "full_outer")
    old = F.when(F.coalesce("deleted", F.lit(False)), F.lit(None)).otherwise(F.col("fields"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key("new", k))
    value = F.when(F.col("new").isNull(), old).when(old.isNull(), F.col("new")).otherwise(F.map_concat(kept, F.col("new")))
    gone = F.coalesce(F.col("deleted") & ~F.col("created"), F.lit(False))
    return both.filter(~gone).select("index", "id", value.alias("fields"))


def update_by_ids(ids: DataFrame, field: str, value: Column, seq: int = 0) -> DataFrame:
    """One update of one field for each of many ids."""
    return ids.select("index", "id", F.lit(seq).cast("bigint").alias("seq"), F.lit("update").alias("kind"), F.lit(False).alias("upsert"), F.create_map(F.lit(field), value.cast("string")).alias("fields"))


def update_by_query(view: DataFrame, changes: DataFrame, on: list[str], written: list[str]) -> DataFrame:
    """Partial documents for every row of a view that matches changes on some columns: _id and the written columns."""
    found = view.select("_id", *on).join(changes.select(*on, *written), on)
    return found.groupBy("_id").agg(*[F.max(c).alias(c) for c in written])


def with_status(responses: DataFrame) -> DataFrame:
    """What becomes of each bulk response by its status: missing and conflicting documents are passed over with a warning,
    rejections for load are retried, other failures fail the batch."""
    s = F.col("status")
    return responses.withColumn("action", F.when(s < 300, "done").when(s.isin(404, 409), "warn").when(s == 429, "retry").otherwise("fail"))


def bulk_groups(requests: DataFrame, max_bytes: int, max_requests: int, block_rows: int = 100_000) -> DataFrame:
    """requests with lane, block and bulk: bulks of at most max_requests requests and max_bytes of field text, and of one
    request more than that where its text begins below the limit.

    A document's requests are in one of eight lanes, and the order of its bulks (block, then bulk) is theirs. Blocks of
    consecutive seq follow the number of requests, so a task numbers about block_rows of them at most, also of one document."""
    rows = _blocked(requests, block_rows)
    text = F.aggregate(F.map_values("fields"), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))
    lane = F.pmod(F.xxhash64("id"), F.lit(8))
    # a request takes its share of the requests or of the bytes of a bulk, whichever is larger, in whole units of both
    cost = F.greatest(F.lit(max_bytes).cast("bigint"), F.coalesce(text, F.lit(0).cast("bigint")) * max_requests)
    rows = rows.withColumn("lane", lane).withColumn("_cost", cost)
    order = Window.partitionBy("index", "lane", "block").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_cost").over(order), F.lit(0).cast("bigint"))
    return rows.withColumn("bulk", F.floor(before / F.lit(max_bytes * max_requests)).cast("bigint")).drop("_cost")


#: Bulks of a lane that are handed to Python together: each hand-over costs as much as some hundred requests.
BULKS_AT_ONCE = 16


class BulkTooLarge(Exception):
    """A receiver's answer to a bulk with more bytes than it takes (413)."""


def _text_bytes(request: dict) -> int:
    return len(request["id"] or "") + sum(len(k.encode()) + len((v or "").encode()) for k, v in (request["fields"] or {}).items())


class _Delivery:
    """One task's way of sending: halves what is too large, and halves what fails as a whole down to the request at fault."""

    def __init__(self, send: Callable[[list[dict]], list[int]], attempts: int, pause_s: float):
        self.send, self.attempts, self.pause_s = send, attempts, pause_s
        self.refused = None  # the least number of bytes that was refused: no larger bulk is tried again

    def __call__(self, rows: list[dict], sizes: list[int] | None = None) -> list[int]:
        sizes = list(map(_text_bytes, rows)) if sizes is None else sizes  # measured once, however often the bulk is halved
        size = sum(sizes)
        if self.refused is not None and size >= self.refused and len(rows) > 1:
            return self._halves(rows, sizes)
        for n in range(self.attempts):
            try:
                return [int(code) for code in self.send(rows)]
            except BulkTooLarge:
                self.refused = size if self.refused is None else min(size, self.refused)
                return self._halves(rows, sizes) if len(rows) > 1 else [413]
            except Exception:
                if n + 1 < self.attempts:
                    time.sleep(self.pause_s * 2**n)
        return self._halves(rows, sizes) if len(rows) > 1 else [500]

    def _halves(self, rows: list[dict], sizes: list[int]) -> list[int]:
        """By bytes, in order, and at least one request in each."""
        total, held, cut = sum(sizes), 0, 1
        for n, size in enumerate(sizes[:-1]):
            held += size
            cut = n + 1
            if 2 * held >= total:
                break
        return self(rows[:cut], sizes[:cut]) + self(rows[cut:], sizes[cut:])


def send_bulks(bulks: DataFrame, send: Callable[[list[dict]], list[int]], *, attempts: int = 3, pause_s: float = 1.0) -> DataFrame:
    """Sends each bulk of bulk_groups by send, a function of its requests in order that returns a status for each, and
    returns one row for each request: index, id, seq, status, tries and action (see with_status).

    Where send raises BulkTooLarge the bulk is halved by its bytes, and so again; a single request that is too large has
    status 413. Where it raises anything else, attempts times, the bulk is halved until the request at fault is alone, which
    has status 500; all others go through. Requests that are rejected for load (429) are sent again, with the requests of
    their document behind them, up to attempts times and after growing pauses.

    What fails in the end is in the result, so a caller can write it elsewhere or raise. A task that runs again sends again:
    a receiver takes a request's seq as its version and passes over those that it has. A bulk is small by its making; BULKS_AT_ONCE of a lane
    are one task's work, one after another."""
    kind = bulks.schema["seq"].dataType.simpleString()
    if kind != "bigint":
        raise ValueError("number the requests first (numbered): seq is to be a bigint")

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.drop(columns="_some").sort_values(["bulk", "seq"], kind="stable")
        rows = table.to_dict("records")
        for r in rows:
            r["fields"] = dict(r["fields"]) if r["fields"] is not None else None
        status, tries = [], []
        for _, bulk in groupby(rows, lambda r: r["bulk"]):
            codes, times = one(list(bulk))
            status, tries = status + codes, tries + times
        return pd.DataFrame({"index": table["index"].tolist(), "id": table["id"].tolist(), "seq": table["seq"].tolist(), "status": status, "tries": tries})

    def one(rows: list[dict]) -> tuple[list[int], list[int]]:
        """The statuses and tries of a bulk's requests."""
        deliver = _Delivery(send, attempts, pause_s)
        status, tries, left = [0] * len(rows), [0] * len(rows), list(range(len(rows)))
        for n in range(attempts):
            if n:
                time.sleep(pause_s * 2 ** (n - 1))
            for k, code in zip(left, deliver([rows[k] for k in left]), strict=True):
                status[k], tries[k] = code, n + 1
            first: dict[str, int] = {}
            for k in left:
                if status[k] == 429:
                    first.setdefault(rows[k]["id"], k)
            left = [k for k in left if k >= first.get(rows[k]["id"], len(rows))]
            if not left:
                break
        return status, tries

    some = bulks.withColumn("_some", F.floor(F.col("bulk") / BULKS_AT_ONCE))
    out = some.groupBy("index", "lane", "block", "_some").applyInPandas(run, "index string, id string, seq bigint, status int, tries int")
    return with_status(out)
