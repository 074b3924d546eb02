"""Removal of repeated passages: the order of many strings' suffixes and their common prefixes, built column by column.

The construction follows Bauer, Cox and Rosone (2013), with common prefixes as Cox, Garofalo, Rosone and Sciortino (2016)
keep them: every round inserts one symbol of each string, from the right. Strings are lined up at a place that equal
windows share, so a round needs the transform of the column before only (its positional form, Durbin 2014)."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_clashes, free_name, slices, split_marked, written
from .words import mix

#: Bytes of a gram; the smallest hash of the grams of a window is its key. A power of two.
GRAM = 32
_VALUES = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
_RUNS = pa.schema([("text", pa.binary()), ("key", pa.int64()), ("piece", pa.binary()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32())])
_RUNS_DDL = "text binary, key bigint, piece binary, start bigint, n int, anchor int"
_PIECES = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("anchor", pa.int32()), ("bytes", pa.binary())])
_MARKS = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])
_MARKS_DDL = "key bigint, piece binary, first int, last int"


def window_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and for each window of length bytes the smallest of its grams' hashes, its key."""
    with np.errstate(over="ignore"):
        h, size = _VALUES[data], 1
        while size < GRAM:
            h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[size:]
            size *= 2
        h = grams = mix(h)
    wide, size = length - GRAM + 1, 1
    while 2 * size <= wide:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return grams, np.minimum(h[: len(h) - (wide - size)], h[wide - size :])


def text_runs(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(text, start, n, anchor, key, piece): n windows in a row that have one key, starting at a byte of a text, with the
    digest of the bytes they cover. Every window of length bytes is in one run; a run has at most length windows.

    anchor is where the run's bytes hold the gram of the key, or -1 if they hold it more than once (text that repeats in
    itself). Runs that share a window have it at one distance from their anchors."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return
    grams, keys = window_keys(data, length)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    whole = np.zeros(len(data) + 1, np.int64)  # where a window lies inside one text
    np.add.at(whole, begins[sizes >= length], 1)
    np.add.at(whole, ends[sizes >= length] - length + 1, -1)
    inside = np.cumsum(whole)[: len(keys)] > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | (keys[1:] != keys[:-1])
    last[:-1] &= ~inside[1:] | (keys[1:] != keys[:-1])
    starts, counts = np.flatnonzero(first), np.flatnonzero(last) - np.flatnonzero(first) + 1
    parts = -(-counts // length)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, counts = np.repeat(starts, parts) + at * length, np.minimum(np.repeat(counts, parts) - at * length, length)
    owner = np.searchsorted(ends, starts, "right")
    view = memoryview(data)
    for t, s, n, key, begin in zip(owner.tolist(), starts.tolist(), counts.tolist(), keys[starts].view(np.int64).tolist(), begins[owner].tolist(), strict=True):
        own = grams[s : s + n + length - GRAM]  # the least of these is the key
        anchor = int(own.argmin())
        if int(own[::-1].argmin()) != len(own) - 1 - anchor:
            anchor = -1
        yield t, s - begin, n, anchor, key, xxhash.xxh3_128_digest(view[s : s + n + length - 1])


def _chunks(texts: list[bytes], length: int, size: int = 1 << 19) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, part) of about size bytes; a long text comes in parts that overlap, so that each of its
    windows is in one part."""
    group, held = [], 0
    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text[at : at + size + length - 1] if len(text) > size else text
            group.append((t, at, part))
            held += len(part)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def _runner(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            names = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
            for group in _chunks(texts, length):
                rows = [(names[group[g][0]], key, piece, group[g][1] + s, n, anchor) for g, s, n, anchor, key, piece in text_runs([p for _, _, p in group], length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_RUNS), _RUNS, strict=True)], schema=_RUNS)

    return run


def _cutter(length: int):
    """The bytes of the runs that are asked for (wanted) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=100):
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                rows = [(w["key"], w["piece"], w["anchor"], raw[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def repeated_starts(strings: list[bytes], anchors: np.ndarray, length: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of all length bytes of strings that another string holds at the same distance from its anchor.

    The strings' bytes go into a file, column by column from the right, which is then read once from one end to the other.
    Round by round one column is put before the suffixes: a stable sort by the new byte of the order before is their new
    order, and the common prefix of two neighbours is one more than the least between the places that they had before.
    Strings enter where they end, as empty suffixes, and leave behind their first byte."""
    sizes = np.array([len(s) for s in strings])
    last, width = int((sizes - anchors).max()), int(anchors.max() + (sizes - anchors).max())
    left = width - last - anchors  # a string's first column
    table = np.zeros((len(strings), width), np.uint8)
    at = np.arange(width)
    table[(at >= left[:, None]) & (at < (left + sizes)[:, None])] = np.frombuffer(b"".join(strings), np.uint8)
    path = os.path.join(folder, "columns")
    np.ascontiguousarray(table.T[::-1]).tofile(path)
    del table
    by_end = np.argsort(-(left + sizes), kind="stable")
    enter = np.searchsorted(-(left + sizes)[by_end], -np.arange(width, 0, -1), "right")  # how many are in from each column on
    order, common, begun, found = np.zeros(0, np.int64), np.zeros(0, np.int16), 0, []
    with open(path, "rb") as columns:
        for column in range(width - 1, -1, -1):
            new = by_end[begun : enter[width - 1 - column]]
            begun = enter[width - 1 - column]
            order = np.concatenate([new, order])
            common = np.concatenate([np.zeros(len(new), np.int16), common])
            byte = np.fromfile(columns, np.uint8, len(strings))[order]
            if not len(order):
                continue
            by_byte = np.argsort(byte, kind="stable")
            least = np.minimum.reduceat(np.append(common[1:], np.int16(0)), by_byte)  # between a place and the next of its byte
            byte = byte[by_byte]
            common = np.zeros(len(order), np.int16)
            common[1:] = np.where(byte[1:] == byte[:-1], least[:-1] + 1, 0)
            order = order[by_byte]
            shared = common >= length
            shared[:-1] |= shared[1:]
            own = order[shared]
            found.append((own, column - left[own]))
            stay = left[order] < column
            if not stay.all():  # the common prefix of two that stay is the least of those between them
                kept = np.flatnonzero(stay)
                order = order[kept]
                common = np.minimum.reduceat(common[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else common[:0]
                common[:1] = 0
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _marker(length: int):
    def run(table: pa.Table) -> pa.Table:
        with tempfile.TemporaryDirectory() as folder:
            owner, start = repeated_starts(table.column("bytes").to_pylist(), table.column("anchor").to_numpy(), length, folder)
        by_place = np.lexsort((start, owner))
        owner, start = owner[by_place], start[by_place]
        breaks = np.flatnonzero((np.diff(owner) != 0) | (np.diff(start) != 1)) + 1 if len(owner) else np.zeros(0, np.int64)
        first = np.append(0, breaks)[: len(owner)]
        final = np.append(breaks, len(owner))[: len(first)] - 1
        named = table.select(["key", "piece"]).take(pa.array(owner[first]))
        return pa.table([named.column(0), named.column(1), pa.array(start[first], pa.int32()), pa.array(start[final], pa.int32())], schema=_MARKS)

    return run


def _windower(length: int):
    schema = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("at", pa.int32()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 18):
            for i, raw in enumerate(batch.column("bytes").to_pylist()):
                view, n = memoryview(raw), len(raw) - length + 1
                named = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for c in ("key", "piece")]
                windows = [xxhash.xxh3_128_digest(view[s : s + length]) for s in range(n)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(range(n), pa.int32()), pa.array(windows, pa.binary())], schema=schema)

    return run


def _remover():
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, marks in zip(batch.column("_text").to_pylist(), batch.column("_marks").to_pylist(), strict=True):
                raw, spans = (text or "").encode(), []
                for start, end in sorted((x["start"], x["end"]) for x in marks or ()):
                    if spans and start <= spans[-1]["end"]:
                        spans[-1]["end"] = max(end, spans[-1]["end"])
                    else:
                        spans.append({"start": start, "end": end})
                cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), spans, kept))
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, schema, strict=True)]
            own = [n for n in batch.schema.names if n not in ("_text", "_marks")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *made], names=[*own, *schema.names])

    return run


def repeated_runs(docs: DataFrame, *, text_col: str = "text", length: int = 200, bucket_bytes: int = 2 << 20) -> DataFrame:
    """(text, start, end): byte ranges of texts, named by their MD5, that are covered by repeated strings of length bytes.

    Ranges of one text may touch, overlap or come again; texts without any are left out. See without_repeats."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).filter(F.octet_length("text") >= length)
    runs = written(texts.mapInArrow(_runner(length), _RUNS_DDL), "runs")
    keys = written(runs.groupBy("key").agg(F.count("*").alias("n"), F.min("anchor").alias("least")).filter("n > 1 or least < 0").select("key"), "keys")
    some, _ = split_marked(runs, F.col("key"), keys)
    some = written(some, "repeated")
    pieces = written(some.groupBy("key", "piece", "n", "anchor").agg(F.count("*").alias("copies"), F.min(F.struct("text", "start")).alias("at")), "pieces")
    groups = pieces.groupBy("key").agg(F.count("*").alias("distinct"), F.sum(F.col("n") + length - 1).alias("size"), F.min("anchor").alias("least"))
    # in text that repeats in itself equal windows need not lie alike, and a group may be too much for a task: those go window by window
    groups = groups.filter("distinct > 1 or least < 0").select("key", ((F.col("least") < 0) | (F.col("size") > bucket_bytes)).alias("apart"))
    groups = written(groups, "groups")
    equal = pieces.filter("copies > 1").select("key", "piece", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))

    wanted = pieces.join(groups, "key").groupBy("at.text").agg(F.collect_list(F.struct("key", "piece", "anchor", "at.start", "n")).alias("wanted"))
    wanted = written(wanted.withColumnRenamed("text", "name"), "wanted")
    named = texts.select(F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("name"), "text")
    named, _ = split_marked(named, F.xxhash64("name"), wanted.select(F.xxhash64("name")))
    cut = named.join(wanted, "name").select("text", "wanted").mapInArrow(_cutter(length), "key bigint, piece binary, anchor int, bytes binary")
    cut = written(cut.dropDuplicates(["key", "piece"]).join(groups, "key"), "cut")
    lined, apart = cut.filter("not apart").drop("apart"), cut.filter("apart").drop("apart")
    total = lined.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // bucket_bytes))))
    marks = written(lined.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_marker(length), _MARKS_DDL), "marks")
    windows = written(apart.mapInArrow(_windower(length), "key bigint, piece binary, at int, window binary"), "windows")
    twice = written(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "twice")
    # windows in a row become one mark: a piece has at most length of them
    row = F.row_number().over(Window.partitionBy("key", "piece").orderBy("at"))
    single = windows.join(twice, "window").select("key", "piece", "at").withColumn("run", F.col("at") - row)
    single = single.groupBy("key", "piece", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")
    marks = equal.unionByName(marks).unionByName(single)
    return some.join(marks, ["key", "piece"]).select("text", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + length).alias("end"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, bucket_bytes: int = 2 << 20) -> DataFrame:
    """id_col, n_bytes, n_removed, spans (runs of removed bytes) and kept (the bytes that stay) for each row of docs.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in this text or another.
    Strings are those of the UTF-8 of the whole texts and never reach over a text's end. kept may end inside a character.

    1. Each window of length bytes has a key, the smallest hash of its grams of 32 bytes; so equal windows share
       one. Neighbouring windows with one key are a run, known by the digest of its bytes, the piece. A run is about 85 windows.
    2. Runs whose piece occurs twice are repeated as they are: copies cost one row for each run and task.
    3. Where different pieces share a key, their bytes are fetched once each, dealt into buckets by key and lined up at the
       key's gram. Each bucket builds the order of its pieces' suffixes and their common prefixes column by column, with a
       string's last byte first (see repeated_starts). Windows whose common prefix with a neighbour has length bytes are repeated.
    4. A key with more than bucket_bytes of different pieces (a passage in very many contexts) would be too much for one task, and
       a piece that holds its key's gram twice (a pattern that repeats in itself) has no one place to line it up. The
       windows of such a key's pieces are counted one by one, by their digests, in a shuffle.
    5. What was found goes back to the runs, and from there to the texts.

    Cases: null and empty texts have no bytes; a text shorter than length stays; repeated rows lose all that is as long, as
    each has the other's strings; a null id stays null; texts of any length are read in overlapping parts and
    judged whole; an empty table gives an empty result; other columns are ignored.

    Scale: for every 85 bytes of text a row of some 50 bytes is written, and only those with a key seen twice are shuffled.
    Texts move only where bytes are fetched or removed. Joins are equi-joins on digests, which Spark splits where one is hot."""
    if length < 2 * GRAM or length > 16000:
        raise ValueError(f"length must be from {2 * GRAM} to 16000 bytes")
    found = repeated_runs(docs, text_col=text_col, length=length, bucket_bytes=bucket_bytes)
    marks = written(found.groupBy(F.col("text").alias("_name")).agg(F.collect_set(F.struct("start", "end")).alias("_marks")), "spans")
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    base = base.withColumn("_name", F.unhex(F.md5(F.encode(F.coalesce("_text", F.lit("")), "UTF-8"))))
    some, rest = split_marked(base, F.xxhash64("_name"), marks.select(F.xxhash64("_name")))
    none = F.lit(None).cast(marks.schema["_marks"].dataType)
    rows = some.join(marks, "_name", "left").select("_id", "_text", "_marks").unionByName(rest.select("_id", "_text", none.alias("_marks")))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_remover(), f"_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("_id", id_col)
