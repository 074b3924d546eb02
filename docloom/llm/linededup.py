"""Line deduplication with two Bloom filters: only suspected repeats are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, SPACE, bitmap, bits_for, drop_clashes, free_name, slices, split_marked, written

SEGMENT_BITS = 20
_SEGMENT_BYTES = 1 << (SEGMENT_BITS - 3)
_NO_CONTINUATION = bytes(range(0x80, 0xC0))
_PARTIAL = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SUSPECTS = pa.schema([("id", pa.int64()), ("key", pa.binary())])
#: Places of a dropped line in the filter of dropped lines.
_PLACES = 4


def _keys(text: bytes, least: int) -> Iterator[bytes | None]:
    """The key of each line, None if it has fewer than least code points."""
    for line in text.split(b"\n"):
        if len(line) < least:
            yield None
            continue
        key = line.strip(SPACE).translate(LOWER)
        if len(key) < least or len(key) < 4 * least and len(key.translate(None, _NO_CONTINUATION)) < least:
            yield None
        else:
            yield key


def _digests(text: bytes, least: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in _keys(text, least) if k is not None}


def _positions(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both places of each 128-bit digest in a filter of 2**bits bits."""
    halves = digests.view(np.uint64).reshape(-1, 2)
    return (halves[:, 0] >> np.uint64(64 - bits)).astype(np.uint32), (halves[:, 1] >> np.uint64(64 - bits)).astype(np.uint32)


def _seer(bits: int, least: int, fan: int):
    """Each task's own two filters, as the places set once and those set twice or more, by segment."""

    def merged(once: np.ndarray, twice: np.ndarray, pending: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new, counts = np.unique(np.concatenate(pending), return_counts=True)
        again = np.concatenate([new[counts > 1], np.intersect1d(new, once, assume_unique=True)])
        return np.union1d(once, new), np.union1d(twice, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        pending, held = [], 0
        for batch in slices(batches):
            seen = [b"".join(_digests(t.encode(), least)) for t in batch.column("text").to_pylist() if t]
            pending += _positions(np.frombuffer(b"".join(seen), np.uint8).copy(), bits)
            held += 2 * len(pending[-1])
            if held > 1 << 22:
                once, twice = merged(once, twice, pending)
                pending, held = [], 0
        if pending:
            once, twice = merged(once, twice, pending)
        part = TaskContext.get().partitionId() % fan
        for s in np.unique(once >> np.uint32(SEGMENT_BITS)).tolist():
            own = [_packed(_segment(places, s)) for places in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in own)], schema=_PARTIAL)

    return run


def _segment(places: np.ndarray, segment: int) -> np.ndarray:
    lo, hi = np.searchsorted(places, [segment << SEGMENT_BITS, (segment + 1) << SEGMENT_BITS])
    return places[lo:hi] & np.uint32((1 << SEGMENT_BITS) - 1)


def _packed(places: np.ndarray) -> bytes:
    """A segment's places as a list, or as bits where those are fewer bytes."""
    if 4 * len(places) < _SEGMENT_BYTES:
        return places.astype(np.uint32).tobytes()
    flags = np.zeros(1 << SEGMENT_BITS, bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < _SEGMENT_BYTES:
        return np.frombuffer(raw, np.uint32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).astype(np.uint32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment, row after row: a place is set twice if any task saw it twice, or two tasks saw it once."""
    count, segment = np.zeros(1 << SEGMENT_BITS, np.uint8), None
    for batch in batches:
        for segment, once, twice in zip(*(batch.column(c) for c in ("segment", "once", "twice")), strict=True):
            places = _unpacked(once.as_py())
            count[places] = np.minimum(count[places] + 1, 2)
            count[_unpacked(twice.as_py())] = 2
    own = [_packed(np.flatnonzero(count >= k)) for k in (1, 2)]
    yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in own)], schema=_PARTIAL)


def twice_seen(lines: DataFrame, bits: int, least: int, fan: int = 16) -> bytes:
    """The bitmap of places that two documents or more have set, 2**bits bits long.

    Tasks' filters are merged segment by segment, in fan parts first and then together, one row at a time: a task of the
    merge holds one segment, however many tasks there were."""
    ddl = "segment int, part int, once binary, twice binary"
    partial = lines.mapInArrow(_seer(bits, least, fan), ddl)
    merged = partial.groupBy("segment", "part").applyInArrow(_merge, ddl).groupBy("segment").applyInArrow(_merge, ddl)
    flags = np.zeros(1 << (bits - 3), np.uint8)
    for row in merged.select("segment", "twice").filter("length(twice) > 0").toLocalIterator():
        own = np.zeros(1 << SEGMENT_BITS, bool)
        own[_unpacked(bytes(row["twice"]))] = True
        flags[row["segment"] * _SEGMENT_BYTES : (row["segment"] + 1) * _SEGMENT_BYTES] = np.packbits(own, bitorder="little")
    return flags.tobytes()


def _at(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (flags[places >> np.uint32(3)] >> (places & np.uint32(7)).astype(np.uint8)) & 1


def _suspects(flags: np.ndarray, bits: int, raw: bytes) -> np.ndarray:
    """Which of the 16-byte digests the twice-seen filter holds."""
    a, b = _positions(np.frombuffer(raw, np.uint8).copy(), bits)
    return np.flatnonzero(_at(flags, a) & _at(flags, b))


def _suspecter(seen, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(seen.value, np.uint8)
        for batch in slices(batches):
            ids, sets = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if t and i is not None and (d := _digests(t.encode(), least)):
                    ids += [i] * len(d)
                    sets.append(b"".join(d))
            if not ids:
                continue
            raw = b"".join(sets)
            at = _suspects(flags, bits, raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[at]), pa.array([raw[16 * k : 16 * k + 16] for k in at.tolist()], pa.binary())], schema=_SUSPECTS)

    return run


def _pair_places(ids: np.ndarray, digests: bytes, bits: int) -> np.ndarray:
    """The _PLACES places of each (id, digest) pair in a filter of 2**bits bits, one row each."""
    raw = np.ascontiguousarray(ids, np.int64).tobytes()
    pairs = b"".join(xxhash.xxh3_128_digest(raw[8 * k : 8 * k + 8] + digests[16 * k : 16 * k + 16]) for k in range(len(ids)))
    halves = np.frombuffer(pairs, np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        steps = halves[:, :1] + np.arange(_PLACES, dtype=np.uint64)[None] * (halves[:, 1:] | np.uint64(1))
    return (steps >> np.uint64(64 - bits)).astype(np.uint32)


def _pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            ids = batch.column("id").to_numpy()
            yield ids, _pair_places(ids, b"".join(batch.column("key").to_pylist()), bits)


def _placer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, places in _pairs(batches, bits):
            yield pa.RecordBatch.from_arrays([pa.array(places.ravel().astype(np.int64))], names=["place"])

    return run


def _doubter(lost, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(lost.value, np.uint8)
        for ids, places in _pairs(batches, bits):
            yield pa.RecordBatch.from_arrays([pa.array(ids[_at(flags, places).all(1)])], names=["id"])

    return run


def lost_lines(gone: DataFrame, bits: int) -> bytes:
    """A filter of 2**bits bits of the (id, key) pairs that are dropped; at most 2**(MOST_BITS - 3) bytes come to the driver."""
    flags, run = np.zeros(1 << (bits - 3), np.uint8), 1 << 12
    for row in bitmap(gone.mapInArrow(_placer(bits), "place bigint"), F.col("place")).toLocalIterator():
        at, part = (row["bucket"] - 1) * run, np.frombuffer(bytes(row["bitmap"]), np.uint8)
        flags[at : at + run] = part[: len(flags) - at]
    return flags.tobytes()


def _line_dropper(schema: pa.Schema, text_at: int, id_at: int, least: int, doomed):
    """Tasks that drop lines: doomed(ids, digests of their lines) -> which digests go. Adds n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_at).to_pylist()
            ids = batch.column(id_at).cast(pa.int64()).to_pylist()
            sets = [_digests(t.encode(), least) if t and i is not None else () for t, i in zip(texts, ids, strict=True)]
            gone = doomed(batch, np.array([i for i, d in zip(ids, sets, strict=True) for _ in d], np.int64), sets)
            n_lines, n_dropped = [], []
            for n, text in enumerate(texts):
                lines = (text or "").encode().split(b"\n")
                n_lines.append(len(lines))
                n_dropped.append(0)
                if gone[n]:
                    stay = [x for x, k in zip(lines, _keys(text.encode(), least), strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone[n]]
                    texts[n], n_dropped[n] = b"\n".join(stay).decode(), len(lines) - len(stay)
            columns = [batch.column(k) for k in range(len(schema) - 2)] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            if any(n_dropped):
                columns[text_at] = pa.array(texts, schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _by_filters(seen, bits: int, lost, lost_bits: int):
    """Lines that the twice-seen filter suspects and the filter of dropped lines holds."""

    def doomed(batch, ids: np.ndarray, sets) -> list[set]:
        out = [set() for _ in sets]
        if not len(ids):
            return out
        raw = b"".join(b"".join(d) for d in sets)
        at = _suspects(np.frombuffer(seen.value, np.uint8), bits, raw)
        picked = b"".join(raw[16 * k : 16 * k + 16] for k in at.tolist())
        places = _pair_places(ids[at], picked, lost_bits) if len(at) else np.zeros((0, _PLACES), np.uint32)
        owner = np.repeat(np.arange(len(sets)), [len(d) for d in sets])[at]
        for n in np.flatnonzero(_at(np.frombuffer(lost.value, np.uint8), places).all(1)).tolist():
            out[owner[n]].add(picked[16 * n : 16 * n + 16])
        return out

    return doomed


def _by_keys(keys_at: int):
    """Lines whose keys a join has put beside the text."""
    return lambda batch, ids, sets: [{bytes(k) for k in x} if x else set() for x in batch.column(keys_at).to_pylist()]


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, bits: int | None = None) -> DataFrame:
    """docs with repeated lines removed from text_col, and n_lines (before) and n_dropped.

    Texts are split at \\n; a line's key is the line without white space at its ends and with A-Z lower-cased. Keys of
    at least least code points that two documents or more hold lose all their lines except in the document with the
    smallest id that holds them.

    1. Each task keeps two Bloom filters of 2**bits bits and two hashes, for keys seen once and seen twice by different
       documents; merging two tasks' filters sets a twice-seen place where both have it once. bits follows the number of
       lines (see bits_for), up to 256 MB.
    2. The merged twice-seen filter goes to all tasks. Keys that it holds are suspects; only these are shuffled (128-bit
       digests) and counted exactly. A fuller filter lets more keys be suspected; it never loses one.
    3. The lines to drop go to all tasks as a filter of (id, key) pairs, sized like the first, so that texts stay where
       they are read. It is checked against every suspect that must stay: documents with a suspect that it holds by
       mistake take their keys from an exact join instead. A fuller filter sends more documents there.

    Cases: a null or empty text is one empty line and stays as it is; rows with a null id lose nothing and make no
    line a repeat; rows that share an id are one document; repeated lines inside one document only all stay; columns named n_lines or
    n_dropped are replaced; an empty table gives an empty result."""
    text, own_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("bigint")
    base = docs.select(own_id.alias("id"), text.alias("text"))
    context = docs.sparkSession.sparkContext
    if bits is None:
        lines = base.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"]
        bits = bits_for(lines or 0, SEGMENT_BITS)
    seen = context.broadcast(twice_seen(base.filter("id is not null").select("text"), bits, least))
    suspects = written(base.mapInArrow(_suspecter(seen, bits, least), "id bigint, key binary"), "suspects")
    confirmed = suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("key", "first")
    confirmed = written(confirmed, "confirmed")  # apart from the join below, so that Spark can split a line that very many documents hold
    judged = written(suspects.join(confirmed, "key", "left").select("id", "key", F.coalesce(F.col("first") != F.col("id"), F.lit(False)).alias("gone")), "judged")
    gone, stay = judged.filter("gone").select("id", "key"), judged.filter("not gone").select("id", "key")
    lost_bits = bits_for(gone.count())
    lost = context.broadcast(lost_lines(gone, lost_bits))
    doubtful = written(stay.mapInArrow(_doubter(lost, lost_bits), "id bigint").distinct(), "doubtful")

    plain = drop_clashes(docs, "n_lines", "n_dropped")
    names = plain.columns
    result = T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(result)
    text_at, id_at = names.index(text_col), names.index(id_col)
    some, rest = split_marked(plain, own_id, doubtful)
    done = rest.mapInArrow(_line_dropper(arrow, text_at, id_at, least, _by_filters(seen, bits, lost, lost_bits)), result)
    key, keys = free_name(plain, "id"), free_name(plain, "keys")
    lines, _ = split_marked(gone, F.col("id"), doubtful)  # the same bitmap: the lines of all documents in some, also of those that fell there by a collision
    exact = lines.groupBy(F.col("id").alias(key)).agg(F.collect_set("key").alias(keys))
    some = some.join(exact, own_id == F.col(key), "left").select(*[F.col(f"`{c}`") for c in names], keys)
    return done.unionByName(some.mapInArrow(_line_dropper(arrow, text_at, id_at, least, _by_keys(len(names))), result))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with line_dedup's texts (and n_chars, if docs has it); documents that lose all their words go."""
    out = line_dedup(docs, id_col=id_col, text_col=text_col, **how)
    words = F.regexp_like(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]"))
    out = out.filter((F.col("n_dropped") == 0) | words).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"`{text_col}`").isNotNull(), F.length(f"`{text_col}`").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
