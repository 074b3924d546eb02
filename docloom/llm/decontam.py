"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, each text scanned once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, split_marked, written

#: Bytes outside words become a space, A-Z become a-z: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: What goes from one scan to the next: hit words as runs of word numbers, and the items found.
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_BETWEEN = pa.schema([("id", pa.int64()), ("text", pa.string()), ("runs", _RUNS), ("items", pa.list_(pa.string()))])
_BETWEEN_DDL = "id bigint, text string, runs array<struct<start: bigint, end: bigint>>, items array<string>"
_OUT = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_DDL = "id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"
_built: dict[str, tuple] = {}


def normal(text: bytes) -> bytes:
    """b" w1 w2 ... wn " or b" " without words."""
    words = text.translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def _normaliser():
    schema = pa.schema([("item", pa.string()), ("flat", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([normal(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], schema=schema)

    return run


def _automaton(block, name: str, width: int) -> tuple[ahocorasick.Automaton, list[list[tuple[int, int]]], list[str], list[list[bytes]]]:
    """Built once in each worker, for the items sent last: the automaton, for each of its patterns the (item, first word) that
    it stands for, and the items' names and words.

    Windows overlap, so the automaton holds every half-window of an item that begins at a multiple of its length: each window
    holds one of those. Items with fewer words than a window are patterns as a whole."""
    if name not in _built:
        _built.clear()
        names, words = [n for n, _ in block.value], [flat.split() for _, flat in block.value]
        half, number, owners, automaton = (width + 1) // 2, {}, [], ahocorasick.Automaton()
        for i, own in enumerate(words):
            step = half if len(own) >= width else len(own)
            for p in range(0, len(own) - step + 1, step):
                pattern = b" " + b" ".join(own[p : p + step]) + b" "
                k = number.setdefault(pattern, len(owners))
                if k == len(owners):
                    owners.append([])
                    automaton.add_word(pattern.decode("latin-1"), (k, step))
                owners[k].append((i, p))
        if owners:
            automaton.make_automaton()
        _built[name] = automaton, owners, names, words
    return _built[name]


def _hits(flat: bytes, built: tuple, width: int) -> tuple[list[tuple[int, int]], set[str]]:
    """The runs of words (from, to) that windows of items cover, and those items. From each pattern that occurs, the run on which
    text and item agree is followed to both sides; it counts if it is as long as a window, or is a whole shorter item."""
    automaton, owners, names, words = built
    found = list(automaton.iter(flat.decode("latin-1"))) if owners else []
    if not found:
        return [], set()
    # the space that ends word i (from 1) is space number i: its rank gives the last word of a match
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
    ends = np.searchsorted(spaces, np.array([e for e, _ in found])).tolist()
    own, known, runs, items = flat.split(), {}, [], set()
    for end, (_, (k, step)) in zip(ends, found, strict=True):
        start = end - step
        for i, p in owners[k]:
            item, key = words[i], (i, start - p)
            if known.get(key, 0) >= end:
                continue  # on a run that was followed from an earlier pattern
            low, high = 0, step
            if len(item) >= width:
                while low < min(p, start) and own[start - low - 1] == item[p - low - 1]:
                    low += 1
                while p + high < len(item) and start + high < len(own) and own[start + high] == item[p + high]:
                    high += 1
                known[key] = start + high
            if low + high >= min(width, len(item)):
                runs.append((start - low, start + high))
                items.add(names[i])
    return runs, items


def _scanner(block, name: str, width: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _automaton(block, name, width)
        schema = _OUT if last else _BETWEEN
        for batch in slices(batches):
            rows = []
            for text, runs, items in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "items")), strict=True):
                flat = normal(text.encode()) if text else b" "
                more, which = _hits(flat, built, width)
                runs, items = [(r["start"], r["end"]) for r in runs] + more, sorted(which.union(items))
                if not last:
                    rows.append((text, [{"start": a, "end": b} for a, b in sorted(set(runs))], items))
                    continue
                n = flat.count(b" ") - 1
                edge = np.zeros(n + 1, np.int64)
                for start, end in runs:
                    edge[start] += 1
                    edge[end] -= 1
                hit = np.cumsum(edge)[:-1] > 0
                rows.append((n, int(hit.sum()), items, _original(text, hit) if runs else []))
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * (len(schema) - 1), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], schema=schema)

    return run


def _original(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point spans of the original text."""
    out, before = [], False
    for m, h in zip(_WORD.finditer(text), hit.tolist(), strict=True):
        if h and before:
            out[-1]["end"] = m.end()
        elif h:
            out.append({"start": m.start(), "end": m.end()})
        before = h
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    automaton_bytes: int = 64 << 20,
) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated.

    Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is width consecutive
    words of an item, or the whole item if it has fewer. A word of a document inside any occurrence of a window is hit;
    spans are the runs of hit words, as code points of the original text.

    The automaton holds half-windows of the items (see _automaton), some 30 times the items' bytes in memory; from each that
    occurs, text and item are compared to both sides. Items are normalised in Spark and sent to the tasks in blocks of at
    most automaton_bytes (and one item more). A benchmark of one block, as nearly all are, takes one scan of the texts, which stay
    where they are read. A larger one takes a scan for each block, one after another over written tables, so that driver
    and workers hold one block at a time: no item is refused, and the result is the same.

    Cases: null or empty texts have no words; items without words have no window; items that share an item_col value
    are one item; null item ids are left out; repeated rows are scanned alike; an empty benchmark hits nothing; an empty table gives
    an empty result; other columns are ignored."""
    chosen = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text")).filter("item is not null and text is not null")
    flats = written(chosen.mapInArrow(_normaliser(), "item string, flat binary").distinct().filter("octet_length(flat) > 1"), "items")
    total = flats.agg(F.sum(F.octet_length("flat"))).first()[0] or 0
    blocks = max(1, -(-total // automaton_bytes))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("runs", F.array().cast("array<struct<start: bigint, end: bigint>>")).withColumn("items", F.array().cast("array<string>"))
    context = docs.sparkSession.sparkContext
    for n in range(blocks):
        block = flats.filter(F.pmod(F.xxhash64("item", "flat"), F.lit(blocks)) == n).orderBy("item", "flat").collect()  # about automaton_bytes
        sent, last = context.broadcast([(r["item"], bytes(r["flat"])) for r in block]), n == blocks - 1
        out = rows.mapInArrow(_scanner(sent, uuid.uuid4().hex, width, last), _DDL if last else _BETWEEN_DDL)
        rows = out if last else written(out, "scanned")
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated")
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs without a hit, as they are. Rows that share an id go together; a null id is an id of its own."""
    key, own_id = free_name(docs, "hit"), F.col(f"`{id_col}`").cast("bigint")
    bad = contamination(docs, benchmark, id_col=id_col, **how).filter("contaminated").select(F.col(id_col).alias(key)).distinct()
    bad = written(bad, "contaminated")
    some, rest = split_marked(docs, own_id, bad)  # only rows that may go are shuffled
    return rest.unionByName(some.join(bad, own_id.eqNullSafe(F.col(key)), "left_anti"))
