"""Quality rules: cross-document line frequency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import LOWER, free_name, slices, split_marked, written
from .words import hash_words, sum_sorted, windows

SYMBOLS = b"#*$%&|<>"
#: Normalised lines: A-Z lower-cased, every digit 0, white space runs one space, none at the ends.
NORMAL = bytearray(LOWER)
for _d in b"0123456789":
    NORMAL[_d] = ord("0")
NORMAL = bytes(NORMAL)
_NO_CONTINUATION = bytes(range(0x80, 0xC0))
_WHITE = re.compile(rb"[\x20\x09-\x0D]+")

_FEATURES = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("host", pa.int64()), ("content", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))]
)
_DDL = (
    "row bigint, id bigint, mark bigint, host bigint, content bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, line_words array<bigint>"
)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _line_key(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words).translate(NORMAL)))


def _repeats(hashes: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """For each text the number of words inside 3-word windows that it holds twice or more."""
    keys, first = windows(hashes, owners, 3)
    if not len(keys):
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        keys = keys + owners[first].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[first[twice] + k] = True
    return sum_sorted(owners[covered], n)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
        n = len(texts)
        hashes, owners = hash_words(texts)
        n_words, repeats = sum_sorted(owners, n), _repeats(hashes, owners, n)
        chars, symbols, dups, content, lines, line_words = [], [], [], [], [], []
        for text in texts:
            squeezed = text.translate(None, b" \t\n\x0b\x0c\r")
            chars.append(len(squeezed.translate(None, _NO_CONTINUATION)))
            symbols.append(len(squeezed) - len(squeezed.translate(None, SYMBOLS)))
            content.append(_signed(xxhash.xxh3_64_intdigest(text)))
            seen, dup, words = set(), 0, {}
            for line in text.split(b"\n"):
                parts = line.split()
                if not parts:
                    continue
                dup += line in seen
                seen.add(line)
                key = _line_key(parts)
                words[key] = words.get(key, 0) + len(parts)
            dups.append(dup)
            lines.append(list(words.keys()))
            line_words.append(list(words.values()))
        columns = [np.arange(row, row + n), batch.column("id"), batch.column("mark"), batch.column("host"), content, n_words, chars, symbols, dups, repeats, lines, line_words]
        row += n
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _FEATURES, strict=True)], schema=_FEATURES)


def _mark(host_col: str, text_col: str) -> Column:
    """What tells rows of one id apart that are judged by themselves."""
    return F.xxhash64(F.col(f"`{host_col}`"), F.lit(0), F.col(f"`{text_col}`"))


def _judged(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_docs_share: float = 0.05,
    line_docs_least: int = 10,
    line_docs_most: int = 1000,
    depleted_share: float = 0.3,
    count_copies: bool = True,
    lines: bool = False,
) -> DataFrame:
    """quality_rules' rows with id and mark; with lines also gone, the keys of the lines above the limit that a row loses."""
    base = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), _mark(host_col, text_col).alias("mark"), F.xxhash64(F.col(f"`{host_col}`")).alias("host"), F.col(f"`{text_col}`").alias("text")
    )
    rows = written(base.mapInArrow(_features, _DDL), "quality")
    # What counts as one document: its text, or its id (a row, if that is null).
    unit = F.struct("id", F.when(F.col("id").isNull(), F.col("row")).alias("row")) if count_copies else F.col("content")
    rows = rows.withColumn("unit", unit)
    held = rows.select("row", "id", "host", "unit", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "id", "host", "unit", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words")
    )
    hosts = rows.groupBy("host", "unit").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    counted = (
        held.groupBy("host", "line", "unit").agg(F.min("id").alias("first"))
        .groupBy("host", "line").agg(F.count("*").alias("line_docs"), F.min("first").alias("first"))
        .filter(F.col("line_docs") > line_docs_least)
    )
    frequent = (F.col("line_docs") > line_docs_share * F.col("host_docs")) | (F.col("line_docs") > line_docs_most)
    above = counted.join(hosts, "host").filter(frequent).select("host", "line", "first")
    above = written(above, "lines")  # apart from the join below, so that Spark can split a line that very many documents hold
    removed = (
        held.join(above, ["host", "line"])
        .filter(F.col("id").isNull() | F.col("first").isNull() | (F.col("id") != F.col("first")))
        .groupBy("row").agg(F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"), *([F.collect_list("line").alias("gone")] if lines else []))
    )
    out = rows.drop("lines", "line_words", "host", "content", "unit").join(removed, "row", "left").drop("row").fillna(0, ["removed_lines", "removed_words"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < depleted_share * F.col("n_words")
    return (
        out.withColumn("base_failed", failed).withColumn("depleted", depleted)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", **rules) -> DataFrame:
    """One row for each row of docs: its statistics, what line frequency takes from it, and the verdict.

    Lines are normalised (see NORMAL) and hashed. For each host and line the distinct documents (ids) are counted; with
    count_copies off, exact copies of a text count as one. A line in more than line_docs_least documents is above the
    limit if these are more than line_docs_share of its host's documents, or more than line_docs_most whatever the host's
    size: it is removed from all of them but the one with the smallest id, which keeps one instance of what the others
    repeat. A document left with less than depleted_share of its words is depleted. cleaned() gives the texts without
    these lines; rules are _judged's parameters.

    Columns: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_lines,
    removed_words, depleted, kept. Cases: a null or empty text has no words and so fails the base rules; a null host
    is a host of its own; rows with a null id count as documents but are never the one that keeps a line; repeated
    rows are judged alike; an empty table gives an empty result; other columns of docs are ignored.

    Scale: the text goes through Python once and is never shuffled. The statistics and line hashes are written to the
    shared folder; counting shuffles hashes only, with partial sums for lines that many documents hold."""
    return _judged(docs, id_col=id_col, **rules).drop("mark").withColumnRenamed("id", id_col)


@F.pandas_udf(StringType())
def _without_lines(texts: pd.Series, keys: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, keys, strict=True):
        if text is None or gone is None:
            out.append(None)
            continue
        gone = set(gone.tolist())
        out.append("\n".join(line for line in text.split("\n") if not (words := line.encode().split()) or _line_key(words) not in gone))
    return pd.Series(out, dtype=object)


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", kept_only: bool = False, **rules) -> DataFrame:
    """docs with each row's lines above the limit (see quality_rules) removed from text_col, and n_chars of what stays
    if docs has it; with kept_only, without the rows that the rules reject.

    Other lines, and texts that lose nothing, stay as they are. Rows are told apart by id, host and text. Only rows that
    may go or lose a line are shuffled with their texts (see split_marked); the others pass where they are read."""
    judged = _judged(docs, id_col=id_col, text_col=text_col, host_col=host_col, lines=True, **rules)
    concerned = F.col("gone").isNotNull() | ~F.col("kept") if kept_only else F.col("gone").isNotNull()
    key, mark, gone, new, kept = (free_name(docs, n) for n in ("id", "mark", "gone", "new", "kept"))
    judged = judged.filter(concerned).select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("gone").alias(gone), F.col("kept").alias(kept))
    judged = written(judged.dropDuplicates([key, mark]), "judged")
    own_id, own_mark, text = F.col(f"`{id_col}`").cast("bigint"), _mark(host_col, text_col), F.col(f"`{text_col}`")
    some, rest = split_marked(docs, F.xxhash64(own_id, own_mark), judged.select(F.xxhash64(key, mark)))
    out = some.join(judged, own_id.eqNullSafe(F.col(key)) & (own_mark == F.col(mark)), "left")
    out = out.filter(F.coalesce(kept, F.lit(True))) if kept_only else out
    out = out.withColumn(new, _without_lines(F.when(F.col(gone).isNotNull(), text), F.col(gone)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new).cast("bigint")).otherwise(F.col("n_chars")))
    out = out.withColumn(text_col, F.coalesce(new, text))
    return rest.unionByName(out.select(*[F.col(f"`{c}`") for c in docs.columns]))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality_rules keeps, without their lines above the limit."""
    return cleaned(docs, kept_only=True, **how)
