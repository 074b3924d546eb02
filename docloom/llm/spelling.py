"""Spelling variants: words one edit apart, found through a reduced alphabet, and the frequent forms they belong to."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: The letters of a word: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_ALPHABET = [*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))]
_UPPER, _LOWER = "".join(map(chr, range(0x41, 0x5B))), "".join(map(chr, range(0x61, 0x7B)))


def reduced(word: Column, symbols: int) -> Column:
    """word with each letter hashed to one of symbols letters. Words one edit apart have equal forms, or forms one edit apart."""
    return F.translate(word, "".join(_ALPHABET), "".join(chr(0x61 + zlib.crc32(c.encode()) % symbols) for c in _ALPHABET))


def _neighbours(symbols: int):
    """Batches of (form, around): all strings over the reduced alphabet at most one edit from a form, once each."""
    letters = np.arange(0x61, 0x61 + symbols, dtype=np.uint8)
    schema = pa.schema([("form", pa.string()), ("around", pa.string())])

    def strings(forms: pa.Array, made: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
        """made: for each form (first axis) its strings (last axis); kept: which of them."""
        kept = np.broadcast_to(kept, made.shape[:-1])
        rows, owner = made[kept], np.nonzero(kept)[0]
        cuts = np.arange(len(rows) + 1, dtype=np.int32) * made.shape[-1]
        around = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(rows))])
        return pa.RecordBatch.from_arrays([forms.take(pa.array(owner)), around], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1000, size=1 << 14):
            column = batch.column("form")
            lengths = np.array([len(f) for f in column.to_pylist()])
            for length in np.unique(lengths):
                forms = column.filter(pa.array(lengths == length))
                of = np.frombuffer("".join(forms.to_pylist()).encode(), np.uint8).reshape(-1, length)
                yield strings(forms, of[:, None, :], np.True_)
                before = np.pad(of, ((0, 0), (1, 0)))  # before[:, i]: the letter left of place i
                without = np.stack([np.delete(of, i, axis=1) for i in range(length)], axis=1)
                yield strings(forms, without, of != before[:, :-1])  # in a run of one letter, the first goes
                changed = np.broadcast_to(of[:, None, None, :], (len(of), length, symbols, length)).copy()
                longer = np.zeros((len(of), length + 1, symbols, length + 1), np.uint8)
                for i in range(length + 1):
                    if i < length:
                        changed[:, i, :, i] = letters
                    longer[:, i, :, :i], longer[:, i, :, i], longer[:, i, :, i + 1 :] = of[:, None, :i], letters, of[:, None, i:]
                yield strings(forms, changed, of[:, :, None] != letters)
                yield strings(forms, longer, before[:, :, None] != letters)  # a run of one letter grows at its left end

    return run


def neighbourhoods(forms: DataFrame, symbols: int) -> DataFrame:
    """(form, around) for forms (form): the full one-edit neighbourhood of each, itself among it."""
    return forms.select("form").mapInArrow(_neighbours(symbols), "form string, around string")


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, drop_every: int = 199) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough.

    A word is a run of letters with A-Z lower-cased. Where drop_every divides h, the crc32 of "<id>:<run>", the run loses
    its code point number h % length: a fixed share of misspellings, the same in every count. 0 drops nothing."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(f"`{text_col}`", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.withColumn("run", F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run"))).filter(F.length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def near_words(words: DataFrame, symbols: int = 8) -> DataFrame:
    """(word, n, other, other_n) for all pairs of words (word, n) that differ by one edit, in both directions.

    Words are grouped by their reduced form. The one-edit neighbourhood of each distinct form is joined with the
    forms that exist, and only words of forms joined so meet, in a join that keeps a pair if the original strings are one edit apart."""
    words = written(words.select("word", "n", reduced(F.col("word"), symbols).alias("form")), "words")
    forms = written(words.select("form").distinct(), "forms")
    around = neighbourhoods(forms, symbols)
    edges = written(around.join(forms.select(F.col("form").alias("around")), "around"), "edges")
    first = words.join(edges, "form").select("word", "n", "around")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("form").alias("around"))
    # part of the join's own condition, so that candidates are compared where they meet and never become rows
    on = (first["around"] == other["around"]) & (F.levenshtein(first["word"], other["other"], 1) == 1)
    return first.join(other, on).select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of each chain, by steps of doubled length. A form is at least some times
    as frequent as its word, so chains end, and the rounds are few: the logarithm of a logarithm of the largest count."""
    step = written(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def spelling_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, drop_every: int = 199, symbols: int = 8
) -> DataFrame:
    """One row for each frequent word of the texts: word, n, form, form_n, root and n_near.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
    word of largest n (ties: the smallest in code-point order) if that has at least ratio times its own n, else null; its
    root is what following forms leads to, or itself; n_near counts its near words.

    Candidates come from a reduced alphabet (see near_words). More symbols give longer neighbourhoods, of about
    2 * symbols * length strings for each distinct form, and fewer words in each form; the result is the same with any.

    Cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count each; runs of any length are
    taken whole; an empty table, or one without frequent words, gives an empty result; other columns are ignored.

    Scale: occurrences are counted with partial sums before they are shuffled, so what moves follows the vocabulary. Joins
    are plain equi-joins over written tables, which Spark splits where a form is hot. Nothing reaches the driver."""
    words = written(word_counts(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, drop_every=drop_every), "counts")
    near = near_words(words, symbols)
    best = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    best = written(best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(best.filter("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))

