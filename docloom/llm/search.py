"""Ranked lexical search by NRA (Fagin, Lotem and Naor, 2001): impact-sorted lists read in sequence, with score intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

#: Bytes outside terms become a space, A-Z become a-z: terms are [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_POSTINGS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_HITS = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _termer():
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary()), ("q", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms, counts = np.unique(np.array(text.encode().translate(_TABLE).split(), object), return_counts=True) if text else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(list(terms), pa.binary()), pa.array(counts, pa.int64())], schema=schema)

    return run


def _poster(vocabulary):
    """Each text's number of terms, and its terms of the vocabulary with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in slices(batches):
            sizes, terms, tfs, cuts = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = text.encode().translate(_TABLE).split() if text else []
                found = np.fromiter((number(w, -1) for w in words), np.int32, len(words))
                own, tf = np.unique(found[found >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(own)
                tfs.append(tf.astype(np.int32))
                cuts.append(cuts[-1] + len(own))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(x).astype(np.int32), pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], schema=_POSTINGS)

    return run


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, floor: int = 0) -> list[tuple[int, int]]:
    """The k best (score, document number) of one query, more where they tie at the end, all with scores of at least floor.

    lists: for each term the numbers of its documents and their contributions, largest first. Every round reads each list
    on down to a lower limit. A document's lower score is what was read of it; its upper score adds, for each term
    that it was not read for, the next contribution of that term's list. Reading ends when no document outside the best
    can reach the k-th lower score, and all that can have equal lower and upper scores."""
    lower, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    read = [0] * len(lists)
    limit = max((int(c[0]) for _, c in lists if len(c)), default=0)
    while True:
        limit //= 2
        for t, (docs, gains) in enumerate(lists):
            to = len(gains) - int(np.searchsorted(gains[::-1], limit)) if limit else len(gains)
            lower[docs[read[t] : to]] += gains[read[t] : to]
            read[t] = max(to, read[t])
        ahead = [int(gains[r]) if r < len(gains) else 0 for r, (_, gains) in zip(read, lists, strict=True)]
        seen[:] = 0
        for (docs, _), r, a in zip(lists, read, ahead, strict=True):
            if a:
                seen[docs[:r]] += a
        least = floor
        if len(ids) > k:
            least = max(least, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
        upper = lower + (sum(ahead) - seen)
        may = np.flatnonzero((upper >= max(least, 1)))  # unread documents are among them while they can still reach it
        if (upper[may] == lower[may]).all():
            return [(int(lower[d]), int(d)) for d in may]


def _ranker(queries, weights, totals: tuple[int, int], k: int, postings: int):
    """The k best documents of each query among those of a partition, in parts of about so many postings. What earlier
    parts found is the floor for later ones."""

    def part(rows: list[pa.RecordBatch], best: dict[int, list[tuple[int, int]]]) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
        terms, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        docs = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
        m = 25 + 75 * n * totals[0] // totals[1]
        gain = weights.value[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
        order = np.lexsort((-gain, terms))  # by term, largest contribution first
        terms, docs, gain = terms[order], docs[order], gain[order]
        begin, end = (np.searchsorted(terms, np.arange(len(weights.value)), side) for side in ("left", "right"))
        for query, own in queries.value:
            found = best.setdefault(query, [])
            lists = [(docs[begin[t] : end[t]], gain[begin[t] : end[t]] * q) for t, q in own if begin[t] < end[t] and gain[begin[t]] > 0]
            if lists:
                new = nra(lists, ids, k, found[-1][0] if len(found) == k else 0)
                best[query] = sorted(found + [(s, int(ids[d])) for s, d in new], key=lambda x: (-x[0], x[1]))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows, held = {}, [], 0
        for batch in batches:
            rows.append(batch)
            held += len(batch.column("terms").flatten()) + batch.num_rows
            if held >= postings:
                part(rows, best)
                rows, held = [], 0
        if rows:
            part(rows, best)
        flat = [(query, i, score) for query, found in best.items() for score, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else ((), (), ()))], schema=_HITS)

    return run


def weight(documents: int, df: Column) -> Column:
    """A term's weight by the number of documents that hold it."""
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * df + 1))).cast("bigint")


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
    block_terms: int = 1_000_000,
    part_postings: int = 2_000_000,
) -> DataFrame:
    """The k highest-scoring rows of docs for each row of queries: item_col, rank (from 1), id_col and score.

    Terms are the runs of bytes that are no ASCII signs or spaces, with A-Z lower-cased. N counts the documents with a term,
    L all their terms, n one document's, df the documents that hold a term, tf its occurrences in one. A document scores the sum
    over the query's terms, repeats included, of w * (1000000000 * tf div (1000 * tf + 8 * m)), where w is
    floor(1000 * ln((2N + 2) / (2df + 1))) and m is 25 + 75 * n * N div L. Only scores above 0 are ranked; ties go to the smaller id.

    1. Queries are dealt into blocks of about block_terms terms, so that what is sent to the tasks (a block's vocabulary
       and its weights) has a bound; nearly always there is one block. A single query's terms stay together.
    2. One scan of the texts counts their terms of the vocabulary, and N, L and df are summed from that.
    3. Each task makes impact-sorted lists of parts of its documents and reads them by NRA (see nra). A part's floor is
       what the parts before it reached. A task returns k rows for each query at most; those are ranked over all tasks.

    Cases: null and empty texts have no terms; queries without terms, or with none that a document holds, have no rows; rows that share
    an id are documents of their own, and so are null ids, which rank behind all others; queries that share an id are ranked
    each, as one list of rows for each; ties go by id; empty tables give an empty result; other columns are ignored.

    Scale: texts and postings are read where they lie; only df, and k rows for each query and task, are shuffled."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_NULL)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    items = written(queries.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("name"), F.col(f"`{item_text_col}`").alias("text")), "items")
    terms = written(items.select("item", "text").mapInArrow(_termer(), "item bigint, term binary, q bigint"), "terms")
    blocks = max(1, -(-terms.count() // block_terms))
    found = [_block(spark, base, terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, part_postings) for b in range(blocks)]
    hits = found[0]
    for other in found[1:]:
        hits = hits.unionByName(other)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = ranked.join(items.select(F.col("item").alias("query"), "name"), "query")
    return named.select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != _NULL, F.col("id")).alias(id_col), "score")


_NULL = (1 << 63) - 1


def _block(spark, base: DataFrame, terms: DataFrame, k: int, part_postings: int) -> DataFrame:
    """(query, id, score): each task's best documents for the queries of one block."""
    own: dict[int, list[tuple[int, int]]] = {}
    number: dict[bytes, int] = {}
    for row in terms.collect():  # a block: about block_terms rows
        own.setdefault(row["item"], []).append((number.setdefault(bytes(row["term"]), len(number)), row["q"]))
    postings = written(base.mapInArrow(_poster(spark.sparkContext.broadcast(number)), "id bigint, n bigint, terms array<int>, tfs array<int>").filter("n > 0"), "postings")
    totals = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(1)).alias("length")).first()
    weights = np.zeros(len(number), np.int64)
    dfs = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for row in dfs.select("term", weight(totals["documents"], F.col("df")).alias("w")).collect():  # at most a row for each term of the block
        weights[row["term"]] = row["w"]
    send = spark.sparkContext.broadcast
    rank = _ranker(send(sorted(own.items())), send(weights), (totals["documents"], totals["length"]), k, part_postings)
    return written(postings.mapInArrow(rank, "query bigint, id bigint, score bigint"), "hits")
