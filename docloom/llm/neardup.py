"""Near-duplicate detection by min-max hashing over word shingles, with links confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, split_marked, written
from .graph import components
from .words import hash_words, mix, windows

_FEATURES = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("buckets", pa.list_(pa.int64()))])
_SETS = pa.schema([("key", pa.binary()), ("shingles", pa.list_(pa.int64()))])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; shorter texts have their whole sequence, texts without words nothing."""
    hashes, owners = hash_words(texts, lower=True)
    shingles, first = windows(hashes, owners, width)
    own = owners[first]
    cuts, word_cuts = np.searchsorted(own, np.arange(len(texts) + 1)), np.searchsorted(owners, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if cuts[i + 1] > cuts[i]:
            yield np.unique(shingles[cuts[i] : cuts[i + 1]])
        else:
            h = hashes[word_cuts[i] : word_cuts[i + 1]]
            yield windows(h, np.zeros(len(h), np.int64), len(h))[0] if len(h) else h


def _key(shingles: np.ndarray) -> bytes | None:
    """What equal sets share."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


class MinMax:
    """Signatures of bands x rows values: under each permutation both the smallest and the largest value are kept.

    For one permutation the chance that two sets agree in their minimum is their Jaccard similarity, and so it is for
    their maximum; so half as many permutations as values are evaluated. Pairs of similarity s share one of the bands
    with a chance of 1 - (1 - s**rows)**bands."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even: each permutation gives two values")
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 2**63, n, dtype=np.uint64)[:, None]
        self.mul = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.order = rng.permutation(2 * n)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        n = len(self.xor)
        low, high = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
        step = 8192
        for at in range(0, len(shingles), step):
            part = shingles[None, at : at + step]
            for k in range(0, n, 16):
                v = (part ^ self.xor[k : k + 16]) * self.mul[k : k + 16]
                v ^= v >> np.uint64(32)
                np.minimum(low[k : k + 16], v.min(1), out=low[k : k + 16])
                np.maximum(high[k : k + 16], v.max(1), out=high[k : k + 16])
        return np.concatenate([low, high])

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        values = self.signature(shingles)[self.order].reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.rows):
            h = mix(h ^ values[:, k]) + np.uint64(k)
        return h.view(np.int64)


def _featurer(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(bands, rows)
        for batch in slices(batches):
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            n, keys, buckets = [], [], []
            with np.errstate(over="ignore"):
                for s in _sets(texts, width):
                    n.append(len(s))
                    keys.append(_key(s))
                    buckets.append(hashing.buckets(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, _FEATURES.field(3).type)], schema=_FEATURES)

    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(_sets([t.encode() if t else b"" for t in batch.column("text").to_pylist()], width))
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.binary()), pa.array([np.sort(s.view(np.int64)) for s in sets], _SETS.field(1).type)], schema=_SETS)

    return run


def _linker(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between different components inside one cell; one for each row and component is enough."""
        ids, comps = table.column("node").to_numpy(), table.column("comp").to_numpy()
        outer, inner, below = (table.column(c).to_numpy(zero_copy_only=False) for c in ("outlier", "inner", "below"))
        lists = table.column("shingles").combine_chunks()
        values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(cuts)
        owner = np.repeat(np.arange(len(ids)), sizes)
        values = values[cuts[0] : cuts[-1]]
        us, vs = [], []
        for i in np.flatnonzero(outer):
            own = values[cuts[i] - cuts[0] : cuts[i + 1] - cuts[0]]
            fit = (comps != comps[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            if not inner[i]:
                fit &= ~outer
            if below[i]:
                fit &= ~below
            if not fit.any():
                continue
            take = fit[owner]
            at = np.searchsorted(own, values[take])
            at[at == len(own)] = 0
            both = np.bincount(owner[take], own[at] == values[take], minlength=len(ids))
            linked = np.flatnonzero(fit & (100 * both >= percent * (sizes + sizes[i] - both)))
            linked = linked[np.unique(comps[linked], return_index=True)[1]]
            us += [ids[i]] * len(linked)
            vs += ids[linked].tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())}, schema=_LINKS)

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 42,
    rows: int = 6,
    block: int = 256,
) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id and kept (id_col = component_id).

    Texts are lower-cased (A-Z) and cut into words [^\\x20\\x09-\\x0D]+; a document's set holds its distinct shingles of
    width words, or its whole sequence if it has fewer. Documents link when 100 * intersection >= percent * union, and
    component_id is the smallest id reachable over links.

    1. Equal sets are one class, so copies cost one row, whatever their number.
    2. Min-max signatures (see MinMax) put classes into bands x buckets. With the defaults a pair at the threshold of
       0.8 is missed with a chance of 3e-6.
    3. Each bucket's anchor is its member that shares most buckets. Members are confirmed against their anchors on full
       sets; linked ones form components. In a group of near copies the anchor is nearly always the text that the
       others were made from, so this finds almost every link with one comparison a row.
    4. Members of one bucket that still lie in different components are compared on full sets, whatever their number:
       all outside an anchor's largest component against each other and against those inside. They are dealt by set
       size first, since only sets of similar size can link, and then into cells of at most 2 x block rows (fewer if
       their sets are large, more in groups of more than 64 x block rows). No pairs are emitted but links, and no group is gathered into one task.

    Cases: texts that are null, empty or without words have the empty set and link with nothing; rows with a null id
    link with nothing, have a null component_id and are kept; rows that share an id are one document, which links with
    whatever one of its texts does (each row has its own n_shingles); ties go to the smallest id; an empty table gives
    an empty result; other columns are ignored.

    Scale: only hashes are shuffled. The texts of candidate classes are picked out where they are read, by a bitmap.
    Joins on hot classes or anchors are plain equi-joins, which Spark splits when a partition is skewed."""
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    feats = written(base.mapInArrow(_featurer(width, bands, rows), "id bigint, n bigint, key binary, buckets array<bigint>"), "sets")
    own = feats.filter("id is not null and key is not null")
    classes = own.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    held = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(shared, "buckets")  # sums are written apart from the joins that use them, so that Spark can split hot keys there
    members = written(held.join(shared, "bucket"), "members")

    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    anchors = written(members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("node"))).alias("best")), "anchors")
    anchored = written(members.join(anchors, "bucket").select("node", (-F.col("best.col2")).alias("anchor")).distinct(), "anchored")
    keyed = classes.select("node", "key", "n")
    anchored = anchored.join(keyed, "node").join(keyed.select(F.col("node").alias("anchor"), F.col("key").alias("anchor_key")), "anchor")
    anchored = written(anchored, "anchored")

    repeated = written(own.groupBy("id").agg(F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    picked, _ = split_marked(base.filter("id is not null"), F.col("id"), anchored.select("node").distinct().join(classes, "node").select("id"))
    sets = picked.mapInArrow(_setter(width), "key binary, shingles array<bigint>")
    sets = written(sets if repeated.isEmpty() else sets.dropDuplicates(["key"]), "shingles")
    first = (
        anchored.filter("node <> anchor").select("node", "key", "anchor", "anchor_key").join(sets, "key")
        .join(sets.select(F.col("key").alias("anchor_key"), F.col("shingles").alias("others")), "anchor_key")
    )
    both = F.size(F.array_intersect("shingles", "others"))
    first = first.filter(100 * both >= percent * (F.size("shingles") + F.size("others") - both)).select(F.col("node").alias("u"), F.col("anchor").alias("v"))
    found = components(_same_id(own, classes, repeated).unionByName(written(first, "first")))

    rest = _left_over(anchored, found, percent, block).join(sets, "key").drop("key")
    # every column beside the sets is a few bytes; a cell holds at most 2 * block rows
    more = written(rest.groupBy("anchor", "band", "cell").applyInArrow(_linker(percent), "u bigint, v bigint"), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    whole = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    linked = classes.select("key", "id", "copies", "node").join(whole, "node", "left").filter("copies > 1 or component is not null")
    linked = written(linked.select("key", "id", F.coalesce("component", "node").alias("component")), "linked")
    least = written(linked.groupBy("component").agg(F.min("id").alias("least")), "least")
    linked = linked.join(least, "component").select("key", F.col("least").alias("component"))
    return (
        feats.select("id", "n", "key").join(linked, "key", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )


def _same_id(own: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of texts that share an id."""
    ids = own.select("id", "key").join(repeated.filter("low <> high").select("id"), "id").join(classes.select("key", "node"), "key").select("id", "node")
    ids = written(ids.distinct(), "shared")
    return ids.join(written(ids.groupBy("id").agg(F.min("node").alias("v")), "first"), "id").select(F.col("node").alias("u"), "v")


def _left_over(anchored: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """The members of anchors with several components, dealt into cells so that every pair of different components and
    similar sizes meets.

    A band holds the sets of one size class (own) and of the class below it (below): a set is in its own band and in the
    next one. inner: whether rows outside the largest component are compared with each other in this cell."""
    labelled = anchored.join(found, "node", "left").select("anchor", "node", "key", "n", F.coalesce("component", "node").alias("comp"))
    sizes = labelled.groupBy("anchor", "comp").agg(F.count("*").alias("size"))
    mixed = (
        sizes.groupBy("anchor").agg(F.sum("size").alias("total"), F.max(F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"))
        .filter("comps > 1 and total > 2").select("anchor", F.col("main.comp").alias("main"))
    )
    step = 1.001 * math.log(100 / percent) if percent < 100 else 1e-9
    home = F.floor(F.log("n") / step).cast("bigint")
    bands = F.explode(F.array(F.struct(home.alias("band"), F.lit(False).alias("below")), F.struct((home + 1).alias("band"), F.lit(True).alias("below"))))
    rows = labelled.join(written(mixed, "mixed"), "anchor").withColumn("outlier", F.col("comp") != F.col("main")).withColumn("b", bands)
    rows = written(rows.select("anchor", "node", "key", "comp", "outlier", "b.band", "b.below", "n"), "rest")
    # rows of a block: more for very large groups, whose rows would else be copied into very many cells; at most 32 MB of sets
    fits = F.least(F.greatest(F.lit(block), F.ceil(F.count("*") / 64)), F.greatest(F.lit(16), F.floor(F.lit(4e6) / F.max("n"))))
    dealt = rows.groupBy("anchor", "band").agg(F.count_if("outlier").alias("outside"), F.count_if(~F.col("outlier")).alias("inside"), fits.alias("fits"), F.count_if(~F.col("below")).alias("own"))
    dealt = dealt.filter("outside > 0 and outside + inside > 1 and own > 0").select(
        "anchor", "band", F.greatest(F.lit(1), F.ceil(F.col("inside") / F.col("fits"))).cast("bigint").alias("n_in"), F.ceil(F.col("outside") / F.col("fits")).cast("bigint").alias("n_out")
    )
    rows = rows.join(written(dealt, "dealt"), ["anchor", "band"])
    at_in, at_out = F.expr("pmod(xxhash64(node), n_in)"), F.expr("pmod(xxhash64(node), n_out)")
    rows = rows.withColumn("at", F.when(F.col("outlier"), at_out).otherwise(at_in))
    outside = F.expr("transform(sequence(0L, n_in - 1), j -> struct(concat_ws(':', 'in', at, j) as cell, j = 0 as inner))")
    among = F.expr("transform(filter(sequence(0L, n_out - 1), j -> j <> at), j -> struct(concat_ws(':', 'out', least(at, j), greatest(at, j)) as cell, true as inner))")
    inside = F.expr("transform(sequence(0L, n_out - 1), i -> struct(concat_ws(':', 'in', i, at) as cell, at = 0 as inner))")
    out = rows.withColumn("c", F.explode(F.when(F.col("outlier"), F.concat(outside, among)).otherwise(inside)))
    return out.select("anchor", "band", "c.cell", "c.inner", "node", "key", "comp", "outlier", "below")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that near_duplicates keeps, as they are: one document of each component stays."""
    key = free_name(docs, "kept")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    gone = written(found.filter(~F.col("kept")).select(F.col(id_col).alias(key)).distinct(), "gone")
    own_id = F.col(f"`{id_col}`").cast("bigint")
    some, rest = split_marked(docs, own_id, gone)  # only rows that may go are shuffled
    return rest.unionByName(some.join(gone, own_id == F.col(key), "left_anti"))
