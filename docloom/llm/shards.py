"""Sharding by a k-d tree over metadata: distributed weighted medians, leaves of near equal bytes. DataFrame functions only."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Cells of a coded dimension, and of the hashes that break ties: what a histogram holds for a node at most.
CELLS = 4096


def _code(df: DataFrame, name: str) -> Column:
    """A dimension as a whole number: numbers and times on a logarithmic scale, others by hash; null is the least."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        col, kind = F.unix_date(col.cast("date")), T.LongType()
    if isinstance(kind, T.NumericType | T.BooleanType):
        x = col.cast("double")
        x = F.when(F.isnan(x), None).otherwise(x)
        return F.coalesce((F.signum(x) * F.floor(100 * F.log1p(F.least(F.abs(x), F.lit(1e15))))).cast("int"), F.lit(-CELLS))
    return F.coalesce(F.pmod(F.xxhash64(col.cast("string")), F.lit(CELLS)).cast("int"), F.lit(-1)) if kind.simpleString() != "void" else F.lit(-1)


def _ordinal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType | T.BooleanType | T.TimestampType | T.TimestampNTZType | T.DateType)


def _width(dim: str, ordinal: bool) -> Column:
    """How wide a dimension is: the spread of numbers and times, the number of values of others (CELLS at most)."""
    return (F.max(dim) - F.min(dim) if ordinal else F.size(F.collect_set(dim)) - 1).cast("double")


def _dealt(large: DataFrame, total: int, n_shards: int) -> DataFrame:
    """large (group, size), a few for each shard -> group, size and shard: the largest first, each to the least filled
    shard. shard is null where that shard has no room left; such a group is split."""
    room = F.lit(total) / F.lit(n_shards)
    least = lambda acc: F.array_min(acc["loads"])
    fits = lambda acc, x: least(acc) - x["less"] <= room

    def step(acc, x):
        at = (F.array_position(acc["loads"], least(acc)) - 1).cast("int")
        loads = F.transform(acc["loads"], lambda load, i: F.when((i == at) & fits(acc, x), load - x["less"]).otherwise(load))
        place = F.struct(x["group"].alias("group"), (-x["less"]).alias("size"), F.when(fits(acc, x), at).alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(acc["placed"], F.array(place)).alias("placed"))

    nothing = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("loads"), F.array().cast("array<struct<group: bigint, size: bigint, shard: int>>").alias("placed")
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "group")))
    return large.agg(F.aggregate(ordered, nothing, step)["placed"].alias("placed")).select(F.inline("placed"))


#: The order inside a node: the value along its dimension, the text's hash digit by digit, and for split groups the id's. Groups
#: of one node, value and both digits (one pair in 16 million) stay together.
ORDER = (("value",), ("h0",), ("h1", "tie"))


def _cut(rows: DataFrame, cell: tuple[str, ...], given: list[str]) -> DataFrame:
    """rows (given, goal, cell, inside) -> given and, as at_..., the cell that each node's goal falls into, the goal left inside
    it and its bytes. A node has about CELLS cells at most, so that one node's window is small."""
    upto = F.sum("inside").over(Window.partitionBy("first").orderBy(*cell))
    hit = rows.withColumn("upto", upto).filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("inside") < F.col("goal")))
    return hit.select(*given, *[F.col(c).alias(f"at_{c}") for c in cell], (F.col("goal") - (F.col("upto") - F.col("inside"))).alias("goal"), "inside")


def _halved(units: DataFrame, dims: dict[str, bool], whole: dict[str, float], room: list[float]) -> DataFrame:
    """One level: the units of every node with several leaves go to its left or right half. A node is known by its first leaf.

    One table of sums by node, dimension and value tells the widest dimension, the goal and the value at the cut; sums
    inside that value's cell, by the hash's digits, refine it. Each cut has a row for each node (no more than there are
    shards) and follows from the one before, so that a level is one chain of scans that ends in the new units."""
    some = units.filter("leaves > 1")
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("value")) for i, d in enumerate(dims)]))
    sums = some.select("first", "leaves", "size", values.alias("v")).groupBy("first", "leaves", "v.dim", "v.value").agg(F.sum("size").alias("inside"))
    sums = written(sums, "sums")
    widths = sums.groupBy("first", "leaves", "dim").agg((F.max("value") - F.min("value")).alias("spread"), F.count("*").alias("n"), F.sum("inside").alias("bytes"))
    of_dim = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("dim"))
    share = F.when(of_dim(dims.values()), F.col("spread")).otherwise(F.col("n") - 1) / of_dim([max(1.0, whole[d]) for d in dims])
    before = lambda at: F.get(F.lit(room), at.cast("int"))
    low, mid, high = before(F.col("first")), before(F.col("first") + F.expr("leaves div 2")), before(F.col("first") + F.col("leaves"))
    goal = F.greatest(F.col("bytes") * F.coalesce(F.try_divide(mid - low, high - low), F.lit(0.5)), F.lit(1e-6))
    plan = widths.groupBy("first", "leaves").agg(F.max_by("dim", F.struct(share, -F.col("dim"))).alias("along"), F.first("bytes").alias("bytes"))
    plan = plan.select(F.col("first"), F.col("along").alias("dim"), goal.alias("goal"))
    given = ["first", "along"]
    cut = _cut(sums.join(F.broadcast(plan), ["first", "dim"]).withColumnRenamed("dim", "along"), ORDER[0], given)  # n_shards rows
    value = F.get(F.array(*[F.col(d) for d in dims]), F.col("along"))
    for known, cell in zip(ORDER, ORDER[1:], strict=False):
        given += [f"at_{c}" for c in known]
        inner = some.join(F.broadcast(cut.drop("inside")), "first").withColumn("value", value)
        for c in given[2:]:
            inner = inner.filter(F.col(c.removeprefix("at_")) == F.col(c))
        cut = _cut(inner.groupBy(*given, "goal", *cell).agg(F.sum("size").alias("inside")), cell, given)
    # the last cell goes left if more than half of it belongs there
    cut = cut.withColumn("at_tie", F.col("at_tie") + (2 * F.col("goal") > F.col("inside")).cast("int")).drop("goal", "inside")
    placed = units.join(F.broadcast(cut), "first", "left").withColumn("value", value)
    order = [c for cell in ORDER for c in cell]
    left = F.struct(*order) < F.struct(*[F.col(f"at_{c}") for c in order])
    half, open_ = F.expr("leaves div 2"), F.col("leaves") > 1
    first = F.when(open_ & ~left, F.col("first") + half).otherwise(F.col("first"))
    leaves = F.when(open_, F.when(left, half).otherwise(F.col("leaves") - half)).otherwise(F.col("leaves"))
    return written(placed.select(*[c for c in units.columns if c not in ("first", "leaves")], first.alias("first"), leaves.alias("leaves")), "units")


def kd_shards(
    docs: DataFrame,
    *,
    dimensions: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int | None = None,
    target_bytes: int | None = None,
    block_rows: int = 10_000,
    large_share: float = 0.05,
) -> DataFrame:
    """One row for each row of docs: id_col, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot.

    Rows of equal texts are a group, which has the least of its rows' values in each dimension and stays in one shard.
    A group of more than large_share of a shard's bytes (or of its part of the rows) is large: large groups are dealt
    first, the largest first, each to the least filled shard, and stay whole as long as that has room for them. Only a
    group larger than a shard, or than the room that is left in any, is split, by the ids' hash, since no even sharding
    could keep it. All other groups are one node, which is to hold n_shards leaves (or as many as target_bytes each
    need). A node with k leaves is split along its widest dimension, against the whole table's width, where the bytes
    left of the cut are nearest to what the left k // 2 leaves have room for; groups at the cut's own value are ordered
    by their text's hash. So shards differ by a few small groups' sizes even if one value holds most rows.
    Slots number a shard's rows from 0 without gaps.

    Cases: a null text has no bytes, size 1 and the checksum of the empty text; nulls in a dimension come first; texts
    of any length count whole; repeated rows each have a slot; fewer groups than shards leave shards empty; an empty
    table gives an empty result; other columns are ignored.

    Scale: the text is read once; a table of a few numbers for each row is written, and one row for each group from it.
    Every level takes sums by node and cell with partial sums in each task, and writes two tables. What is broadcast is
    a row for each node (n_shards at most) and the large groups (2 n_shards / large_share at most); the whole table's totals
    and the room of each shard come to the driver. Slots are counted in blocks of about block_rows rows, so no task
    orders a whole shard."""
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give n_shards or target_bytes")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    dims = {f"d{i}": _ordinal(docs, c) for i, c in enumerate(dimensions)} or {"d0": True}
    coded = [_code(docs, c).alias(d) for c, d in zip(dimensions, dims, strict=False)] or [F.lit(0).alias("d0")]
    meta = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("group"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("by_id"), *coded,
    )
    meta = written(meta, "metadata")
    groups = written(meta.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), *[F.min(d).alias(d) for d in dims]), "groups")
    totals = groups.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(_width(d, o), F.lit(0.0)).alias(d) for d, o in dims.items()]
    ).first()
    if n_shards is None:
        n_shards = max(1, math.ceil(totals["bytes"] / target_bytes))

    heavy = (F.col("size") > F.lit(large_share * totals["bytes"] / n_shards)) | (F.col("rows") > F.lit(large_share * totals["rows"] / n_shards))
    large = written(_dealt(groups.filter(heavy).select("group", "size"), totals["bytes"], n_shards), "large")
    loads = dict(large.filter("shard is not null").groupBy("shard").agg(F.sum("size")).collect())  # n_shards rows at most
    room = list(accumulate((float(totals["bytes"]) / n_shards - loads.get(i, 0) for i in range(n_shards)), initial=0.0))

    split = large.filter("shard is null").select("group")
    tie = (F.pmod("by_id", F.lit(CELLS)) + 1).cast("int")
    parts = meta.select("group", "size", tie.alias("tie")).join(F.broadcast(split), "group").groupBy("group", "tie").agg(F.sum("size").alias("size"))
    parts = parts.join(F.broadcast(groups.filter(heavy).select("group", *dims)), "group")
    small = groups.filter(~heavy).withColumn("tie", F.lit(0)).select("group", "tie", "size", *dims)
    units = small.unionByName(parts)
    digit = lambda shift: F.shiftrightunsigned("group", shift).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    units = units.select("group", "tie", "size", *dims, digit(52).alias("h0"), digit(40).alias("h1"), F.lit(0).cast("bigint").alias("first"), F.lit(n_shards).cast("bigint").alias("leaves"))
    units = written(units, "units")
    for _ in range(math.ceil(math.log2(n_shards))):
        units = _halved(units, dims, totals.asDict(), room)

    # large groups find their shard in a broadcast table; no other group, or part of one, has many rows
    rows = meta.select("id", "size", "text_crc32", "by_id", "group").join(F.broadcast(large.select("group", "shard", F.lit(True).alias("large"))), "group", "left")
    rows = rows.withColumn("tie", F.when(F.col("large"), tie).otherwise(0))
    out = ("id", "size", "text_crc32", "by_id", F.col("shard").cast("bigint").alias("shard"))
    placed = rows.filter("shard is null").drop("shard").join(units.select("group", "tie", F.col("first").alias("shard")), ["group", "tie"]).select(*out)
    placed = written(placed.unionByName(rows.filter("shard is not null").select(*out)), "placed")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    placed = placed.join(F.broadcast(sizes), "shard").withColumn("block", F.pmod(F.col("by_id"), F.col("blocks")))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("shard", "block").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(before, F.lit(0))).select("shard", "block", "before")
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("by_id", "id")) - 1
    return placed.withColumn("within", within).join(offsets, ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("bigint").alias("slot")
    )
