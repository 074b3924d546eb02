"""Change histories: differences of old and new objects by path, and what kind of change each is."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.equality import same_number


def _paths(col: Column, kind: T.DataType, path: str, depth: int) -> list[Column]:
    """(path, value) entries below a column, as arrays: structs by name, arrays by position."""
    if depth > 0 and isinstance(kind, T.StructType):
        return [e for f in kind.fields for e in _paths(col[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, depth - 1)]
    if depth > 0 and isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
        return [F.transform(F.coalesce(col, F.array().cast(kind)), lambda x, i: F.struct(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")).alias("path"), x.cast("string").alias("value")))]
    if depth > 0 and isinstance(kind, T.ArrayType):
        fields = kind.elementType.fields
        empty = F.array().cast(kind)
        return [
            F.transform(F.coalesce(col, empty), lambda x, i, n=f.name: F.struct(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit(f"].{n}")).alias("path"), x[n].cast("string").alias("value")))
            for f in fields
        ]
    if isinstance(kind, T.MapType):
        return [F.transform(F.map_entries(F.coalesce(col, F.create_map().cast(kind))), lambda e: F.struct(F.concat(F.lit(f"{path}."), e["key"].cast("string")).alias("path"), e["value"].cast("string").alias("value")))]
    value = F.to_json(col) if isinstance(kind, T.StructType | T.ArrayType) else col.cast("string")
    return [F.array(F.struct(F.lit(path).alias("path"), value.alias("value")))]


def flattened(df: DataFrame, key: str, depth: int = 8) -> DataFrame:
    """(key, path, value) for each leaf of each row, down to depth."""
    entries = [e for f in df.schema.fields if f.name != key for e in _paths(F.col(f"`{f.name}`"), f.dataType, f.name, depth)]
    return df.select(F.col(key).alias("key"), F.explode(F.concat(*entries)).alias("e")).select("key", "e.path", "e.value")


def same_value(old: Column, new: Column) -> Column:
    """'' and null are the same, as are numbers that are equal in value."""
    a, b = F.when(old != "", old), F.when(new != "", new)
    return a.eqNullSafe(b) | F.coalesce(same_number(a, b), F.lit(False))


def deep_diff(old: DataFrame, new: DataFrame, key: str, depth: int = 8) -> DataFrame:
    """(key, path, before, after) for each leaf that differs; whole rows that came or went show all their leaves.

    Rows are joined once by key, and leaves are compared inside the row; only those that differ are rows of the result.
    Keys should be unique on each side."""

    def leaves(df: DataFrame, side: str) -> DataFrame:
        entries = [e for f in df.schema.fields if f.name != key for e in _paths(F.col(f"`{f.name}`"), f.dataType, f.name, depth)]
        return df.select(F.col(f"`{key}`").alias("key"), F.map_from_entries(F.concat(*entries)).alias(side))

    both = leaves(old, "b").join(leaves(new, "a"), "key", "full_outer")
    none = F.array().cast("array<string>")
    paths = F.array_union(F.coalesce(F.map_keys("b"), none), F.coalesce(F.map_keys("a"), none))
    entry = F.transform(paths, lambda p: F.struct(p.alias("path"), F.element_at("b", p).alias("before"), F.element_at("a", p).alias("after")))
    differs = F.filter(entry, lambda e: ~same_value(e["before"], e["after"]))
    return both.select("key", F.inline(differs))


def modify_history(old: DataFrame, new: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, label, kind, before, after) for chosen fields: insert where it was empty, delete where it becomes so, else update."""
    diff = deep_diff(old.select(key, *fields), new.select(key, *fields), key, depth=1)
    labels = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    empty_before, empty_after = (F.coalesce(F.col(c), F.lit("")) == "" for c in ("before", "after"))
    kind = F.when(empty_before, "insert").when(empty_after, "delete").otherwise("update")
    return diff.select("key", F.col("path").alias("field"), F.element_at(labels, F.col("path")).alias("label"), kind.alias("kind"), "before", "after")


def list_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that old has not, as insert, and the other way round, as delete; of repeated keys one counts.

    Both sides' keys are counted together, without a pass in each task before the shuffle: keys are mostly different, and a task would hold all
    of its own. A null key equals none, so it is on either side that has it."""
    spark = old.sparkSession
    sides = [df.select(F.col(f"`{key}`"), F.lit(kind).alias("kind")) for df, kind in ((new, "insert"), (old, "delete"))]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = sides[0].unionByName(sides[1]).repartition(parts, F.col(f"`{key}`"))  # a fixed number, so that none of them is joined to others
    kinds = both.groupBy(F.col(f"`{key}`")).agg(F.collect_set("kind").alias("_kinds"))
    return kinds.filter((F.size("_kinds") == 1) | F.col(f"`{key}`").isNull()).select(F.col(f"`{key}`"), F.explode("_kinds").alias("kind"))


def change_log(changes: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(seq, field, before, after) for each field that a change altered."""
    keys = F.array_distinct(F.concat(F.coalesce(F.map_keys("before"), F.array().cast("array<string>")), F.coalesce(F.map_keys("after"), F.array().cast("array<string>"))))
    each = changes.select("seq", "before", "after", F.explode(keys).alias("field"))
    out = each.select("seq", "field", F.element_at("before", F.col("field")).alias("before"), F.element_at("after", F.col("field")).alias("after"))
    if fields:
        out = out.filter(F.col("field").isin(fields))
    return out.filter(~F.col("before").eqNullSafe(F.col("after")))
