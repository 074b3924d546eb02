"""Reconciliation of documents with their source: missing, changed and orphaned ones, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.equality import field_equal, is_empty
from ..sources.snapshots import stored


def missing(view: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of the view that are not there yet."""
    return view.join(docs.select("_id"), "_id", "left_anti")


def orphans(view: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of documents whose source is gone."""
    return docs.select("_id").join(view.select("_id"), "_id", "left_anti")


def _pairs(view: DataFrame, docs: DataFrame, how: str = "inner") -> tuple[DataFrame, dict, dict]:
    """Documents beside their source, by id; for an outer join, _s and _d are true for the sides that are there."""
    a = {f.name: f.dataType for f in view.schema.fields}
    b = {f.name: f.dataType for f in docs.schema.fields}
    left = view.select("_id", *[F.col(f"`{c}`").alias(f"s_{c}") for c in a if c != "_id"])
    right = docs.select("_id", *[F.col(f"`{c}`").alias(f"d_{c}") for c in b if c != "_id"])
    if how != "inner":
        left, right = left.withColumn("_s", F.lit(True)), right.withColumn("_d", F.lit(True))
    return left.join(right, "_id", how), a, b


def _row_marks(a: dict, b: dict, fields: list[str] | None = None, references: dict[str, str] | None = None) -> Column:
    """The names of differing fields of a pair (see row_changes)."""

    def nested(t: T.DataType) -> bool:
        return isinstance(t, T.StructType) or isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)

    names = fields or [c for c in a if c != "_id" and c in b and not nested(a[c])]
    marks = []
    for c in names:
        r = (references or {}).get(c, c)
        same = field_equal(F.col(f"s_{r}"), a[r], F.col(f"d_{r}"), b[r])
        marks.append(F.when(~same, F.lit(c)))
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def row_changes(view: DataFrame, docs: DataFrame, fields: list[str] | None = None, references: dict[str, str] | None = None) -> DataFrame:
    """_id and changed, the sorted names of fields whose document value differs from the source; equal ones are left out.

    By default all fields of both sides that are no nested rows. references names the text field that stands for a
    vector field, which is compared in its place."""
    both, a, b = _pairs(view, docs)
    return both.select("_id", F.array_sort(_row_marks(a, b, fields, references)).alias("changed")).filter("size(changed) > 0")


def _nested_marks(a: dict, b: dict, name: str, ordered: bool) -> Column:
    """What of one nested field of a pair differs (see nested_changes)."""
    source, doc = F.col(f"s_{name}"), F.col(f"d_{name}")
    whole = F.array(F.lit(name))
    none = F.array().cast("array<string>")

    def children(x, s_kind: T.StructType, y, d_kind: T.StructType):
        marks = [
            F.when(~field_equal(x[f.name], f.dataType, y[f.name], d_kind[f.name].dataType, True), F.lit(f"{name}.{f.name}"))
            for f in s_kind.fields if f.name in d_kind.names
        ]
        return F.array_compact(F.array(*marks))

    if isinstance(a[name], T.StructType):
        inner = children(source, a[name], doc, b[name])
    elif ordered and isinstance(a[name].elementType, T.StructType):
        rows = F.zip_with(source, doc, lambda x, y: children(x, a[name].elementType, y, b[name].elementType))
        first = F.get(F.filter(rows, lambda r: F.size(r) > 0), F.lit(0))
        inner = F.when(F.size(source) != F.size(doc), whole).otherwise(F.coalesce(first, none))
    else:
        inner = F.when(field_equal(source, a[name], doc, b[name], ordered), none).otherwise(whole)
    empty_a, empty_b = is_empty(source, a[name]), is_empty(doc, b[name])
    return F.when(empty_a & empty_b, none).when(empty_a | empty_b, whole).otherwise(inner)


def nested_changes(view: DataFrame, docs: DataFrame, name: str, ordered: bool = False) -> DataFrame:
    """_id and changed for one nested field: for an object its differing children as name.child; for an array the name if
    sizes differ or the rows do, as a multiset, or if ordered the children that differ in the first differing row."""
    both, a, b = _pairs(view, docs)
    return both.select("_id", _nested_marks(a, b, name, ordered).alias("changed")).filter("size(changed) > 0")


def repairs(view: DataFrame, docs: DataFrame, changes: DataFrame) -> DataFrame:
    """The view's documents for changed ids, whole, ready to replace what is there."""
    return view.join(changes.select("_id"), "_id", "left_semi")


def change_counts(changes: DataFrame, samples: int = 5) -> DataFrame:
    """How often each field differed, with the first ids as samples."""
    each = changes.select("_id", F.explode("changed").alias("field"))
    first = F.row_number().over(Window.partitionBy("field").orderBy("_id"))
    kept = each.withColumn("n", first).filter(F.col("n") <= samples)  # each task passes on that many of a field at most
    ids = kept.groupBy("field").agg(F.array_sort(F.collect_list("_id")).alias("samples"))
    return each.groupBy("field").agg(F.count("*").alias("n_changed")).join(ids, "field")


def _all_marks(a: dict, b: dict, nested: dict[str, bool] | None) -> Column:
    return F.concat(_row_marks(a, b), *[_nested_marks(a, b, name, ordered) for name, ordered in (nested or {}).items()])


def check_all(view: DataFrame, docs: DataFrame, nested: dict[str, bool] | None = None) -> DataFrame:
    """One row for each document in need of work: _id, action (insert, delete, update) and the changed fields.

    All is told by one outer join, so that view and docs are computed once each, however many fields are compared."""
    both, a, b = _pairs(view, docs, "full_outer")
    none = F.array().cast("array<string>")
    changed = _all_marks(a, b, nested)
    action = F.when(F.col("_d").isNull(), "insert").when(F.col("_s").isNull(), "delete").otherwise("update")
    rows = both.select("_id", action.alias("action"), F.when(F.col("_s") & F.col("_d"), changed).otherwise(none).alias("changed"))
    rows = rows.filter("action <> 'update' or size(changed) > 0")
    return rows.groupBy("_id", "action").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed")))).alias("changed"))


def _digests(docs: DataFrame, names: list[str], bits: int) -> DataFrame:
    """(range, n, total, mixed) for each range of ids, a range being bits of the id's hash: what its documents' texts add up to."""
    text = F.to_json(F.struct("_id", *[F.col(f"`{c}`") for c in names]))
    rows = docs.select(_range(bits).alias("range"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"))
    return rows.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("one").cast("decimal(38,0)")).alias("total"), F.bit_xor("two").alias("mixed"))


def _range(bits: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(1 << bits))


def _inside(docs: DataFrame, ranges: DataFrame | None, bits: int) -> DataFrame:
    return docs if ranges is None else docs.withColumn("range", _range(bits)).join(ranges, "range", "left_semi").drop("range")


def differing_ranges(view: DataFrame, docs: DataFrame, levels: tuple[int, ...] = (10, 16)) -> tuple[DataFrame | None, int]:
    """The ranges of ids in which view and docs differ, and their bits; None if nothing differs.

    Each side is summed up once, by the finest ranges of ids; coarser ones are sums of those (a range's low bits name it), and where a coarse one is
    equal, the finer ones below are not looked at.
    No document meets its partner here. Values are compared as their JSON texts over the fields that both sides have, so a range may be listed for values
    that only look different; a range that is not listed holds the same documents on both sides."""
    names = sorted({c for c in view.columns if c != "_id"} & set(docs.columns))
    same = ["range", "n", "total", "mixed"]
    sides = [stored(_digests(side, names, levels[-1])) for side in (view, docs)]  # a row for each range at most
    found = None
    for level in levels:
        low = F.pmod("range", F.lit(1 << level))
        kept = [s if found is None else s.join(found, F.pmod(s["range"], F.lit(1 << bits)) == found["found"], "left_semi") for s in sides]
        one, two = (s.groupBy(low.alias("range")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed")).select(*same) for s in kept)
        found, bits = stored(one.exceptAll(two).unionByName(two.exceptAll(one)).select(F.col("range").alias("found")).distinct()), level
        if found.isEmpty():
            return None, level
    return found.toDF("range"), bits


def check_ranges(view: DataFrame, docs: DataFrame, nested: dict[str, bool] | None = None, levels: tuple[int, ...] = (10, 16)) -> DataFrame:
    """What check_all gives, found by a tree of digests: only documents in ranges of ids that differ are joined with their source."""
    ranges, bits = differing_ranges(view, docs, levels)
    if ranges is None:
        return docs.sparkSession.createDataFrame([], "_id string, action string, changed array<string>")
    return check_all(_inside(view, ranges, bits), _inside(docs, ranges, bits), nested)


def repaired(view: DataFrame, docs: DataFrame, work: DataFrame) -> DataFrame:
    """docs after the work that check_all lists, which is written once, since both parts of the result read it."""
    work = stored(work.select("_id", "action"))
    kept = docs.join(work.select("_id"), "_id", "left_anti")
    fresh = view.join(work.filter("action <> 'delete'").select("_id"), "_id", "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def mended(view: DataFrame, docs: DataFrame, nested: dict[str, bool] | None = None, *, orphans: bool = True) -> DataFrame:
    """What repaired gives after check_all, by the outer join that compares: a document that differs or is missing is the view's, an equal
    one stays as it is, and orphans go, unless orphans is false.

    view and docs are computed once each, and shuffled once each for their meeting. Of a document that docs hold more than once, one is compared
    and the others go. Where both sides have a field in different types, the work is listed first, and a union finds the common types."""
    kinds = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (view, docs)]
    if any(kinds[0][c] != kinds[1][c] for c in kinds[0].keys() & kinds[1].keys()):
        work = check_all(view, docs, nested)
        return repaired(view, docs, work if orphans else work.filter("action <> 'delete'"))
    numbered = docs.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("_id")))
    both, a, b = _pairs(view, numbered, "full_outer")
    there, keyed = F.col("_s").isNotNull(), F.col("_id").isNotNull()
    fresh = there & (F.col("_d").isNull() | F.coalesce(F.size(_all_marks(a, b, nested)) > 0, F.lit(False)))
    other = ~there & (~keyed if orphans else F.lit(True))  # null ids meet nothing: such documents are left alone
    rows = both.filter(there & keyed & F.coalesce(F.col("d__nth") == 1, F.lit(True)) | other).withColumn("_fresh", fresh)

    def value(c: str) -> Column:
        if c not in a or c not in b:
            return F.when(F.col("_fresh") == (c in a), F.col(f"`{'s' if c in a else 'd'}_{c}`"))
        return F.when(F.col("_fresh"), F.col(f"`s_{c}`")).otherwise(F.col(f"`d_{c}`"))

    names = [*docs.columns, *[c for c in view.columns if c not in b]]
    return rows.select(*[F.col("_id") if c == "_id" else value(c).alias(c) for c in names])


def delete_range(docs: DataFrame, column: str, low, high) -> DataFrame:
    """docs without those whose column lies in [low, high]."""
    return docs.filter(F.col(column).isNull() | ~F.col(column).between(low, high))


def field_bounds(docs: DataFrame, column: str) -> DataFrame:
    """The least and greatest value of a field; texts are read as numbers. As decimals, so that long keys stay exact."""
    value = F.col(column).try_cast("decimal(38,10)")
    return docs.agg(F.min(value).alias("least"), F.max(value).alias("greatest"))
