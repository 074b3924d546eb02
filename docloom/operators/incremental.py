"""Incremental maintenance: which documents a batch of changes concerns, and what they are now.

The documents of a view are always view(current tables). For each changed table the rows' before and after images take
the table's place in the view's own joins, which yields the documents that read them, also through rows that moved
to another key or are gone. Their values are then recomputed from the current tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import Analyser, Query, Route, keys_of, routes
from ..plans.mapping import Field, Mapping
from ..sources.snapshots import stored
from .changes import changes_any, concerning
from .view import Methods, Models, build_view, field_values, source_sql, temporary

#: Nested keys (_k0, ...) of a field -> the ids of their documents (_id): see streaming.owners.
Owners = Callable[[Field, DataFrame], DataFrame]


def images(changes: DataFrame, schema: T.StructType, distinct: bool = True) -> DataFrame:
    """Before and after images of changes as rows of their table, typed like it. Without distinct, rows come as often as the changes
    hold them, and only the columns that a reader takes are made."""
    both = changes.select(F.explode(F.array_compact(F.array("before", "after"))).alias("row"))
    lowered = F.transform_keys("row", lambda k, _: F.lower(k))
    both = both.select(lowered.alias("row"))
    rows = both.select(*[F.element_at("row", f.name.lower()).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return rows.distinct() if distinct else rows


def _through(spark: SparkSession, q: Query, route: Route, rows: DataFrame, out: str) -> DataFrame:
    """out of a query in which rows stand for one alias's table, where they take part.

    All other joins are outer: a partner that is gone, or not there yet, must not hide whom the rows concern. Where two
    tables changed at once, the one nearer to the query's main table still finds its way."""
    if route.role == "derived":
        hit = next(c for pair in q.alias_of(route.alias).pairs for a, c in pair if a.lower() == route.alias.lower())
        source = source_sql(q, within={route.alias: (route.table, temporary(rows))}, outer=True)
        return spark.sql(f"SELECT DISTINCT {out} FROM {source} WHERE {route.alias}.{hit} IS NOT NULL")
    source = source_sql(q, {route.alias: temporary(rows.withColumn("_hit", F.lit(True)))}, outer=True)
    return spark.sql(f"SELECT DISTINCT {out} FROM {source} WHERE {route.alias}._hit")


def _owners(spark: SparkSession, whole: Query, mapping: Mapping, keys: DataFrame, f: Field, known: Owners | None = None) -> DataFrame:
    """The ids of documents tied to nested keys (_k0, ...): the keys themselves where they are tied by the primary key,
    else what is known of them, or the main table by its key columns. Ids without a document fall out when they are recomputed."""
    main = whole.main
    pk = whole.item(mapping.pk).columns[0][1]
    tied = [v for _, v in keys_of(f)]
    if [v.lower() for v in tied] == [pk.lower()]:
        kind = next(x.dataType for x in spark.table(main.table).schema.fields if x.name.lower() == pk.lower())
        return keys.select(F.col("_k0").try_cast(kind).cast("string").alias("_id"))
    if known is not None:
        return known(f, keys)
    owners = spark.table(main.table).select(F.col(pk).cast("string").alias("_id"), *[F.col(v).alias(f"_v{n}") for n, v in enumerate(tied)])
    on = reduce(lambda a, b: a & b, [owners[f"_v{n}"] == keys[f"_k{n}"] for n in range(len(tied))])
    return owners.join(keys, on, "left_semi").select("_id")


def affected(spark: SparkSession, mapping: Mapping, changes: DataFrame, analyser: Analyser | None = None, known: Owners | None = None) -> DataFrame:
    """(_id, view) for each document and view that the changes concern; view "" is the main query.

    main: the documents of the changed rows themselves. Main query slaves: the documents that join the rows. Nested
    tables: the nested keys that the rows reach, and the documents tied to them, be it by their primary or another key."""
    analyser = analyser or Analyser(spark)
    whole = analyser.query(mapping.sql)
    key = whole.item(mapping.pk)
    nested = {f.name: (f, analyser.query(f.sql, check=False)) for f in mapping.nested}
    listed = routes(analyser, mapping)
    found = []
    for r in listed:
        itself = r.role in ("main", "owner") and (r.view == "" or r.role == "owner")
        # rows that join others do so once each; where nothing is joined, only the keys are made, and those are distinct in the end
        joins = not itself and (r.role == "derived" or len((whole if r.view == "" else nested[r.view][1]).tables) > 1)
        rows = images(concerning(changes, r), spark.table(r.table).schema, joins)
        if itself:
            own = rows.select(F.col(key.columns[0][1]).cast("string").alias("_id"))
        elif r.view == "":
            own = _through(spark, whole, r, rows, f"cast({key.text} AS string) AS _id")
        else:
            f, q = nested[r.view]
            out = ", ".join(f"{k} AS _k{n}" for n, (k, _) in enumerate(keys_of(f)))
            own = _owners(spark, whole, mapping, _through(spark, q, r, rows, out), f, known)
        found.append(own.filter("_id is not null").withColumn("view", F.lit(r.view)))
    return reduce(DataFrame.unionByName, found).distinct()


def recompute(spark: SparkSession, mapping: Mapping, changes: DataFrame, *, methods: Methods | None = None, models: Models | None = None) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes): the concerned documents as they are now, and the ids of those that are no more.

    The ids are written once, since every part of the view is restricted by them."""
    ids, now = _recomputed(spark, mapping, changes, methods=methods, models=models)
    return now, ids.join(_present(spark, mapping, ids), "_id", "left_anti")


def _recomputed(spark: SparkSession, mapping: Mapping, changes: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The ids of the concerned documents, and those of them that there are, as they are now."""
    analyser = Analyser(spark)
    ids = stored(affected(spark, mapping, changes, analyser).select("_id").distinct())
    return ids, build_view(spark, mapping, only=ids, analyser=analyser, **how)


def _present(spark: SparkSession, mapping: Mapping, ids: DataFrame) -> DataFrame:
    """The ids (_id) that the main query has a row for: nested and derived fields neither bring documents nor take them."""
    return build_view(spark, Mapping(mapping.index, mapping.sql, pk=mapping.pk), only=ids).select("_id")


def recompute_parts(
    spark: SparkSession, mapping: Mapping, changes: DataFrame, *, known: Owners | None = None, **how
) -> tuple[DataFrame, DataFrame, list[tuple[list[str], DataFrame]]]:
    """(upserts, deletes, parts): what recompute gives, by fields. parts holds, for the main columns and for each nested field,
    their names and their values in the documents where only these may have changed: _id and the fields.

    A document is made whole if its own row came, went or changed its key, or if the main query joins other tables, which
    may bring documents or take them. Otherwise a changed nested table is the only table read, beside the main table's keys; and of
    a document's own row, the main columns and the nested fields whose keys it changed. how goes to build_view."""
    analyser = Analyser(spark)
    whole = analyser.query(mapping.sql)
    pk = whole.item(mapping.pk).columns[0][1]
    found = stored(affected(spark, mapping, changes, analyser, known))
    own = changes.filter(F.lower("table") == whole.main.table.lower())
    moved = own.filter((F.col("op") != "UPDATE") | changes_any(lambda k: k == pk.lower()))
    kind = next(x for x in spark.table(whole.main.table).schema.fields if x.name.lower() == pk.lower())
    ids = images(moved, T.StructType([kind])).select(F.col(kind.name).cast("string").alias("_id"))
    if len(whole.tables) > 1:
        ids = ids.unionByName(found.filter("view = ''").select("_id"))
    ids = stored(ids.filter("_id is not null").distinct())
    upserts = build_view(spark, mapping, only=ids, analyser=analyser, **how)
    deletes = ids.join(_present(spark, mapping, ids), "_id", "left_anti")
    rest = found.join(ids, "_id", "left_anti")
    of = lambda view: rest.filter(F.col("view") == view).select("_id").distinct()
    parts = []
    if len(whole.tables) == 1:
        main = build_view(spark, mapping, only=of(""), fields=[], analyser=analyser, **how)
        parts.append(([c for c in main.columns if c != "_id"], main))
    parts += [([f.name], field_values(spark, mapping, f, of(f.name), analyser, **how)) for f in mapping.nested]
    return upserts, deletes, parts


def merged(snapshot: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The snapshot after upserts (whole documents) and deletes (ids). Applying the same twice changes nothing."""
    gone = upserts.select("_id").unionByName(deletes.select("_id"))
    return snapshot.join(gone, "_id", "left_anti").unionByName(upserts, allowMissingColumns=True)


def maintain(spark: SparkSession, mapping: Mapping, snapshot: DataFrame, changes: DataFrame, **how) -> DataFrame:
    """The snapshot brought to the current tables, given the changes since: what merged does with recompute's two parts, where what
    goes is told by ids alone, so that nested fields are computed once."""
    ids, now = _recomputed(spark, mapping, changes, **how)
    gone = ids.unionByName(_present(spark, mapping, ids))
    return snapshot.join(gone, "_id", "left_anti").unionByName(now, allowMissingColumns=True)


def direct_updates(changes: DataFrame, q: Query, pk: str, write_null: bool = False) -> DataFrame:
    """Partial documents straight from changed main rows of a simple view: _id and the map of written fields.

    An insert writes every field (nulls only if write_null); an update the changed ones, unless before and after are
    null and write_null is off; a delete writes none."""
    fields = {i.name: i.columns[0][1] for i in q.items}
    entries = []
    for name, column in fields.items():
        old, new = F.element_at("before", column), F.element_at("after", column)
        insert = F.col("before").isNull() & (new.isNotNull() | F.lit(write_null))
        update = F.col("before").isNotNull() & ~old.eqNullSafe(new)
        entries.append(F.when(F.col("after").isNotNull() & (insert | update), F.struct(F.lit(name).alias("key"), new.alias("value"))))
    key = q.item(pk).columns[0][1]
    doc = F.map_from_entries(F.array_compact(F.array(*entries)))
    image = F.coalesce("after", "before")
    out = changes.select("seq", "op", F.element_at(image, key).alias("_id"), doc.alias("doc"))
    return out.filter("_id is not null and _id <> '' and (op = 'DELETE' or size(doc) > 0)")
