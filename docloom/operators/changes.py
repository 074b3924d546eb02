"""Row changes: their shape, their before and after images, and what of them is of interest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Route

#: One row for each changed table row. before and after hold whole images as texts; an insert has no before, a delete no after.
CHANGE = (
    "seq bigint, op string, is_ddl boolean, db string, table string, pk array<string>, es bigint, ts bigint, "
    "before map<string,string>, after map<string,string>"
)
TRANSACTION_MARKERS = ("TRANSACTIONBEGIN", "TRANSACTIONEND")


def overlay(base: Column, top: Column) -> Column:
    """base with top's entries over it; either may be null."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.when(top.isNull(), base).when(base.isNull(), top).otherwise(F.map_concat(kept, top))


def strip_unchanged(old: Column, data: Column) -> Column:
    """old without entries that equal data's."""
    return F.map_filter(old, lambda k, v: ~F.coalesce(v.eqNullSafe(F.element_at(data, k)), F.lit(False)))


def from_log(df: DataFrame) -> DataFrame:
    """Changes from log rows with data and old (an update's old holds changed columns only; a delete's data is the image
    that went). Transaction markers go, a missing type is an insert, and unchanged columns leave old. A statement (sql), if
    df has that column, comes along."""
    op = F.upper(F.coalesce("type", F.lit("INSERT")))
    old = strip_unchanged(F.col("old"), F.col("data"))
    before = F.when(op == "DELETE", F.col("data")).when(op == "UPDATE", overlay(F.col("data"), old))
    return (
        df.filter(~op.isin(*TRANSACTION_MARKERS))
        .withColumn("op", op).withColumn("before", before).withColumn("after", F.when(op != "DELETE", F.col("data")))
        .select("seq", "op", F.coalesce("is_ddl", F.lit(False)).alias("is_ddl"), "db", "table", "pk", "es", "ts", "before", "after", *(["sql"] if "sql" in df.columns else []))
    )


def binlog_images(df: DataFrame) -> DataFrame:
    """Log rows from full row images (before, after) and the list of updated columns: data and old as from_log reads them."""
    old = F.map_filter("before", lambda k, _: F.array_contains("updated", k))
    return df.withColumn("data", F.when(F.col("type") == "DELETE", F.col("before")).otherwise(F.col("after"))).withColumn("old", F.when(F.col("type") == "UPDATE", old))


def changed_columns(before: Column, after: Column) -> Column:
    """The columns whose values differ; all of the image for inserts and deletes."""
    whole = F.coalesce(after, before)
    differ = F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.element_at(before, k)))
    return F.array_sort(F.map_keys(F.when(before.isNotNull() & after.isNotNull(), differ).otherwise(whole)))


def changes_any(among: Callable[[Column], Column]) -> Column:
    """Whether one of changed_columns, in lower case, is among those that are asked for: no list of them is made, and only values of
    columns that are asked for are compared."""
    before, after = F.col("before"), F.col("after")
    differs = lambda k: before.isNull() | after.isNull() | ~F.element_at(after, k).eqNullSafe(F.element_at(before, k))
    return F.exists(F.map_keys(F.coalesce(after, before)), lambda k: among(F.lower(k)) & differs(k))


def expand_key_change(changed: Column, key_columns: list[str], columns: list[str]) -> Column:
    """When a foreign key is among the changed columns, all columns that come over it count as changed."""
    moved = F.arrays_overlap(changed, F.array(*[F.lit(k) for k in key_columns]))
    return F.when(moved, F.array_sort(F.array_union(changed, F.array(*[F.lit(c) for c in columns])))).otherwise(changed)


def wanted(changes: DataFrame, ignore_until: int | None = None, loading: bool = False) -> DataFrame:
    """Changes without DDL and, unless loading, without those committed at or before ignore_until (epoch ms)."""
    out = changes.filter(~F.col("is_ddl"))
    if ignore_until is None or loading:
        return out
    return out.filter(F.col("es").isNull() | (F.col("es") > ignore_until))


def cast_log_values(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """A Kafka log's values by their declared source types: bit, int, bigint and times are cast, others stay."""
    names = {"bit": "tinyint", "int": "int", "bigint": "bigint", "timestamp": "timestamp", "date": "timestamp", "datetime": "timestamp"}
    out = df
    for c, t in types.items():
        if name := names.get(t.split("(")[0].lower()):
            out = out.withColumn(c, F.col(c).try_cast(name))
    return out


def route_table(changes: DataFrame, routes: list[Route]) -> DataFrame:
    """The routes as a small table: one row for each table of each view."""
    spark = changes.sparkSession
    return spark.createDataFrame([(r.index, r.view, r.table, r.alias, r.role, list(r.columns)) for r in routes], "index string, view string, table string, alias string, role string, columns array<string>")


def dependents(changes: DataFrame, routes: list[Route], only_effect: bool = True) -> DataFrame:
    """One row for each change and each view that reads its table, with the role and whether the change has an effect.

    An INIT always has one; an update does if it changed a column that the view reads, or its key; inserts and deletes do."""
    table = F.broadcast(route_table(changes, routes))  # as many rows as the mappings have tables
    rows = changes.withColumn("_table", F.lower("table")).withColumnRenamed("table", "source_table")
    rows = rows.join(table, F.col("_table") == F.col("table")).drop("_table", "table").withColumnRenamed("source_table", "table")
    effect = F.when(F.col("op") == "UPDATE", F.array_contains("columns", "*") | changes_any(lambda k: F.array_contains("columns", k))).otherwise(F.lit(True))
    out = rows.withColumn("effect", F.coalesce(effect, F.lit(False)))
    return out.filter("effect") if only_effect else out


def concerning(changes: DataFrame, route: Route) -> DataFrame:
    """The changes of one route's table that have an effect on its view: dependents for a single route, as a filter."""
    read = F.lit(True) if "*" in route.columns else changes_any(lambda k: k.isin(*route.columns))
    return changes.filter((F.lower("table") == route.table) & F.when(F.col("op") == "UPDATE", read).otherwise(F.lit(True)))


def notifications(deps: DataFrame) -> DataFrame:
    """One row for each change with the views that it concerned, in a stable order: what listeners receive."""
    return deps.groupBy("seq", "table", "op").agg(F.array_sort(F.collect_set(F.struct("index", "view", "role"))).alias("views"))


def rows_as_changes(rows: DataFrame, db: str, table: str, pk: list[str], op: str = "INSERT", seq: str | None = None) -> DataFrame:
    """Table rows as changes (CHANGE) of one kind, in the order of a column if seq names one."""
    image = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    none = F.lit(None).cast("map<string,string>")
    at = F.col(f"`{seq}`").cast("bigint") if seq else F.monotonically_increasing_id()
    zero = F.lit(0).cast("bigint")
    return rows.select(
        at.alias("seq"), F.lit(op).alias("op"), F.lit(False).alias("is_ddl"), F.lit(db).alias("db"), F.lit(table).alias("table"), F.array(*[F.lit(k) for k in pk]).alias("pk"), zero.alias("es"), zero.alias("ts"),
        (image if op == "DELETE" else none).alias("before"), (none if op == "DELETE" else image).alias("after"),
    )


def batch_statistics(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("es").alias("last_es"), F.array_sort(F.collect_set("table")).alias("tables"), F.count("*").alias("n_changes"))
