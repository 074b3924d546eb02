"""A mapping's documents as a DataFrame: the main query, with nested fields grouped by their keys and joined on."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert
from ..functions.embed import Model, Vectors, embed, limits
from ..plans.lineage import Analyser, Query, keys_of
from ..plans.mapping import Field, Mapping, MappingError, order_columns

Methods = dict[str, Callable[[Column], Column]]
Models = dict[str, Model]


def source_sql(q: Query, replaced: dict[str, str] | None = None, within: dict[str, tuple[str, str]] | None = None, outer: bool = False) -> str:
    """A query's FROM text. replaced gives other tables for some aliases; within, for derived tables, another table for
    one that they read; outer makes all joins between the tables left joins."""
    text, hidden = q.source, []
    for alias, sub in q.derived.items():
        if within and alias in within:
            old, new = within[alias]
            hidden.append(_renamed(sub, old, new))
        else:
            hidden.append(sub)
        text = text.replace(sub, f"\x01{len(hidden) - 1}\x01", 1)
    for alias, name in (replaced or {}).items():
        table = re.escape(q.alias_of(alias).table)
        named = rf"(?<![\w.`])`?{table}`?(\s+(?:as\s+)?`?{re.escape(alias)}`?)(?![\w`.])"
        new, n = re.subn(named, rf"{name}\1", text, flags=re.I)
        if not n:
            new = re.sub(rf"(?<![\w.`])`?{table}`?(?![\w`.])", f"{name} {alias}", text, count=1, flags=re.I)
        text = new
    if outer:
        text = re.sub(r"\b(?:(?:inner|left\s+outer|left)\s+)?join\b", "LEFT JOIN", text, flags=re.I)
    return re.sub("\x01(\\d+)\x01", lambda m: hidden[int(m[1])], text)


def _renamed(sql: str, table: str, name: str) -> str:
    """sql with a table of FROM or JOIN replaced, under its old name if it has no alias."""
    named = rf"(\b(?:from|join)\s+)`?{re.escape(table)}`?(\s+(?:as\s+)?(?!(?:left|inner|join|on|where|group|order|cross)\b)\w+)?"
    return re.sub(named, lambda m: f"{m[1]}{name}{m[2] or ' ' + table}", sql, flags=re.I)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Names for the tables that mappings read."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def temporary(df: DataFrame) -> str:
    name = f"_docloom_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def _grouped(select: list[tuple[str, bool, str]], by: list[str], source: str, distinct: bool = False) -> str:
    """SQL of select (text, whether it aggregates, name) over source, grouped by by if that is not empty.

    What is neither grouped by nor aggregated comes from one row of its group: the least by all of it together, nulls
    last, so that a group never mixes its rows."""
    plain = {b.replace("`", "").lower() for b in by}
    whole = lambda t: t.replace("`", "").lower() in plain
    loose = [t for t, aggregate, _ in select if by and not aggregate and not whole(t)]
    if not loose:
        group = f" GROUP BY {', '.join(by)}" if by else ""
        return f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(f'{t} AS {n}' for t, _, n in select)} FROM {source}{group}"
    row = ", ".join(f"'l{n}', {t}" for n, t in enumerate(loose))
    order = ", ".join(f"'n{n}', {t} IS NULL, 'l{n}', {t}" for n, t in enumerate(loose))
    inner = [f"{t} AS {n}" for t, a, n in select if a or whole(t)]
    one = f"min_by(named_struct({row}), named_struct({order})) AS _one"
    outer = [n if a or whole(t) else f"_one.l{loose.index(t)} AS {n}" for t, a, n in select]
    return f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(outer)} FROM (SELECT {', '.join([*inner, one])} FROM {source} GROUP BY {', '.join(by)})"


def main_rows(spark: SparkSession, q: Query, mapping: Mapping, replaced: dict[str, str] | None = None) -> DataFrame:
    """The main query with _id and the nested fields' key columns. With joins it is grouped by the primary key (see _grouped)."""
    key = q.item(mapping.pk)
    wanted = sorted({v for f in mapping.nested for _, v in keys_of(f)})
    outputs = [(i.text, i.aggregate, f"`{i.name}`") for i in q.items]
    outputs += [(f"{q.main.alias}.`{v}`", False, f"`_k_{v}`") for v in wanted]
    grouped = bool(q.group_by) or len(q.tables) > 1 or any(i.aggregate for i in q.items)
    by = (list(q.group_by) or [key.text]) if grouped else []
    rows = spark.sql(_grouped(outputs, by, source_sql(q, replaced)))
    return rows.withColumn("_id", F.col(f"`{key.name}`").cast("string"))


def nested_rows(spark: SparkSession, analyser: Analyser, f: Field, mapping: Mapping) -> tuple[DataFrame, list[str]]:
    """A nested query's rows with its key columns (_k0, _k1, ...) and order columns (_o0, ...)."""
    q = analyser.query(f.sql, check=False)
    keys = keys_of(f)
    by = list(q.group_by)
    if not by and any(i.aggregate for i in q.items):
        if not f.kind.startswith("object"):
            raise MappingError(f"{f.name}: an array with aggregates needs GROUP BY")
        by = [k for k, _ in keys]
    select = [(i.text, i.aggregate, f"`{i.name}`") for i in q.items]
    select += [(k, False, f"_k{n}") for n, (k, _) in enumerate(keys)]
    select += [(c, False, f"_o{n}") for n, (c, _) in enumerate(order_columns(f.on_main))]
    return spark.sql(_grouped(select, by, q.source, q.distinct)), [i.name for i in q.items]


def derived(col: Column, kind: T.DataType, f: Field, methods: Methods) -> Column:
    """A derived scalar field's value from its source column."""
    match f.kind:
        case "array":
            return col if isinstance(kind, T.ArrayType) else convert.split_field(col.cast("string"), f.split, f.element_type)
        case "object":
            return col if isinstance(kind, T.MapType | T.StructType) else convert.json_field(col)
        case "boolean":
            return convert.bool_field(col, kind)
        case "static-method":
            if f.method not in methods:
                raise MappingError(f"{f.name}: no method {f.method} is registered")
            return F.when(col.isNotNull(), methods[f.method](col))
    return col


def _compared(x: Column, y: Column, descending: list[bool]) -> Column:
    """-1, 0 or 1 for two entries, by their order columns of any type and then by their rows. Null is the least."""

    def by(a: Column, b: Column) -> Column:
        both = F.when(a < b, -1).when(a > b, 1).otherwise(0)
        return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).otherwise(both)

    steps = [(-by(x[f"r{n}"], y[f"r{n}"]) if d else by(x[f"r{n}"], y[f"r{n}"])) for n, d in enumerate(descending)]
    out = by(x["row"], y["row"])
    for step in reversed(steps):
        out = F.when(step != 0, step).otherwise(out)
    return out


def nested_values(rows: DataFrame, names: list[str], f: Field, mapping: Mapping, methods: Methods, models: Models | None = None, vectors: Vectors | None = None) -> DataFrame:
    """One row for each key with the field's value: the first row, all rows, or their first column.

    Rows are in the fragment's order, or else in their own; the first row is the least. Children are derived beside the
    columns that rows are ordered by, so that JSON objects and vectors, which have no order, can be children too."""
    children = {c.leaf: c for c in mapping.children(f.name)}
    for name in [n for n in names if n in children and children[n].kind == "llm-vector"]:
        rows = embedded(rows, name, f"_vector_{name}", children[name], models or {}, vectors)
    types = dict(zip(rows.columns, [x.dataType for x in rows.schema], strict=True))

    def value(n: str) -> Column:
        if n not in children:
            return F.col(f"`{n}`")
        return F.col(f"`_vector_{n}`") if children[n].kind == "llm-vector" else derived(F.col(f"`{n}`"), types[n], children[n], methods)

    cols = [value(n).alias(n) for n in names]
    keys = [f"_k{n}" for n in range(len(keys_of(f)))]
    order = order_columns(f.on_main)
    whole = cols[0] if "flat" in f.kind else F.struct(*cols)
    in_row = F.col(f"`{names[0]}`") if "flat" in f.kind else F.struct(*[F.col(f"`{n}`") for n in names])
    apart = any(children[n].kind in ("object", "llm-vector") for n in names if n in children)
    parts = [F.col(f"_o{n}").alias(f"r{n}") for n in range(len(order))] + ([in_row.alias("row"), whole.alias("value")] if apart else [whole.alias("row")])
    entry, final = F.struct(*parts), "value" if apart else "row"
    listed, falling = F.collect_list(entry), [descending for _, descending in order]
    if apart or any(falling):
        in_order = F.array_sort(listed, lambda x, y: _compared(x, y, falling))
        found = F.get(in_order, F.lit(0))[final] if f.kind.startswith("object") else F.transform(in_order, lambda e: e[final])
    else:
        # entries are structs and never null, so sort_array's order is that of array_sort, without an expression for each comparison
        found = F.min(entry)["row"] if f.kind.startswith("object") else F.sort_array(listed)["row"]
    return rows.groupBy(*keys).agg(found.alias(f.name))


def embedded(df: DataFrame, text_col: str, out_col: str, f: Field, models: Models, vectors: Vectors | None) -> DataFrame:
    """df with out_col, the vector of a text, within the limits that the field's parameters set."""
    model = _model(f, models)
    limit = limits(f.params).of(model)
    if vectors is not None:
        return vectors.embed(df, text_col, out_col, model, limit)
    return embed(df, text_col, out_col, model, request_size=limit.request_size, per_minute=limit.per_minute)


def build_view(
    spark: SparkSession,
    mapping: Mapping,
    *,
    only: DataFrame | None = None,
    fields: list[str] | None = None,
    methods: Methods | None = None,
    models: Models | None = None,
    where: str | None = None,
    analyser: Analyser | None = None,
    vectors: Vectors | None = None,
) -> DataFrame:
    """The documents of a mapping over the registered tables, one row each: _id, the main columns and the nested fields.

    only (_id) restricts it to some documents: the main query is semi-joined first and nested queries by the keys of
    what remains, so recomputing a few documents reads their rows only. where is a predicate on the main table's columns,
    which reaches its scan. fields restricts the nested fields. models are the embedding models of vector fields by name
    (a field's paramLlmVector names one in modelClass; the name "" stands for all others); requests keep to the size and the
    rate that the parameters set (models that compute in the task have no rate, see functions.embed.in_task). vectors keeps what models answered, and one rate for all who ask. Keys join by equality, so
    documents without nested rows have null, or an empty array."""
    analyser, methods = analyser or Analyser(spark), methods or {}
    q = analyser.query(mapping.sql)
    replaced = {q.main.alias: temporary(spark.table(q.main.table).filter(trim_where(where)))} if where else None
    docs = main_rows(spark, q, mapping, replaced)
    if only is not None:
        docs = _restricted(docs, q.item(mapping.pk).name, only)
    scalars = {f.name: f for f in mapping.scalars}
    wanted = [f for f in mapping.nested if fields is None or f.name in fields]
    order = [c for c in docs.columns if not c.startswith("_k_")] + [f.name for f in wanted]
    own_key = lambda f: [v.lower() for _, v in keys_of(f)] == [q.item(mapping.pk).columns[0][1].lower()]
    for f in sorted(wanted, key=own_key):  # those tied by the primary key last: documents then lie by their ids
        rows, names = nested_rows(spark, analyser, f, mapping)
        keys = [f"_k_{v}" for _, v in keys_of(f)]
        if own_key(f) and only is None and not where and _tied_by_id(q, mapping, docs.schema[keys[0]].dataType, rows.schema["_k0"].dataType):
            rows, keys = rows.withColumn("_k0", F.col("_k0").cast("string")), ["_id"]
        if only is not None or where:
            own = docs.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).distinct()
            rows = rows.join(own, [f"_k{n}" for n in range(len(keys))], "left_semi")
        values = nested_values(rows, names, f, mapping, methods, models, vectors)
        on = reduce(lambda a, b: a & b, [docs[k] == values[f"_k{n}"] for n, k in enumerate(keys)])
        kind = values.schema[f.name].dataType
        docs = docs.join(values, on, "left").drop(*[f"_k{n}" for n in range(len(keys))])
        if isinstance(kind, T.ArrayType):
            docs = docs.withColumn(f.name, F.coalesce(f.name, F.array().cast(kind)))
    for x in docs.schema.fields:
        if x.name in scalars and scalars[x.name].kind == "llm-vector":
            docs = embedded(docs, x.name, x.name, scalars[x.name], models or {}, vectors)
        elif x.name in scalars:
            docs = docs.withColumn(x.name, derived(F.col(f"`{x.name}`"), x.dataType, scalars[x.name], methods))
    return docs.select(*[f"`{c}`" for c in order])


def _tied_by_id(q: Query, mapping: Mapping, main: T.DataType, nested: T.DataType) -> bool:
    """Whether a nested key that equals the primary key also equals it as a text, as _id has it: whole numbers and texts do. A join by
    _id leaves the documents shuffled by their ids, so that what meets them by these next does not shuffle them again."""
    key, whole = q.item(mapping.pk), T.ByteType | T.ShortType | T.IntegerType | T.LongType
    own = key.plain and (key.columns[0][0] or q.main.alias).lower() == q.main.alias.lower()
    return own and (isinstance(main, whole) and isinstance(nested, whole) or main == nested == T.StringType())


def field_values(spark: SparkSession, mapping: Mapping, f: Field, only: DataFrame, analyser: Analyser, **how) -> DataFrame:
    """(_id, value of one nested field) for the documents of only (_id): the main table's keys and the field's own tables are
    read, and nothing else of the view. how: methods, models, vectors."""
    q = analyser.query(mapping.sql)
    pk = q.item(mapping.pk).columns[0][1]
    tied = [v for _, v in keys_of(f)]
    keys = [f"_k{n}" for n in range(len(tied))]
    main = spark.table(q.main.table)
    owners = _restricted(main.select(F.col(f"`{pk}`").alias("_pk"), *[F.col(f"`{v}`").alias(k) for v, k in zip(tied, keys, strict=True)]), "_pk", only)
    owners = owners.withColumn("_id", F.col("_pk").cast("string")).drop("_pk").distinct()
    rows, names = nested_rows(spark, analyser, f, mapping)
    rows = rows.join(owners.select(*keys).distinct(), keys, "left_semi")
    values = nested_values(rows, names, f, mapping, how.get("methods") or {}, how.get("models"), how.get("vectors"))
    out = owners.join(values, keys, "left").select("_id", f.name)
    kind = values.schema[f.name].dataType
    return out.withColumn(f.name, F.coalesce(f.name, F.array().cast(kind))) if isinstance(kind, T.ArrayType) else out


def _restricted(docs: DataFrame, key: str, only: DataFrame) -> DataFrame:
    """docs whose id is in only (_id). Whole numbers and texts are compared in the key's own type, so that the join reaches
    below the grouping and runtime filters reach the scan."""
    kind, ids = docs.schema[key].dataType, F.col("_id").cast("string")
    if not isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.StringType):
        return docs.join(only.select(ids.alias("_id")), "_id", "left_semi")
    wanted = only.select(ids.try_cast(kind).alias("_only"))
    return docs.join(wanted, F.col(f"`{key}`") == F.col("_only"), "left_semi")


def _model(f: Field, models: Models) -> Model:
    name = str({k.lower(): v for k, v in f.params.items()}.get("modelclass", ""))
    if name not in models and "" not in models:
        raise MappingError(f"{f.name}: no embedding model {name or 'at all'} is registered")
    return models.get(name, models.get(""))


def trim_where(text: str) -> str:
    """A user's predicate without the WHERE that it may begin with and the ; that it may end with."""
    return re.sub(r"^\s*(?:where\b)?\s*|[\s;]+$", "", text, flags=re.I)


def _typed(col: Column, kind: T.DataType, target) -> Column:
    """A value of any shape by its target: nested targets are dicts by child name."""
    if isinstance(kind, T.StructType) and isinstance(target, dict):
        inner = F.struct(*[_typed(col[f.name], f.dataType, target.get(f.name)).alias(f.name) for f in kind.fields])
        return F.when(col.isNotNull(), inner)
    if isinstance(kind, T.ArrayType) and (isinstance(target, dict) or not isinstance(kind.elementType, T.StructType) and target not in (None, "array")):
        return F.transform(col, lambda x: _typed(x, kind.elementType, target))
    name, formats = target if isinstance(target, tuple) else (target, None)
    return convert.to_target(col, kind, None if isinstance(name, dict) else name, formats)


def typed(docs: DataFrame, target: dict) -> DataFrame:
    """docs with their columns as an index's types have them: target gives a type, a type and its date formats, or for
    nested fields a dict of their children's. Lists of scalars are converted item by item."""
    return docs.select(*[F.col(x.name) if x.name == "_id" else _typed(F.col(f"`{x.name}`"), x.dataType, target.get(x.name)).alias(x.name) for x in docs.schema.fields])
