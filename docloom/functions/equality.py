"""When a document's value counts as equal to its source's: one expression for each pair of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .convert import NUMERIC, bool_field, plain_decimal

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def is_empty(col: Column, kind: T.DataType) -> Column:
    """Null, '', an empty array and an empty map are the same emptiness."""
    if isinstance(kind, T.StringType):
        return col.isNull() | (col == "")
    if isinstance(kind, T.ArrayType | T.MapType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()


def same_number(a: Column, b: Column) -> Column:
    """Whether two texts are one number: whole numbers of up to 38 digits exactly, others as doubles; null if one is no number."""
    whole = r"^\s*[+-]?[0-9]{1,38}\s*$"
    exact = a.try_cast("decimal(38,0)") == b.try_cast("decimal(38,0)")
    return F.when(a.rlike(whole) & b.rlike(whole), exact).otherwise(a.try_cast("double") == b.try_cast("double"))


def _as_text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _TIMES):
        return F.date_format(col.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    return col.cast("string") if isinstance(kind, T.StringType) else F.lit("")


def value_equal(source: Column, source_kind: T.DataType, doc: Column, doc_kind: T.DataType) -> Column:
    """Equality of scalars: emptiness first, then by booleans, times (the shorter text is a prefix), whole numbers (a
    document's fraction is cut off), floats, and text."""
    if isinstance(source_kind, T.BooleanType) or isinstance(doc_kind, T.BooleanType):
        same = bool_field(source, source_kind).eqNullSafe(bool_field(doc, doc_kind))
    elif isinstance(source_kind, _TIMES) or isinstance(doc_kind, _TIMES):
        a, b = _as_text(source, source_kind), _as_text(doc, doc_kind)
        n = F.least(F.length(a), F.length(b))
        same = F.substring(a, 1, n) == F.substring(b, 1, n)
    elif isinstance(doc_kind, T.StructType):
        part = F.split(source.cast("string"), ",")
        lat, lon = doc_kind.names[:2]
        same = (F.get(part, F.lit(0)).try_cast("double") == doc[lat]) & (F.get(part, F.lit(1)).try_cast("double") == doc[lon])
    elif isinstance(source_kind, _WHOLE):
        whole = doc.try_cast("bigint") if isinstance(doc_kind, (*NUMERIC, T.StringType)) else F.lit(None)
        same = whole == source.cast("bigint")
    elif isinstance(doc_kind, _WHOLE):
        same = same_number(source.cast("string"), doc.cast("string"))
    elif isinstance(doc_kind, _FLOATS) or isinstance(source_kind, _FLOATS):
        same = source.try_cast("double") == doc.try_cast("double")
    else:
        same = source.cast("string") == doc.cast("string")
    a, b = is_empty(source, source_kind), is_empty(doc, doc_kind)
    return F.when(a & b, True).when(a | b, False).otherwise(F.coalesce(same, F.lit(False)))


def item_text(col: Column, kind: T.DataType) -> Column:
    """A list item as text: 1.0 and 1 are the same."""
    return plain_decimal(col.cast("decimal(38,12)")) if isinstance(kind, (*_FLOATS, T.DecimalType)) else col.cast("string")


def list_equal(source: Column, source_item: T.DataType, doc: Column, doc_item: T.DataType, ordered: bool) -> Column:
    """Scalar lists: sizes are equal, and either items pair up in order, or each of the document's is among the source's."""
    a, b = (F.transform(c, lambda x, k=k: item_text(x, k)) for c, k in ((source, source_item), (doc, doc_item)))
    same = (a == b) if ordered else F.forall(b, lambda x: F.exists(a, lambda y: y.eqNullSafe(x)))
    both = F.when(F.size(source) != F.size(doc), False).otherwise(same)
    return F.when(source.isNull() & doc.isNull(), True).otherwise(F.coalesce(both, F.lit(False)))


def field_equal(source: Column, source_kind: T.DataType, doc: Column, doc_kind: T.DataType, ordered: bool = False) -> Column:
    """Equality of fields of any type. Nested structs compare child by child; lists of structs in order, or as multisets."""
    if isinstance(source_kind, T.StructType) and isinstance(doc_kind, T.StructType):
        parts = [field_equal(source[f.name], f.dataType, doc[f.name], doc_kind[f.name].dataType, ordered) for f in source_kind.fields if f.name in doc_kind.names]
        same = F.lit(True)
        for p in parts:
            same &= p
        return F.when(source.isNull() & doc.isNull(), True).when(source.isNull() | doc.isNull(), False).otherwise(same)
    if isinstance(source_kind, T.ArrayType) and isinstance(doc_kind, T.ArrayType):
        a, b = source_kind.elementType, doc_kind.elementType
        if isinstance(a, T.StructType):
            left, right = (c if ordered else F.array_sort(c) for c in (source, doc))
            pairs = F.zip_with(left, right, lambda x, y: field_equal(x, a, y, b, ordered))
            same = F.when(F.size(source) != F.size(doc), False).otherwise(F.forall(pairs, lambda x: x))
            empty_a, empty_b = is_empty(source, source_kind), is_empty(doc, doc_kind)
            return F.when(empty_a & empty_b, True).when(empty_a | empty_b, False).otherwise(same)
        return list_equal(source, a, doc, b, ordered)
    return value_equal(source, source_kind, doc, doc_kind)
