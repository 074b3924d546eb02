"""Conversions of source values to document values. All are built-in column expressions, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Date formats that a target may list, the preferred first.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
# Texts that a boolean field reads as true, false and null.
TRUE_TEXTS = ("true", "TRUE", "1", "Y", "y", "T")
FALSE_TEXTS = ("false", "FALSE", "0", "N", "F", "f")
NULL_TEXTS = ("", "null", "NULL")


def _strip_trailing_empty(parts: Column) -> Column:
    """Trailing empty strings go, unless the array is one empty string."""
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, F.lit(1), last))


def split_field(col: Column, pattern: str, element_type: str = "string") -> Column:
    """Text cut by a regular expression; null and '' give null, trailing empty parts go."""
    parts = _strip_trailing_empty(F.split(col, pattern))
    if element_type != "string":
        parts = F.transform(parts, lambda x: x.try_cast(element_type))
    return F.when(col.isNotNull() & (col != ""), parts)


def json_field(col: Column) -> Column:
    """A JSON object as a map of texts; null stays null."""
    return F.from_json(col, "map<string,string>")


def bool_field(col: Column, kind: T.DataType) -> Column:
    """The boolean of a derived field: numbers are true if 1; a few texts count; other texts are null (a strict reader would fail)."""
    if isinstance(kind, T.BooleanType):
        return col
    if isinstance(kind, NUMERIC):
        return col.cast("bigint") == 1
    return F.when(col.isin(*TRUE_TEXTS), True).when(col.isin(*FALSE_TEXTS), False)


def bool_target(col: Column, kind: T.DataType) -> Column:
    """The boolean of a target type: numbers are true unless 0; the text true in any case is true, other texts false."""
    if isinstance(kind, T.BooleanType):
        return col
    if isinstance(kind, NUMERIC):
        return col.cast("bigint") != 0
    return F.lower(col) == "true"


def wrap_integer(col: Column, bits: int) -> Column:
    """A whole number narrowed to bits as two's complement, as a narrowing conversion does: no overflow error."""
    span, half = (F.lit(str(1 << b)).cast("decimal(38,0)") for b in (bits, bits - 1))
    name = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits]
    return (F.pmod(col.cast("decimal(38,0)") + half, span) - half).cast(name)


def integer_target(col: Column, kind: T.DataType, bits: int) -> Column:
    name = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits]
    if isinstance(kind, T.FloatType | T.DoubleType):
        # floats saturate at the int or long range first, then narrow
        wide = 32 if bits < 64 else 64
        low, high = -(1 << (wide - 1)), (1 << (wide - 1)) - 1
        least, most = F.lit(str(low)).cast("bigint"), F.lit(high).cast("bigint")
        whole = F.when(F.isnan(col), F.lit(0)).when(col <= float(low), least).when(col >= float(high), most).otherwise(col.try_cast("bigint"))
        return F.when(col.isNotNull(), wrap_integer(whole, bits))
    if isinstance(kind, T.DecimalType):
        return wrap_integer(F.when(col < 0, F.ceil(col)).otherwise(F.floor(col)), bits)
    if isinstance(kind, NUMERIC):
        return wrap_integer(col, bits)
    return col.cast("string").try_cast(name)


def parse_date(col: Column) -> Column:
    """A lenient date: 10 or 13 digits are epoch seconds or milliseconds; otherwise the groups of digits are year, month,
    day, hour, minute and second; out of range or without digits gives null. Hour 24 is the next day's 0, as are days
    beyond a month's end."""
    text = F.trim(col)
    groups = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), 0), lambda x: x.try_cast("int"))

    def stamp(n: Column) -> Column:
        at = lambda i, default: F.coalesce(F.get(n, F.lit(i)), F.lit(default))
        ok = (
            (F.size(n) > 0) & at(0, 0).between(1900, 2999) & at(1, 1).between(1, 12) & at(2, 1).between(1, 31)
            & at(3, 0).between(0, 24) & at(4, 0).between(0, 59) & at(5, 0).between(0, 59)
        )
        day = F.date_add(F.make_date(at(0, 1970), at(1, 1), F.lit(1)), at(2, 1) - 1)
        seconds = at(3, 0) * 3600 + at(4, 0) * 60 + at(5, 0)
        return F.when(ok, F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds))

    # a lambda's argument is computed once, where a column would be for each of its uses
    read = F.get(F.transform(F.array(groups), stamp), F.lit(0))
    epoch = F.when(F.length(text) == 10, F.timestamp_millis(text.try_cast("bigint") * 1000)).otherwise(F.timestamp_millis(text.try_cast("bigint")))
    return F.when(F.length(text).isin(10, 13) & text.rlike(r"^\d+$"), epoch).otherwise(read)


def format_date(col: Column, formats: str | None) -> Column:
    """A time as a target's format list (joined by ||) has it: a single format is used; else the first of DATE_FORMATS that
    it lists, else epoch_millis. Without any, the shortest of date, seconds and milliseconds that keeps the value."""
    listed = [f.strip() for f in formats.split("||")] if formats else []
    ts = col.cast("timestamp")
    if len(listed) == 1 and listed[0] != "epoch_millis":
        return F.date_format(ts, listed[0])
    for f in DATE_FORMATS:
        if f in listed:
            return F.date_format(ts, f)
    if "epoch_millis" in listed:
        return F.unix_millis(ts).cast("string")
    midnight = F.date_trunc("day", ts) == ts
    whole = F.date_trunc("second", ts) == ts
    return F.when(midnight, F.date_format(ts, DATE_FORMATS[2])).when(whole, F.date_format(ts, DATE_FORMATS[1])).otherwise(F.date_format(ts, DATE_FORMATS[0]))


def date_target(col: Column, kind: T.DataType, formats: str | None) -> Column:
    """Times, epoch milliseconds, and texts like yyyy-MM-dd HH:mm:ss..., yyyy-MM-dd, yyyy-MM or yyyy; other texts stay."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return format_date(col, formats)
    if isinstance(kind, T.LongType):
        return format_date(F.timestamp_millis(col), formats)
    text = F.trim(col.cast("string"))
    shaped = text.rlike(r"^.{4}-.{2}-.{2} .{2}:.{2}:.{2}") | text.rlike(r"^.{4}-.{2}-.{2}$") | text.rlike(r"^.{4}-.{2}$") | text.rlike(r"^.{4}$")
    return F.coalesce(F.when(shaped, format_date(parse_date(text), formats)), col.cast("string"))


def binary_target(col: Column, kind: T.DataType) -> Column:
    return F.base64(col) if isinstance(kind, T.BinaryType) else F.base64(F.encode(col, "ISO-8859-1"))


def geo_target(col: Column) -> Column:
    """'lat,lon' as a struct; null without a comma."""
    part = F.split(col, ",")
    return F.when(F.contains(col, F.lit(",")), F.struct(F.get(part, F.lit(0)).try_cast("double").alias("lat"), F.get(part, F.lit(1)).try_cast("double").alias("lon")))


def array_target(col: Column) -> Column:
    """Text cut at the first of , ; | - that it holds; blank gives an empty array."""
    mark = F.when(F.contains(col, F.lit(",")), F.lit(",")).when(F.contains(col, F.lit(";")), F.lit(";")).when(F.contains(col, F.lit("|")), F.lit("\\|")).when(F.contains(col, F.lit("-")), F.lit("-")).otherwise(F.lit(","))
    return F.when(F.trim(col) == "", F.array().cast("array<string>")).otherwise(_strip_trailing_empty(F.split(col, mark)))


def plain_decimal(col: Column) -> Column:
    """A decimal as text without an exponent or trailing zeros."""
    text = col.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def join_values(*cols: Column, separator: str = ",") -> Column:
    """Texts joined, null and '' left out."""
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), separator)


def is_blank(col: Column) -> Column:
    """Null, empty, or white space only."""
    return col.isNull() | ~col.rlike(r"[^\s\x1C-\x1F]")


def is_number(col: Column) -> Column:
    """A text of ASCII digits only, one at least."""
    return F.coalesce(col.rlike("^[0-9]+$"), F.lit(False))


def ascii_only(col: Column) -> Column:
    """A text for a header line: double quotes become single ones, colons hyphens, and what is not printable ASCII goes."""
    return F.regexp_replace(F.translate(col, '":', "'-"), r"[^\x20-\x7E]", "")


def to_target(col: Column, kind: T.DataType, target: str | None, formats: str | None = None) -> Column:
    """A value as a target type has it; without a target, times become text and numbers and booleans stay."""
    match target:
        case "keyword" | "text":
            return col.cast("string")
        case "byte" | "short" | "integer" | "long":
            return integer_target(col, kind, {"byte": 8, "short": 16, "integer": 32, "long": 64}[target])
        case "double":
            return col.try_cast("double")
        case "float" | "half_float" | "scaled_float":
            return col.try_cast("float")
        case "boolean":
            return bool_target(col, kind)
        case "date":
            return date_target(col, kind, formats)
        case "binary":
            return binary_target(col, kind)
        case "geo_point":
            return geo_target(col)
        case "array":
            return array_target(col)
        case "object":
            return F.when(F.trim(col) == "", F.create_map().cast("map<string,string>")).otherwise(json_field(col))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.date_format(col.cast("timestamp"), DATE_FORMATS[0])
    if isinstance(kind, (*NUMERIC, T.BooleanType, T.ArrayType, T.MapType, T.StructType)):
        return col
    return col.cast("string")
