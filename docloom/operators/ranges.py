"""Ranges, pages and windows: how full loads are cut into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_range(spark: SparkSession, low: int, high: int, n: int) -> DataFrame:
    """part, low and high (inclusive) of n near equal segments of [low, high]; the first ones take the remainder. One segment
    if n or the span is at most one; none if low > high. A segment of one value ends one further."""
    if low > high:
        return spark.range(0).selectExpr("id as part", "id as low", "id as high")
    span = high - low + 1
    n = 1 if n <= 1 or high - low <= 1 else min(n, span)
    size, rest = divmod(span, n)
    parts = spark.range(n).withColumnRenamed("id", "part")
    start = F.lit(low) + F.col("part") * size + F.least(F.col("part"), F.lit(rest))
    end = start + size - 1 + (F.col("part") < rest).cast("int")
    return parts.select("part", start.cast("bigint").alias("low"), F.when(end > start, end).otherwise(start + 1).cast("bigint").alias("high"))


def key_bounds(df: DataFrame, pk: str) -> DataFrame:
    """The least and greatest key; 0 for an empty table."""
    return df.agg(F.coalesce(F.min(pk), F.lit(0)).alias("low"), F.coalesce(F.max(pk), F.lit(0)).alias("high"))


def keyset_page(df: DataFrame, pk: str, after=None, limit: int = 500, upto=None) -> DataFrame:
    """The next rows by key after a key; a limit of one asks for that very key. Keys may be numbers or texts."""
    if limit == 1 and after is not None:
        return df.filter(F.col(pk) == after)
    out = df if after is None else df.filter(F.col(pk) > after)
    out = out if upto is None else out.filter(F.col(pk) <= upto)
    return out.orderBy(pk).limit(limit)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page number (from 1) in an order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_after(docs: DataFrame, cursor: str | None, size: int, include: list[str] | None = None) -> DataFrame:
    """The next documents by id; with include, those columns only."""
    out = docs if cursor is None else docs.filter(F.col("_id") > cursor)
    out = out.orderBy("_id").limit(size)
    return out.select("_id", *include) if include is not None else out


def date_windows(df: DataFrame, time: str, start, width_ms: int = 600_000, *, nearest: bool = False) -> DataFrame:
    """df with window_no and window_start: half-open windows of width_ms counted from start; earlier rows are left out.

    Times without a zone are counted as they are written, whatever the session's zone, so that none falls into the hour that
    a change to summer time leaves out. Finer times count as the millisecond that they lie in; with nearest as the nearest one (of
    two the later), as SQL's epoch_ms and stores of milliseconds have them, so that the last half of one counts to the next window."""
    column, begin = F.col(time), F.lit(start)
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        begin = begin.cast("timestamp_ntz")

        def millis(c: Column) -> Column:
            seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            part = F.date_part(F.lit("SECOND"), c) * 1000
            return seconds * 1000 + (F.round(part).cast("bigint") if nearest else F.floor(part))

    else:
        column, begin = column.cast("timestamp"), begin.cast("timestamp")

        def millis(c: Column) -> Column:
            late = F.pmod(F.unix_micros(c), F.lit(1000)) >= 500
            return F.unix_millis(c) + late.cast("int") if nearest else F.unix_millis(c)

    offset = millis(column) - millis(begin)
    n = F.floor(offset / width_ms)
    stamp = begin + F.make_dt_interval(secs=n * width_ms / F.lit(1000).cast("decimal(4,0)"))
    return df.filter(column >= begin if nearest else offset >= 0).withColumn("window_no", n.cast("bigint")).withColumn("window_start", stamp)


def chunked(df: DataFrame, order: list[str], size: int, within: list[str]) -> DataFrame:
    """df with chunk: the rows of each group (within) in runs of size, so that no task orders more than a group."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def lookup(keys: DataFrame, view: DataFrame, on: str, values: list[str], out: str = "rows") -> DataFrame:
    """Each distinct key with the view's rows for it, an empty list if there are none: many point queries as one join."""
    found = view.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*values))).alias(out))
    joined = keys.select(on).distinct().join(found, on, "left")
    kind = found.schema[out].dataType
    return joined.withColumn(out, F.coalesce(out, F.array().cast(kind)))
