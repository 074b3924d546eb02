import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import convert
from docloom.functions.embed import embed, hashed_model
from docloom.functions.equality import field_equal, list_equal, value_equal

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def one(spark, value, kind, f):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, expected", [(None, None), ("", None), ("a,b,,", ["a", "b"]), ("a,,b", ["a", "", "b"]), (",", []), ("x", ["x"])])
def test_split_field(spark, value, expected):
    assert one(spark, value, S, lambda c: convert.split_field(c, ",")) == expected


def test_split_typed(spark):
    assert one(spark, "1;2;x", S, lambda c: convert.split_field(c, "[;]", "int")) == [1, 2, None]


@pytest.mark.parametrize("value, expected", [("true", True), ("T", True), ("t", None), ("N", False), ("n", None), ("", None), ("NULL", None), ("0", False)])
def test_bool_field_text(spark, value, expected):
    assert one(spark, value, S, lambda c: convert.bool_field(c, S)) is expected


def test_two_booleans(spark):
    assert one(spark, 2, L, lambda c: convert.bool_field(c, L)) is False
    assert one(spark, 2, L, lambda c: convert.bool_target(c, L)) is True
    assert one(spark, "TRUE", S, lambda c: convert.bool_target(c, S)) is True


@pytest.mark.parametrize("value, bits, expected", [(300, 8, 44), (128, 8, -128), (70000, 16, 4464), (2**31, 32, -(2**31)), (-129, 8, 127)])
def test_integers_wrap(spark, value, bits, expected):
    assert one(spark, value, L, lambda c: convert.integer_target(c, L, bits)) == expected


def test_floats_saturate_then_narrow(spark):
    assert one(spark, 1e20, D, lambda c: convert.integer_target(c, D, 32)) == 2**31 - 1
    assert one(spark, -3.9, D, lambda c: convert.integer_target(c, D, 64)) == -3
    assert one(spark, float("nan"), D, lambda c: convert.integer_target(c, D, 32)) == 0


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2024-02-03 04:05:06.789", dt.datetime(2024, 2, 3, 4, 5, 6)), ("2024/2/3", dt.datetime(2024, 2, 3)), ("2024-02", dt.datetime(2024, 2, 1)), ("2024", dt.datetime(2024, 1, 1)),
        ("1700000000", dt.datetime(2023, 11, 14, 22, 13, 20)), ("1700000000123", dt.datetime(2023, 11, 14, 22, 13, 20, 123000)), ("2024-01-31 24:00", dt.datetime(2024, 2, 1)),
        ("2024-02-31", dt.datetime(2024, 3, 2)), ("1899-01-01", None), ("2024-13", None), ("null", None), ("", None), (None, None), ("x", None),
    ],
)
def test_parse_date(spark, value, expected):
    assert one(spark, value, S, lambda c: convert.parse_date(c).cast("timestamp_ntz")) == expected


def test_date_formats(spark):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    kind = T.TimestampNTZType()
    assert one(spark, ts, kind, lambda c: convert.format_date(c, "yyyy-MM-dd HH:mm:ss || epoch_millis")) == "2024-01-02 03:04:05"
    assert one(spark, ts, kind, lambda c: convert.format_date(c, "x || epoch_millis")) == "1704164645678"
    assert one(spark, ts, kind, lambda c: convert.format_date(c, None)) == "2024-01-02 03:04:05.678"
    assert one(spark, ts.replace(microsecond=0), kind, lambda c: convert.format_date(c, None)) == "2024-01-02 03:04:05"
    assert one(spark, dt.datetime(2024, 1, 2), kind, lambda c: convert.format_date(c, None)) == "2024-01-02"
    assert one(spark, "soon", S, lambda c: convert.date_target(c, S, None)) == "soon"
    assert one(spark, "2024-01", S, lambda c: convert.date_target(c, S, None)) == "2024-01-01"


def test_small_targets(spark):
    assert one(spark, "é", S, lambda c: convert.binary_target(c, S)) == "6Q=="
    assert one(spark, "1.5,2", S, convert.geo_target) == (1.5, 2.0)
    assert one(spark, "12", S, convert.geo_target) is None
    assert one(spark, "a|b", S, convert.array_target) == ["a", "b"] and one(spark, " ", S, convert.array_target) == []
    assert one(spark, decimal.Decimal("10.500"), T.DecimalType(9, 3), convert.plain_decimal) == "10.5"
    assert one(spark, decimal.Decimal("100"), T.DecimalType(9, 0), convert.plain_decimal) == "100"
    assert one(spark, '{"a": 1}', S, lambda c: convert.to_target(c, S, "object")) == {"a": "1"}


@pytest.mark.parametrize(
    "a, ka, b, kb, same",
    [
        (None, S, "", S, True), ("", S, "x", S, False), (1, L, 1.9, D, True), (1, L, "1", S, True), (1.0, D, 1, L, True), ("1.50", S, 1.5, D, True), (True, B, "1", S, True), (False, B, None, S, False),
        (dt.datetime(2024, 1, 2), T.TimestampNTZType(), "2024-01-02", S, True), (dt.datetime(2024, 1, 2), T.TimestampNTZType(), "2024-01-03", S, False), ("a", S, "a", S, True), (None, L, None, L, True),
    ],
)
def test_value_equal(spark, a, ka, b, kb, same):
    df = spark.createDataFrame([(a, b)], T.StructType([T.StructField("a", ka), T.StructField("b", kb)]))
    assert df.select(value_equal(F.col("a"), ka, F.col("b"), kb).alias("r")).first()["r"] is same


def test_lists(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"], ["b", "a", "a"])], "a array<string>, b array<string>, c array<string>")
    r = df.select(list_equal(F.col("a"), S, F.col("b"), S, False), list_equal(F.col("a"), S, F.col("c"), S, True), list_equal(F.col("a"), S, F.lit(None).cast("array<string>"), S, True)).first()
    assert tuple(r) == (True, False, False)


def test_struct_lists_are_multisets(spark):
    df = spark.createDataFrame([([(1, "x"), (2, None)], [(2, ""), (1, "x")])], "a array<struct<i:bigint,s:string>>, b array<struct<i:bigint,s:string>>")
    kind = df.schema["a"].dataType
    r = df.select(field_equal(F.col("a"), kind, F.col("b"), kind), field_equal(F.col("a"), kind, F.col("b"), kind, True)).first()
    assert tuple(r) == (True, False)


def test_embed(spark):
    df = spark.createDataFrame([(1, " a "), (2, "a"), (3, " "), (4, None)], "id int, text string")
    rows = {r["id"]: r["v"] for r in embed(df, "text", "v", hashed_model(8)).collect()}
    assert rows[1] == rows[2] and len(rows[1]) == 8 and rows[3] is None and rows[4] is None
