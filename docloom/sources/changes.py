"""Sources of row changes: files of captured rows, and Kafka topics of JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import CHANGE, binlog_images, from_log

#: A message as capturers write it to Kafka: rows in data, their old values in old, side by side.
MESSAGE = (
    "database string, table string, type string, isDdl boolean, pkNames array<string>, es bigint, ts bigint, sql string, "
    "data array<map<string,string>>, old array<map<string,string>>, mysqlType map<string,string>"
)
#: Captured rows in files: full images and the columns that an update set.
CAPTURED = (
    "seq bigint, type string, is_ddl boolean, db string, table string, pk array<string>, es bigint, ts bigint, "
    "before map<string,string>, after map<string,string>, updated array<string>"
)


def from_messages(df: DataFrame) -> DataFrame:
    """Changes from Kafka rows (value, offset, and topic and partition where df has them): one row for each row image.

    DDL messages without rows are one change each, with their statement in sql and no images.
    seq is a struct (es, topic, partition, offset, idx), which no two row images share: by commit time, then by the
    message's place in the topics, then by the row's in the message. It orders, groups and compares like a number."""
    topic = (F.col("topic") if "topic" in df.columns else F.lit(None)).cast("string").alias("topic")
    partition = (F.col("partition") if "partition" in df.columns else F.lit(None)).cast("int").alias("partition")
    place = F.struct(topic, partition, F.col("offset").cast("bigint").alias("offset")).alias("place")
    m = df.select(place, F.from_json(F.col("value").cast("string"), MESSAGE).alias("m")).select("place", "m.*")
    rows = m.select("*", F.posexplode_outer("data").alias("idx", "row"))
    seq = F.struct("es", "place.topic", "place.partition", "place.offset", F.coalesce("idx", F.lit(0)).alias("idx"))
    old = F.when(F.size("old") > F.col("idx"), F.get("old", F.col("idx")))
    flat = rows.select(
        seq.alias("seq"), "type", F.col("isDdl").alias("is_ddl"), F.col("database").alias("db"), "table", F.col("pkNames").alias("pk"), "es", "ts",
        F.col("row").alias("data"), old.alias("old"), "sql",
    )
    return from_log(flat.filter("data is not null or is_ddl"))


def kafka_changes(spark: SparkSession, servers: str, topics: str, *, stream: bool = True, starting: str = "latest", per_trigger: int | None = None, fail_on_loss: bool = True) -> DataFrame:
    """Changes from Kafka topics, ordered by their seq. starting "latest" with a new checkpoint discards a backlog: documents
    are then as the load or rebuild left them, and every later batch is applied (see DocumentStream). A stream whose messages
    expired fails unless fail_on_loss is off; supervised() can rebuild then."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    reader = reader.option("startingOffsets", starting if stream else "earliest").option("failOnDataLoss", str(fail_on_loss).lower())
    if per_trigger and stream:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return from_messages(reader.load())


def captured_changes(df: DataFrame) -> DataFrame:
    """Changes from captured rows (CAPTURED)."""
    return from_log(binlog_images(df))


def file_changes(spark: SparkSession, path: str, *, stream: bool = True, files_per_trigger: int = 1) -> DataFrame:
    """Changes (CHANGE) from a folder of JSON files that a capturer lands."""
    if stream:
        return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(CHANGE).json(path)


def jdbc_table(spark: SparkSession, url: str, table: str, pk: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A relational table, read in ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=pk, lowerBound=low, upperBound=high, numPartitions=partitions, **options)
    return reader.load()
