"""Helpers that the operators share: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = bytes(range(0x41, 0x5B))
ASCII_LOWER = bytes(range(0x61, 0x7B))
LOWER = bytes.maketrans(ASCII_UPPER, ASCII_LOWER)
#: The white space of the contracts: [\x20\x09-\x0D]. bytes.split() and bytes.strip() use the same set.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where all run in one process, and it is
    unset, a temporary folder takes its place; on a cluster a folder of one machine would be empty on the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/docloom-{kind}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read again.

    This cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add: the operator's own columns win."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of constants, as an expression; there must be a row."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


#: The largest bitmap: 2**31 places are 256 MB.
MOST_BITS = 31


def bits_for(keys: int, least: int = 15) -> int:
    """The size of a bitmap for so many keys, as a power of two: 16 places a key, up to MOST_BITS."""
    return min(MOST_BITS, max(least, (16 * max(1, keys) - 1).bit_length()))


def bitmap(rows: DataFrame, place: Column) -> DataFrame:
    """The places (from 0) of rows as a bitmap: bucket and bitmap, 4 KB for each run of 32768 places that holds one."""
    at = rows.select(F.bitmap_bucket_number(place + 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("bit"))
    return at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def split_marked(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two parts by a 64-bit key, which is not null: (may be among keys, is not among keys). keys has one column.

    A bitmap of the keys goes to the tasks, sized by their number but never above MOST_BITS, so no row of docs is
    shuffled to be split. As it fills up more rows fall into the first part, never fewer: an exact join of that part
    must follow, and what is in the second needs none."""
    keys = keys.toDF("key")
    bits = bits_for(keys.count())
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    marks = F.broadcast(bitmap(keys, place(F.col("key"))))  # 2**(bits - 3) bytes at most
    number, map_, at = free_name(docs, "bucket"), free_name(docs, "bitmap"), free_name(docs, "bit")
    rows = docs.withColumn(number, F.bitmap_bucket_number(place(key) + 1)).withColumn(at, F.bitmap_bit_position(place(key) + 1))
    rows = rows.join(marks.toDF(number, map_), number, "left")
    byte = F.conv(F.hex(F.substring(map_, (F.floor(F.col(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return rows.filter(hit).select(*own), rows.filter(~hit).select(*own)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most rows rows and about size bytes, so that what a task makes of them stays small."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
