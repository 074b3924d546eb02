"""A training corpus from documents: quality rules, line dedup, near-dedup, decontamination, tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe import bpe_digests
from docloom.llm.common import written
from docloom.llm.decontam import uncontaminated
from docloom.llm.linededup import without_repeated_lines
from docloom.llm.neardup import one_of_each
from docloom.llm.quality import keep_good
from docloom.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or cross-document line frequency reject go, and so do lines above the limit."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; documents left without a word go."""
    return without_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays."""
    return one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its tokens and of the text decoded from them."""
    return bpe_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("byte_bpe", tokens)]

#: Near-dedup and the tokens are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
