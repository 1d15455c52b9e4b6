"""Training-data pipeline over documents: quality, near copies, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import minhash, mixing, packing, quality, substrings
from kerbside.llm.common import remainder, settings
from kerbside.llm.queries import tokenizer_path
from kerbside.session import scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = settings(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, learn=remainder(F.col("doc_id"), 5) != 0, threshold=0.3)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    settings(spark)
    return minhash.keep_one(docs, k=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur before, in any document."""
    settings(spark)
    return substrings.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as documents: repeated, cut or left out as their source's target asks."""
    settings(spark)
    return mixing.materialise(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences, with their ids."""
    settings(spark)
    return packing.pack(docs, tokenizer_path(), keep_ids=True)


STAGES = [("quality", good), ("near_duplicates", distinct), ("repeated_passages", without_repeats),
          ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None  # learned scores, hash orders and tokens: the tests compare it with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settings(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
