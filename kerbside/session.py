"""Session helpers shared by batch and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Partition counts stay with the deployment and AQE."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of this machine.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    path = "/tmp/kerbside-checkpoints"
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; every call gives a new one."""
    return f"{shared_dir(spark)}/kerbside/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = 100_000, weight: Column | None = None) -> DataFrame:
    """Hint a broadcast only after counting; beyond the bound the join stays a shuffle join.

    Counts rows, stopping at ``limit + 1``, so it is cheap on a large side too. For rows of very
    different size give their ``weight``, e.g. the vertices of a polygon; its sum is bounded then.
    """
    if weight is None:
        size = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"))
    else:
        size = df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n"))
    return F.broadcast(df) if size.first()["n"] <= limit else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that is computed exactly once per row. Batch or stream.

    A plain withColumn is inlined into every later use, and a filter on it is pushed below and
    evaluates it again. A one-element explode gives the same row and stops both.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Use idle cores: deal the rows of a scan with fewer splits than cores to all of them.

    For work that is heavy per row on an input of few, unsplittable files. An input with enough
    splits, the usual case on a cluster, is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
