"""Stream sources, triggers and session settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BUCKETS = 256  # hash folders of tables that a batch looks few keys up in
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession, idle_inputs: str = "wait") -> SparkSession:
    """State on disk, and what an idle input does to the watermark of several.

    ``wait`` takes the slowest input: nothing is lost, but an input without data holds windows
    back. ``ignore`` takes the fastest: windows close on time, and rows of a slow input may be late.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min" if idle_inputs == "wait" else "max")
    return spark


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
               max_offsets: int | None = None) -> DataFrame:
    """Topic as a stream of (key, value, record_time); offsets live in the job's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).option("startingOffsets", starting)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return _records(reader.load())


def replay_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The whole topic from its beginning, as a batch."""
    return _records(spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest").load())


def _records(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                     F.col("timestamp").alias("record_time"))


def read_event_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Folder of JSON lines as a stream of (value, record_time)."""
    reader = spark.readStream.schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(path).select(
        "value", F.col("_metadata.file_modification_time").alias("record_time"))


def replay_event_files(spark: SparkSession, path: str) -> DataFrame:
    """The same folder as a batch."""
    return spark.read.schema("value string").text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("record_time"))


def job(writer: DataStreamWriter, checkpoint: str, every: str | None = "60 seconds") -> DataStreamWriter:
    """Checkpoint and trigger; ``every=None`` processes what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def bucket_of(key: str) -> Column:
    """Hash folder of a key."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
