"""Writers and keyed tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import tables


def write_curated(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Curated trips by month, file sizes capped by rows.

    The rebalance hint gathers a month into few files and, at run time, splits a month that is too
    large for one task; without it every task would write a small file into every month.
    """
    df.hint("rebalance", "year_month").write.mode("overwrite").partitionBy("year_month").option(
        "compression", "snappy").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_kpi(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("city").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


_NAMED_PARTITIONS = 1000


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str],
                 partition_by: list[str]) -> None:
    """Merge updates into a partitioned Parquet table, rewriting only the partitions they touch.

    The partition columns must be part of the keys, so a key never moves between partitions; null is
    a value like any other, in keys and partitions. The
    values the updates touch, counted and then named in a filter, prune the scan to the partitions
    that are rewritten; dynamic overwrite replaces exactly those, and running the same updates again
    gives the same table. Updates over more values than ``_NAMED_PARTITIONS`` scan them by a join.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be part of the keys")
    target = spark.read.parquet(path)
    touched = updates.select(*partition_by).distinct()
    values = touched.limit(_NAMED_PARTITIONS + 1).collect()
    if len(values) <= _NAMED_PARTITIONS:
        for c in partition_by:
            named = {r[c] for r in values}
            among = F.col(c).isin(list(named - {None}))
            target = target.where(among | F.col(c).isNull() if None in named else among)
    touched = touched.select(*[F.col(c).alias(f"_touched_{c}") for c in partition_by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_touched_{c}")) for c in partition_by])
    affected = target.join(touched, same, "left_semi")
    merged = tables.upsert(affected, updates, keys, order).hint("rebalance", *partition_by)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Idempotent append for foreachBatch: a replayed batch replaces its own folder as a whole.

    Whatever an earlier try wrote goes, also partitions the new rows don't touch and also when there
    are no rows now. Readers see ``batch_id`` as a partition column.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


_FOLDED = "_folded"  # beside the batches; names that start with an underscore are no data to other readers


def _files(spark: SparkSession, path: str):
    """(file system of a path, its Path class), by Hadoop's client: any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders and files in a folder."""
    fs, Path = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(Path(path))] if fs.exists(Path(path)) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("version-")) for n in _names(spark, f"{path}/{_FOLDED}") if n.startswith("version-"))


def folded(spark: SparkSession, path: str) -> dict | None:
    """The fold that readers see: ``upto``, the last batch in it, and ``rows``, its folder; None before the first."""
    versions = _versions(spark, path)
    if not versions:
        return None
    return json.loads(spark.read.text(f"{path}/{_FOLDED}/version-{versions[-1]}", wholetext=True).first()["value"])


def batch_ids(spark: SparkSession, path: str, after: int = -1) -> list[int]:
    """Batches that have a folder, later than ``after``."""
    found = (int(n.removeprefix("batch_id=")) for n in _names(spark, path) if n.startswith("batch_id="))
    return sorted(n for n in found if n > after)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Every row of a table that grows by batches: those of the current fold, with the fold's last batch
    as batch_id, and those of the batches after it."""
    fold = folded(spark, path)
    if fold is None:
        return spark.read.parquet(path)
    rows = spark.read.parquet(f"{path}/{_FOLDED}/{fold['rows']}").withColumn("batch_id", F.lit(fold["upto"]))
    later = batch_ids(spark, path, fold["upto"])
    if not later:
        return rows
    batches = spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in later])
    return rows.unionByName(batches, allowMissingColumns=True)


def fold_batches(spark: SparkSession, path: str, upto: int, keys: list[str], order: list[str],
                 partition_by: list[str] | None = None, alive: Column | None = None) -> None:
    """Housekeeping of an appended table: batches up to ``upto`` become one fold, last write per key.

    The fold is written into a folder of its own and then published by renaming a small file onto a
    new version number. Before that readers see the batches, after it the fold; a fold that is killed
    is a folder nobody reads. Batches stay until ``sweep``, so a reader that began before isn't hurt.
    Rows that aren't ``alive`` any more stay behind. Call it for batches that are committed, i.e.
    won't be replayed; folding up to a batch that is folded already does nothing.
    """
    fold = folded(spark, path)
    if fold is not None and upto <= fold["upto"]:
        return
    old = read_table(spark, path).where(F.col("batch_id") <= upto)
    rows = tables.latest_per_key(old, keys, [*order, "batch_id"]).drop("batch_id")
    rows = rows if alive is None else rows.where(alive)
    folder = f"rows-{upto}-{uuid.uuid4().hex[:8]}"
    writer = (rows.hint("rebalance", *partition_by) if partition_by else rows).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{_FOLDED}/{folder}")
    _publish(spark, path, {"upto": upto, "rows": folder})


def _publish(spark: SparkSession, path: str, fold: dict) -> None:
    fs, Path = _files(spark, path)
    number = max(_versions(spark, path), default=0) + 1
    draft = Path(f"{path}/{_FOLDED}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(fold).encode()))
    out.close()
    if not fs.rename(draft, Path(f"{path}/{_FOLDED}/version-{number}")):
        raise RuntimeError(f"another fold of {path} was published as version {number}")


def sweep(spark: SparkSession, path: str) -> int:
    """Remove what the current fold replaces, whole folders: its batches, earlier folds, and folds that
    were killed. Call it when readers that began before the fold are done. The number of folders removed."""
    fold = folded(spark, path)
    if fold is None:
        return 0
    fs, Path = _files(spark, path)
    gone = [f"{path}/batch_id={n}" for n in batch_ids(spark, path) if n <= fold["upto"]]
    gone += [f"{path}/{_FOLDED}/{n}" for n in _names(spark, f"{path}/{_FOLDED}") if n.startswith("rows-") and n != fold["rows"]]
    for folder in gone:
        fs.delete(Path(folder), True)
    for number in _versions(spark, path)[:-1]:
        fs.delete(Path(f"{path}/{_FOLDED}/version-{number}"), False)
    return len(gone)


def drop_before(spark: SparkSession, path: str, column: str, oldest: str) -> int:
    """Retention of a table partitioned by a day column: folders of days before ``oldest`` (ISO date) go as
    a whole, in batches and folds; no row is read or rewritten. The number of folders dropped.

    A folder of a null day stays. A batch all of whose days are gone keeps its (empty) folder until it is swept.
    """
    fs, Path = _files(spark, path)
    dropped, todo = 0, [f"{path}/batch_id={n}" for n in batch_ids(spark, path)]
    fold = folded(spark, path)
    todo += [f"{path}/{_FOLDED}/{fold['rows']}"] if fold else []
    while todo:
        folder = todo.pop()
        for name in _names(spark, folder):
            if name.startswith(f"{column}="):
                day = name.removeprefix(f"{column}=")
                if day != "__HIVE_DEFAULT_PARTITION__" and day < oldest:
                    dropped += bool(fs.delete(Path(f"{folder}/{name}"), True))
            elif "=" in name:
                todo.append(f"{folder}/{name}")
    return dropped


def keep_house(spark: SparkSession, path: str, batch_id: int, every: int, keys: list[str], order: list[str],
               partition_by: list[str] | None = None, day_column: str | None = None, oldest: str | None = None) -> None:
    """What a job does after writing a batch: every ``every`` batches sweep what the fold before replaced,
    drop days that are too old, and fold the batches before this one, which are committed."""
    if batch_id == 0 or batch_id % every:
        return
    sweep(spark, path)
    if day_column and oldest:
        drop_before(spark, path, day_column, oldest)
    if batch_ids(spark, path):
        fold_batches(spark, path, batch_id - 1, keys, order, partition_by)


def read_keyed(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key over everything appended; later batches win at equal order."""
    return tables.latest_per_key(read_table(spark, path), keys, [*order, "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, path: str, new_path: str, keys: list[str], order: list[str]) -> None:
    """Fold all appended batches into a new version of the table (one batch)."""
    append_batch(read_keyed(spark, path, keys, order), new_path, 0)


def write_events(df: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None) -> None:
    """Batch of JSON events (column value, optional key) to a topic or to a folder of JSON lines."""
    if kafka:
        df.write.format("kafka").options(**kafka).save()
    else:
        df.select("value").write.mode("append").text(path)


def export_sample(df: DataFrame, path: str, order: list[str], n: int = 5) -> None:
    """n rows as JSON lines, timestamps in ISO form; ordered first, so reruns agree."""
    df.orderBy(*order).limit(n).write.mode("overwrite").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
