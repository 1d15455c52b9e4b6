"""Ordered lookups along time: previous row per key, and last known row as of a moment.

A plain window per key sorts all rows of a key in one task. Here a key's time line is cut into pieces
and rows are windowed per (key, piece); what a piece needs from the past is one row, taken from a
summary with one row per (key, piece). A piece is a time bucket; a bucket with more than
``PIECE_ROWS`` rows of one key is cut at counted ranks, so that a key with all rows in one hour is
several tasks, too. Only rows of one key and one microsecond can't be parted. Null keys count as one
key. Each input is read once by the plan: summary and window share one shuffle. The counts before it
read keys and times only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.session import broadcast_if_small, cut_lineage

_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
PIECE_ROWS = 2_000_000
_FINER = (1_000_000, 1)  # crowded buckets are counted by seconds, crowded seconds by microseconds


def _width(bucket: str) -> int:
    count, unit = bucket.split()
    return int(count) * _MICROS[unit.rstrip("s")]


def _cell(at: str, width: int) -> Column:
    """Start of the cell of this width, in microseconds."""
    return F.floor(F.unix_micros(F.col(at)) / F.lit(width)) * F.lit(width)


def _starts(crowded: DataFrame, finer: tuple[int, ...], times: DataFrame) -> list[DataFrame]:
    """(_key, _piece, _start): where crowded cells are cut, from prefix counts over finer cells.

    A cell's finer cells fit a task: the seconds of a bucket, the microseconds of a second. Finer
    cells that are crowded themselves are cut in turn.
    """
    inside = times.join(broadcast_if_small(crowded), ["_key", "_cell"])
    counts = cut_lineage(inside.groupBy("_key", "_piece", "_cell", _cell("_at", finer[0]).alias("_fine")).agg(
        F.count(F.lit(1)).alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("_key", "_cell").orderBy("_fine")) - F.col("_n")
    runs = counts.withColumn("_run", F.floor(before / F.lit(PIECE_ROWS)))
    found = [runs.groupBy("_key", "_piece", "_cell", "_run").agg(F.min("_fine").alias("_start"))
             .select("_key", "_piece", "_start")]
    still = counts.where(F.col("_n") > PIECE_ROWS).select("_key", "_piece", F.col("_fine").alias("_cell"))
    if len(finer) > 1 and not still.isEmpty():
        found += _starts(still, finer[1:], times.withColumn("_cell", _cell("_at", finer[0])))
    return found


@dataclass(frozen=True)
class Cuts:
    """Where crowded (key, bucket) cells are cut: (_key, _piece, _starts), or None if none is crowded."""

    bucket: str
    starts: DataFrame | None = None


def count_cuts(rows: DataFrame, keys: list[str], ts: str, bucket: str = "1 hour") -> Cuts:
    """Count rows per (key, bucket) and cut the crowded ones. One result serves all subsets of the rows."""
    return _count(rows.select(F.struct(*keys).alias("_key"), F.col(ts).alias("_at")), bucket)


def _count(rows: DataFrame, bucket: str) -> Cuts:
    times = rows.select("_key", "_at", _cell("_at", _width(bucket)).alias("_cell"))
    crowded = times.groupBy("_key", "_cell").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > PIECE_ROWS).select("_key", "_cell", F.col("_cell").alias("_piece"))
    if crowded.isEmpty():
        return Cuts(bucket)
    starts = reduce(DataFrame.unionByName, _starts(cut_lineage(crowded), _FINER, times))
    return Cuts(bucket, cut_lineage(starts.groupBy("_key", "_piece").agg(F.collect_set("_start").alias("_starts"))))


def _deal(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """Rows with _key and _at get their ``_piece`` (its first microsecond) and are shuffled by (key, piece)."""
    rows = rows.withColumn("_piece", _cell("_at", _width(cuts.bucket)))
    if cuts.starts is not None:
        starts = broadcast_if_small(cuts.starts, weight=F.size("_starts"))
        mine = F.array_max(F.filter("_starts", lambda s: s <= F.unix_micros("_at")))
        rows = rows.join(starts, ["_key", "_piece"], "left").withColumn(
            "_piece", F.coalesce(mine, "_piece")).drop("_starts")
    return rows.repartition("_key", "_piece")


def _carried(summary: DataFrame) -> DataFrame:
    """For every (key, piece): ``_last`` of the nearest earlier piece that has one."""
    earlier = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("_last", ignorenulls=True).over(earlier)
    return summary.withColumn("_carry", carry).where(
        F.col("_carry").isNotNull() & F.col("_wanted")).select("_key", "_piece", "_carry")


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                 bucket: str = "1 hour", prefix: str = "prev_", cuts: Cuts | None = None) -> DataFrame:
    """Add ``prev_*``: the given columns of the row just before, per key.

    ``order`` starts with the timestamp and ends with a tie-break; rows without a time come first.
    ``cuts`` are counted unless given.
    """
    rows = df.select(F.struct(*keys).alias("_key"), F.col(order[0]).alias("_at"), F.struct(*df.columns).alias("_row"))
    rows = _deal(rows, cuts or _count(rows, bucket))
    by = [F.col("_row")[c] for c in order]
    # keeps whole rows, so that summary and window read the same shuffle
    summary = rows.groupBy("_key", "_piece").agg(
        F.max_by("_row", F.struct(*by)).alias("_last"), F.lit(True).alias("_wanted"))
    w = Window.partitionBy("_key", "_piece").orderBy(*by)
    seen = rows.withColumn("_prev", F.lag(F.struct(*[F.col("_row")[c].alias(c) for c in columns])).over(w))
    carried = _carried(summary).select("_key", "_piece", F.struct(
        *[F.col("_carry")[c].alias(c) for c in columns]).alias("_carry"))
    out = seen.join(carried, ["_key", "_piece"], "left")
    prev = F.coalesce("_prev", "_carry")
    return out.select(
        *[F.col("_row")[c].alias(c) for c in df.columns],
        *[prev[c].alias(f"{prefix}{c}") for c in columns],
    )


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
               columns: list[str], right_order: list[str] | None = None,
               left_order: list[str] | None = None, bucket: str = "1 hour",
               max_age: str | None = None, strict: bool = False, prefix: str = "asof_",
               cuts: Cuts | None = None) -> DataFrame:
    """Every left row with the last right row of its key at or before its time.

    Left rows without one keep nulls. ``right_order`` breaks ties between right rows of equal time.
    With ``left_order`` too, (time, order) is compared as a whole, e.g. a sequence number both sides
    share. ``strict`` wants the right row before the left one; ``max_age`` drops older matches.
    ``cuts`` are counted unless given.
    """
    ties = right_order or []
    value = F.struct(F.col(right_ts).alias("_ts"), *[F.col(c) for c in columns])
    before, after = (2, 1) if strict else (1, 2)  # sort position of right and left at equal time
    r = right.select(
        F.struct(*keys).alias("_key"), F.col(right_ts).alias("_at"), F.lit(before).alias("_kind"),
        F.struct(*ties, F.lit(0).alias("_z")).alias("_tie"), value.alias("_val"),
    )
    left_type = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType
    tie_type = r.schema["_tie"].dataType
    val_type = r.schema["_val"].dataType
    own_tie = F.struct(*left_order, F.lit(0).alias("_z")) if left_order else F.lit(None)
    lo = left.select(
        F.struct(*keys).alias("_key"), F.col(left_ts).alias("_at"), F.lit(after).alias("_kind"),
        own_tie.cast(tie_type).alias("_tie"), F.lit(None).cast(val_type).alias("_val"),
        F.struct(*left.columns).alias("_row"),
    )
    both = lo.unionByName(r.withColumn("_row", F.lit(None).cast(left_type)))
    both = _deal(both, cuts or _count(both, bucket))
    # asks for left rows, so that summary and window read the same shuffle
    summary = both.groupBy("_key", "_piece").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.struct("_at", "_tie"))).alias("_last"),
        F.max(F.col("_row").isNotNull()).alias("_wanted"),
    )
    sort = ["_at", "_tie", "_kind"] if left_order else ["_at", "_kind", "_tie"]
    w = Window.partitionBy("_key", "_piece").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_val", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    found = found.join(_carried(summary), ["_key", "_piece"], "left").withColumn("_hit", F.coalesce("_own", "_carry"))
    hit = F.col("_hit")
    if max_age:
        hit = F.when(F.col("_at") - F.expr(f"INTERVAL {max_age}") < F.col("_hit._ts"), hit)
    return found.withColumn("_hit", hit).select(
        *[F.col("_row")[c].alias(c) for c in left.columns],
        F.col("_hit._ts").alias(f"{prefix}{right_ts}"),
        *[F.col("_hit")[c].alias(f"{prefix}{c}") for c in columns],
    )
