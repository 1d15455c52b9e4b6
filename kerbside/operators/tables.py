"""Keyed tables: newest row, upsert, overlay, dedupe, paging, retention.

Everything keyed is an aggregation with map-side combine (``max_by``) rather than a window over raw
rows, so a key that holds a large share of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.session import cut_lineage

_NAMED_ROWS = 10_000  # rows of a page that are named in a filter


def _winner(df: DataFrame, keys: list[str], order: list[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(*keys)
    best = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` per key; end the order with a tie-break."""
    return _winner(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return _winner(df, keys, order, F.min_by)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins. At equal order an update beats the stored row."""
    both = target.withColumn("_source", F.lit(0)).unionByName(
        updates.select(*target.columns).withColumn("_source", F.lit(1))
    )
    return latest_per_key(both, keys, [*order, "_source"]).drop("_source")


def overlay(recent: DataFrame, stored: DataFrame, key: str | list[str]) -> DataFrame:
    """Recent rows, and the stored rows whose key is not among them; ``_recent`` tells which."""
    fresh = recent.withColumn("_recent", F.lit(1))
    rest = stored.join(recent.select(key), key, "left_anti").withColumn("_recent", F.lit(0))
    return fresh.unionByName(rest.select(*fresh.columns))


def skip_existing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Idempotency: rows whose key has not been written before."""
    return df.join(existing.select(key), key, "left_anti")


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with total_elements and total_pages). Page numbers start at 0."""
    rows = df.orderBy(*order).offset(max(0, page_no) * size).limit(size)
    totals = df.agg(F.count(F.lit(1)).alias("total_elements")).withColumn(
        "total_pages", F.ceil(F.col("total_elements") / F.lit(size)).cast("long")
    )
    return rows, totals


def _ranges(df: DataFrame, name: str, cuts: int) -> list[tuple[Column, int, bool]]:
    """Ranges of a number, date or timestamp column in rising order, nulls first: (rows in it, how many, one value only).

    Percentiles cut the column; every cut is a range of its own, so a frequent value stands alone and
    the ranges between are free of it. The counts are exact.
    """
    stamp = dict(df.dtypes)[name] == "timestamp"
    shares = [i / cuts for i in range(cuts + 1)]
    found = df.agg(F.array_distinct(F.percentile_approx(name, shares)).alias("b"))
    found = found.select(F.transform("b", F.unix_micros) if stamp else F.col("b")).first()[0] or []
    cut = [F.timestamp_micros(F.lit(b)) if stamp else F.lit(b).cast(df.schema[name].dataType) for b in found]
    value = F.col(name)
    parts = [(value.isNull(), True)]
    for i, b in enumerate(cut):
        parts += [((value > cut[i - 1]) & (value < b) if i else value < b, False), (value == b, True)]
    parts.append((value > cut[-1] if cut else value.isNotNull(), False))
    place = F.lit(None).cast("int")
    for i in reversed(range(len(parts))):
        place = F.when(parts[i][0], i).otherwise(place)
    counts = dict(df.groupBy(place.alias("p")).count().collect())  # one row per range
    return [(rows, counts[i], single) for i, (rows, single) in enumerate(parts) if counts.get(i)]


def _reach(df: DataFrame, keys: list[tuple[str, bool]], skip: int, size: int, most: int, cuts: int) -> list[DataFrame]:
    """The rows of ranks ``skip`` to ``skip + size``, as frames whose sort meets at most ``most`` rows each, where keys allow."""
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    name, down = keys[0]
    kind = dict(df.dtypes)[name]
    if not (kind in ("date", "timestamp", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")):
        return [df.orderBy(*order).offset(skip).limit(size)]
    ranges = _ranges(df, name, cuts)
    before, pieces = 0, []
    for rows, n, single in reversed(ranges) if down else ranges:
        first, last = max(skip, before), min(skip + size, before + n)
        if first < last:
            part = df.where(rows)
            rest = keys[1:] if single else keys
            if n > most and rest:
                pieces += _reach(part, rest, first - before, last - first, most, cuts)
            else:
                pieces.append(part.orderBy(*order).offset(first - before).limit(last - first))
        before += n
    return pieces


def deep_page(df: DataFrame, keys: list[tuple[str, bool]], page_no: int, size: int, most: int = 100_000, cuts: int = 32) -> DataFrame:
    """A page far into a table: only the ranges of the order that hold its ranks are read and sorted.

    ``keys``: (column, descending), ending with a unique one; numbers, dates and timestamps are cut
    into counted ranges until at most ``most`` rows are left, a frequent value by the keys after it.
    Other types are sorted within the range reached so far. Nulls come first, descending last.

    The keys alone are written once (checkpoint), and all counting reads that, so whatever makes ``df``
    runs once over all rows and once more for the rows of the page: those are named by the last key,
    which reaches the scan where ``df`` lets a filter on it through.
    """
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    names = list(dict.fromkeys(c for c, _ in keys))
    pieces = _reach(cut_lineage(df.select(*names)), keys, max(0, page_no) * size, size, most, cuts)
    if not pieces:
        return df.limit(0)
    found = pieces[0]
    for piece in pieces[1:]:
        found = found.unionAll(piece)
    found = cut_lineage(found.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")))
    rows, last = df, names[-1]
    if df.schema[last].dataType.typeName() in ("byte", "short", "integer", "long", "string") and size <= _NAMED_ROWS:
        values = {r[0] for r in found.select(last).collect()}
        among = F.col(last).isin(list(values - {None}))
        rows = df.where(among | F.col(last).isNull() if None in values else among)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_page_{c}")) for c in names])
    wanted = found.select(*[F.col(c).alias(f"_page_{c}") for c in names], "_copies")
    rows = rows.join(F.broadcast(wanted) if size <= _NAMED_ROWS else wanted, same)
    copy = F.row_number().over(Window.partitionBy(*names).orderBy(*order))  # of rows with equal keys as many as the page holds
    return rows.withColumn("_copy", copy).where(F.col("_copy") <= F.col("_copies")).select(*df.columns).orderBy(*order)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], last: tuple, size: int) -> DataFrame:
    """The ``size`` rows after the row whose key values are ``last``: no rank is counted, the bound reaches the scan.

    Key columns and values are not null.
    """
    later, equal = F.lit(False), F.lit(True)
    for (c, down), v in zip(keys, last, strict=True):
        bound = F.lit(v).cast(df.schema[c].dataType)
        later = later | (equal & (F.col(c) < bound if down else F.col(c) > bound))
        equal = equal & (F.col(c) == bound)
    c, down = keys[0]
    bound = F.lit(last[0]).cast(df.schema[c].dataType)
    near = F.col(c) <= bound if down else F.col(c) >= bound
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    return df.where(near & later).orderBy(*order).limit(size)


def newest_first(df: DataFrame, ts: str, tiebreak: str, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.col(ts).desc(), F.col(tiebreak))
    return ordered if limit is None else ordered.limit(limit)


def apply_retention(df: DataFrame, ts: str, ttl: str, as_of: Column) -> DataFrame:
    """Rows still alive at ``as_of``; on a table partitioned by time this prunes partitions."""
    return df.where(F.col(ts) > as_of - F.expr(f"INTERVAL {ttl}"))


def owner_rows(df: DataFrame, user: str, owner_columns: list[str], is_admin: bool) -> DataFrame:
    """A user sees the rows they own, an administrator sees all."""
    if is_admin:
        return df
    mine = F.lit(False)
    for c in owner_columns:
        mine = mine | (F.col(c).cast("string") == user)
    return df.where(mine)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null-to-default projection; every default keeps its column's type."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()}
    )


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same on every run: ordered by a hash of the key, then the key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)
