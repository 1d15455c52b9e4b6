"""Helpers of the training-data operators: Arrow texts as byte arrays, word hashes, graph components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import cut_lineage, prepare, spread

WORD = r"[^\x20\x09-\x0D]+"
SEGMENT_BYTES = 1 << 20

#: The ASCII white space that separates words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by a modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def settings(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: texts go to Python in batches of bounded size."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow on a scan that uses all cores."""
    return spread(df).mapInArrow(run, schema)


def _end_of_piece(view: bytes, start: int, end: int, limit: int) -> int:
    """Where a piece of about limit bytes ends: at white space, so that no word is cut."""
    if end - start <= limit:
        return end
    near = view[start:start + limit]
    cut = max(near.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    if cut > 0:
        return start + cut
    at = start + limit
    while at < end:  # a word longer than the limit stays whole
        window = view[at:at + limit]
        found = [p for p in (window.find(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
        if found:
            return min(end, at + min(found))
        at += limit
    return end


def segments(texts: pa.Array, limit: int = SEGMENT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """UTF-8 texts in bounded segments: (bytes, start of each piece, row of each piece).

    Pieces end with a line feed. Short texts share a segment; a long one is cut at white space into
    pieces of the same row, in order. Null is empty. Every row occurs at least once.
    """
    col = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    raw = memoryview(raw) if raw is not None else memoryview(b"")
    pieces, rows, size = [], [], 0
    for row in range(len(col)):
        start, end = int(offsets[row]), int(offsets[row + 1])
        text = bytes(raw[start:end])
        at = 0
        while True:
            stop = _end_of_piece(text, at, len(text), limit)
            pieces.append(text[at:stop] if at or stop < len(text) else text)
            rows.append(row)
            size += stop - at + 1
            at = stop
            if size >= limit:
                yield _joined(pieces, rows)
                pieces, rows, size = [], [], 0
            if at >= len(text):
                break
    if rows:
        yield _joined(pieces, rows)


def _joined(pieces: list[bytes], rows: list[int]):
    data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
    return data, np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array(rows, np.int64)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """First n powers of the base (or of its inverse) modulo 2 ** 64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SEGMENT_BYTES * 2), base, np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64),
                           np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), dtype=np.uint64)))
    value = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    return mix64(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no white space."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


EDGES_A_TASK = 200_000  # of a round of components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable over the edges, for every id that has one.

    Alternating large and small stars: each round is two map-side combined minima and two joins,
    with a checkpoint after it. A component never meets in one task beyond ``EDGES_A_TASK`` edges;
    crowded centres are joins that adaptive execution splits. As many partitions are used as the
    counted edges need, so the rounds of a small graph don't shuffle. Ends when a round changes
    nothing.
    """
    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def dealt(e, n):
        return e.coalesce(max(1, -(-n // EDGES_A_TASK)))

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    before = state(e)
    while before[0]:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = dealt(e, before[0]).select(F.explode(ways).alias("_way")).select("_way.u", "_way.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(dealt(moved.unionByName(low.select("u", F.col("m").alias("v"))), before[0]).distinct())
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
