"""Hashed features of whole texts, and the bounded samples that classifiers learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import IS_SPACE, LOWER, segments, spans_hash, words

BITS = 15
BUCKETS = 1 << BITS
REPEAT = 0  # bucket of a word that equals the one before it
SAMPLE_PER_CLASS = 1500

#: One array of features for a segment: (bucket of every place, whether the place has a feature).
Feature = tuple[np.ndarray, np.ndarray]


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def _byte_grams(data: np.ndarray, starts: np.ndarray, n: int) -> Feature:
    """n bytes from every place, white space only at their ends and none from the next piece."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(len(data), np.int32), np.zeros(len(data), bool)
    space = IS_SPACE[data]
    flat = np.where(space, 32, data).astype(np.uint64)
    code = np.full(size, n, np.uint64)
    whole = np.ones(size, bool)
    for i in range(n):
        code = (code << np.uint64(8)) | flat[i:i + size]
        if 0 < i < n - 1:
            whole &= ~space[i:i + size]
    if n <= 2:
        whole &= ~space[:size]
    last = np.append(starts[1:], len(data)) - 1
    whole[last[last < size]] = False
    pad = n - 1
    return np.concatenate((_bucket(code), np.zeros(pad, np.int32))), np.concatenate((whole, np.zeros(pad, bool)))


def subword_features(data: np.ndarray, starts: np.ndarray) -> Iterator[Feature]:
    """Words, pairs of neighbouring words, and character runs of 3 and 4 bytes, as they are written."""
    a, b = words(data)
    code = spans_hash(data, a, b)
    at = np.zeros(len(data), np.int32)
    has = np.zeros(len(data), bool)
    at[a], has[a] = _bucket(code), True
    yield at, has
    if len(a) > 1:
        at, has = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        piece = np.searchsorted(starts, a, "right")
        same = piece[1:] == piece[:-1]
        pair = np.where(code[1:] == code[:-1], REPEAT, _bucket(code[1:] * np.uint64(3) + code[:-1]))
        at[a[1:]], has[a[1:]] = pair, same
        yield at, has
    for n in (3, 4):
        yield _byte_grams(data, starts, n)


_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def letter_features(data: np.ndarray, starts: np.ndarray) -> Iterator[Feature]:
    """Runs of 2 to 4 bytes of letters in lower case, digits and punctuation taken for spaces."""
    low = _LETTERS[data]
    after = np.concatenate(([0], data[:-1]))
    upper = (after == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)  # Latin capitals of two bytes
    low = low + np.where(upper, 32, 0).astype(np.uint8)
    for n in (2, 3, 4):
        yield _byte_grams(low, starts, n)


def counts_of(texts: pa.Array, features: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every text the buckets it has and how often; one dense row of counts at a time in memory."""
    totals: dict[int, np.ndarray] = {}
    for data, starts, rows in segments(texts, 1 << 18):
        ends = np.append(starts[1:], len(data))
        found = list(features(data, starts))
        for piece, row in enumerate(rows.tolist()):
            got = totals.setdefault(row, np.zeros(BUCKETS, np.int64))
            part = slice(starts[piece], ends[piece])
            for at, has in found:
                got += np.bincount(at[part][has[part]], minlength=BUCKETS)
        for row in [r for r in totals if r < rows[-1]]:
            yield row, totals.pop(row)
    yield from totals.items()


def sums_of(texts: pa.Array, features: Callable, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text and column of ``weights`` (bucket, column) the mean weight of its features; feature counts."""
    n = len(texts)
    total, count = np.zeros((n, weights.shape[1])), np.zeros(n)
    for data, starts, rows in segments(texts, 1 << 18):
        for at, has in features(data, starts):
            np.add.at(count, rows, np.add.reduceat(has.astype(np.int64), starts))
            for c in range(weights.shape[1]):
                value = weights[:, c][at]
                value[~has] = 0
                np.add.at(total[:, c], rows, np.add.reduceat(value, starts, dtype=np.float64))
    return total / np.maximum(count, 1)[:, None], count


def smallest_hashes(labelled: DataFrame, per_class: int) -> DataFrame:
    """The ``per_class`` rows of each label whose ids hash lowest, of unique (doc_id, label).

    The ids of a label are counted by the first 12 bits of their hash, and only those up to the range
    that holds the last wanted one are ranked: about ``per_class`` rows a label, however many it has.
    """
    coded = labelled.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("_b", F.shiftright("_h", 52))
    counts = coded.groupBy("label", "_b").count()
    upto = F.sum("count").over(Window.partitionBy("label").orderBy("_b")) - F.col("count")
    last = counts.withColumn("_before", upto).where(F.col("_before") < per_class).groupBy("label").agg(F.max("_b").alias("_last"))
    low = coded.join(F.broadcast(last), "label").where(F.col("_b") <= F.col("_last"))  # one row per label
    order = Window.partitionBy("label").orderBy("_h", "doc_id")
    return low.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_class).select("doc_id", "label")


def sample(docs: DataFrame, labelled: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Texts of at most ``per_class`` rows of ``labelled`` (doc_id, label) per label, picked by hash of the id.

    Only ids and labels are ranked; the bounded choice is broadcast to the texts.
    """
    labelled = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = smallest_hashes(labelled, per_class)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by per_class


def sample_counts(sampled: DataFrame, features: Callable) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of each sampled text, in the order of ids."""
    def run(batches):
        for batch in batches:
            rows = dict(counts_of(batch.column(1), features))
            rows = [rows.get(i, np.zeros(BUCKETS, np.int64)) for i in range(batch.num_rows)]
            at = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([a.tobytes() for a in at], pa.binary()),
                pa.array([r[a].astype(np.int32).tobytes() for r, a in zip(rows, at)], pa.binary())],
                ["doc_id", "label", "at", "n"])

    types = dict(sampled.dtypes)
    got = sampled.mapInArrow(run, f"doc_id {types['doc_id']}, label {types['label']}, at binary, n binary").toArrow()
    order = np.argsort(np.array([str(x) for x in got["doc_id"].to_pylist()]), kind="stable")
    label, at, n = (got[c].to_pylist() for c in ("label", "at", "n"))
    return [(label[i], np.frombuffer(at[i], np.int32), np.frombuffer(n[i], np.int32)) for i in order]


def labelled_ids(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, label) of the rows whose labels may be learned."""
    return labels.where(learn & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
