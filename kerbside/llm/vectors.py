"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Unit vectors of cosine c are sqrt(2 - 2c) apart. Each table hashes a vector by the cells that
PROJECTIONS random projections fall into; near vectors share a cell in some table. Vectors that
share a bucket are compared exactly, as matrix blocks of bounded size; a pair counts in the first
table that brings it together, so links are counted without listing pairs, and a block passes on one
count per vector and a spanning forest. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import components, in_arrow, mix64
from kerbside.session import cut_lineage

COSINE = 0.95
TABLES = 48
PROJECTIONS = 16
CELL = 2.0  # of unit vectors: at a cosine of 0.95 a table separates a pair with probability 0.88, all tables with 0.003
BLOCK = 512  # vectors a block compares with another block


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table_keys(x: np.ndarray) -> np.ndarray:
    """Bucket of every unit vector (row) in every table (column)."""
    dim = x.shape[1]
    if dim not in _planes:
        rng = np.random.default_rng([dim, 77])
        _planes[dim] = rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, CELL, TABLES * PROJECTIONS)
    planes, shift = _planes[dim]
    # rounded, so that a vector's cell doesn't depend on the rows beside it
    cells = np.floor(np.round((x @ planes + shift) / CELL, 9)).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(x), TABLES, PROJECTIONS)
    keys = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64) + np.uint64(dim << 20), (len(x), TABLES)).copy()
    for p in range(PROJECTIONS):
        keys = mix64(keys + cells[:, :, p] * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def linked(x: np.ndarray, keys: np.ndarray, table: int, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of unit vectors that are near and share no earlier table; across blocks if two meet."""
    near = np.triu(x @ x.T >= cosine, 1)
    if len(np.unique(own)) > 1:
        near &= own[:, None] != own[None, :]
    i, j = np.nonzero(near)
    fresh = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        fresh[part] = ~(keys[i[part], :table] == keys[j[part], :table]).any(axis=1)
    return i[fresh], j[fresh]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for every vector that pairs connect to a smaller one."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == root).all():
            return [(int(r), v) for v, r in enumerate(root) if r != v]
        root = after


def _links(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(a, b, n): n links counted for a, or an edge a to b where n is null. Reads sorted runs as a stream."""
    def flush(rows: list[tuple], out: list[tuple]) -> None:
        rows.sort(key=lambda r: r[5])
        x, keys = np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
        i, j = linked(x, keys, rows[0][0], np.array([r[4] for r in rows]), cosine)
        many = np.array([r[6] for r in rows])
        counts = np.zeros(len(rows), np.int64)
        np.add.at(counts, i, many[j])
        np.add.at(counts, j, many[i])
        out += [(rows[v][5], None, int(counts[v])) for v in np.flatnonzero(counts)]
        out += [(rows[a][5], rows[b][5], None) for a, b in spanning(len(rows), i, j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, id_type = [], None
        for batch in batches:
            id_type, out = batch.column(5).type, []
            plain = list(zip(*[c.to_pylist() for c in batch.columns[:7]]))
            rows: list = [None] * len(plain)
            for at in _by_length(batch.column(7)):
                x = unit(matrix(batch.column(7).take(pa.array(at))))
                for place, vector, keys in zip(at, x, table_keys(x)):
                    rows[place] = (*plain[place], vector, keys)
            for row in rows:
                if held and held[-1][:4] != row[:4]:
                    if len(held) > 1:
                        flush(held, out)
                    held = []
                held.append(row)
            yield as_batch(out, id_type)
        if len(held) > 1:
            out = []
            flush(held, out)
            yield as_batch(out, id_type)

    def as_batch(out, id_type):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], id_type),
                                           pa.array([r[2] for r in out], pa.int64())], ["a", "b", "n"])

    group = ["table", "key", "low", "high"]
    rows = members.select(*group, "own", "rep", "copies", "vector")
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, f"a {kind}, b {kind}, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Null or zero vectors, vectors with null or non-finite components and rows without id link with
    nothing; vectors of different lengths don't link. Equal vectors link with each other. Rows that
    repeat an id count as vectors of their own. An empty table gives an empty result. Other columns
    are not read. A bucket of m vectors costs m * m / BLOCK rows, each pair of it being compared.
    """
    kind = dict(vectors.dtypes)[id_col]
    good = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    base = vectors.select(F.col(id_col).alias("vec_id"), good.alias("_good"), F.col(vector_col).alias("vector"))
    prints = [F.xxhash64("vector").alias("_p"), F.xxhash64(F.lit(1), "vector").alias("_q")]
    classes = base.where("_good").select("vec_id", "vector", *prints).groupBy("_p", "_q").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = cut_lineage(classes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _by_length(batch.column(2)):
                some = batch.take(pa.array(at))
                keys = table_keys(unit(matrix(some.column(2))))
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(list(keys), pa.list_(pa.int64()))],
                                                 ["rep", "copies", "keys"])

    keyed = in_arrow(classes.select("rep", "copies", "vector"), hashed, f"rep {kind}, copies long, keys array<long>")
    keyed = cut_lineage(keyed).select("rep", F.posexplode("keys").alias("table", "key"))
    buckets = keyed.groupBy("table", "key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.min("rep").alias("_low")).where("size > 1")
    # buckets of equal vectors bring nothing new after the first table that has them
    buckets = buckets.groupBy("size", "_x", "_low").agg(F.min(F.struct("table", "key")).alias("_first")).select(
        "size", "_first.table", "_first.key")
    members = keyed.join(buckets, ["table", "key"]).join(classes.select("rep", "copies", "vector"), "rep")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns(
        {"low": F.least("own", "_other"), "high": F.greatest("own", "_other")})
    found = cut_lineage(_links(members, kind, cosine))
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    reach = components(found.where("n is null").select("a", "b"), "a", "b").withColumnRenamed("id", "rep")
    facts = classes.select("_p", "_q", "rep", "copies").join(counts, "rep", "left").join(reach, "rep", "left").select(
        "_p", "_q", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("_n"),
        F.coalesce("component", "rep").alias("_c"))
    rows = base.select("vec_id", "_good", *prints).join(facts, ["_p", "_q"], "left")
    component = F.when(F.col("_good"), F.col("_c")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", F.when(F.col("_good"), F.col("_n")).otherwise(0).cast("long").alias("n_links"),
                       component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
