"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming search.

A document's set of word shingles gives a signature of POSITIONS codes of 16 bits; two sets of
Jaccard similarity s differ in about (1 - s) * POSITIONS codes. The signature is split into chunks.
By the pigeonhole principle two signatures within MAX_DISTANCE codes have a chunk with at most
CHUNK_ERRORS differing codes, so every chunk is indexed once per set of codes left out, and all pairs
under the threshold meet in a bucket. Links are confirmed on full shingle sets.

Documents of equal sets are one class, represented by the smallest id. Buckets hold classes and give
only what connects them: first a spanning forest of the pairs that look nearest, then, where
confirmation left a bucket in several components, all pairs between components. Pairs inside a
component decide nothing. A pair is given by the first bucket that holds it, and before its full
sets are fetched a longer sketch must allow it: the share of SKETCH hash ranges with equal minima
has a standard deviation of 0.018 at most, and may fall short of the similarity by SKETCH_MARGIN.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import LOWER, components, in_arrow, mix64, segments, spans_hash, words
from kerbside.session import broadcast_if_small, cut_lineage

SHINGLE = 5  # words
PERCENT = 80  # least similarity of a link
POSITIONS = 48
MAX_DISTANCE = 19  # 3.4 standard deviations above the mean of 9.6 at a similarity of 0.8
CHUNKS = 10
SKETCH = 512  # hash ranges, a power of two
SKETCH_MARGIN = 0.06
BLOCK = 2048  # classes compared at once
STRIP = 1 << 16  # pairs of a block held at once

_rng = np.random.default_rng(20240917)
_ODD = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunk_variants(positions: int = POSITIONS, limit: int = MAX_DISTANCE, chunks: int = CHUNKS) -> list[np.ndarray]:
    """The positions of every index key: each chunk without each choice of limit // chunks positions."""
    errors = limit // chunks
    out = []
    for chunk in np.array_split(np.arange(positions), chunks):
        for left_out in combinations(chunk, errors):
            out.append(np.setdiff1d(chunk, left_out))
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII letters in lower case.

    With fewer than k words the whole sequence is the one shingle; without words the set is empty.
    """
    rows, hashes = [], []
    for data, starts, piece_rows in segments(texts):
        low = LOWER[data]
        a, b = words(low)
        hashes.append(spans_hash(low, a, b))
        rows.append(piece_rows[np.searchsorted(starts, a, "right") - 1])
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        w = word[a:b]
        if not len(w):
            out.append(w)
            continue
        width = min(k, len(w))
        sums = np.full(len(w) - width + 1, width, np.uint64)
        for i in range(width):
            sums += w[i:len(w) - width + 1 + i] * _ORDER[i]
        out.append(np.unique(mix64(sums)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit codes of the minima of POSITIONS hash orders."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at:at + 2048, None]
        low = np.minimum(low, ((part ^ _XOR) * _ODD).min(axis=0))
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """An 8-bit code of the smallest shingle in each of SKETCH equal hash ranges; 0 where there is none."""
    out = np.zeros(SKETCH, np.uint8)
    part = (shingles >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    out[part[first]] = 1 + mix64(shingles[first]) % np.uint64(255)
    return out


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    return (int(np.bitwise_xor.reduce(mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))).astype(np.int64)) if len(shingles) else 0,
            int(np.add.reduce(mix64(shingles * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)) if len(shingles) else 0)


def row_key() -> Column:
    """What a row is told apart by: its id and its text."""
    return F.xxhash64("doc_id", "text", F.md5(F.col("text").cast("binary")))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row_key, n, fp1, fp2, sig, sketch, keys) per row; documents without shingles have no signature."""
    variants = chunk_variants()
    salts = _rng_salts(len(variants))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            sigs = [signature(s) if len(s) else None for s in sets]
            some = np.array([s for s in sigs if s is not None], np.uint16).reshape(-1, POSITIONS)
            keys = np.empty((len(some), len(variants)), np.uint64)
            for v, at in enumerate(variants):
                sums = np.full(len(some), salts[v], np.uint64)
                for j, p in enumerate(at):
                    sums += (some[:, p].astype(np.uint64) + np.uint64(1)) * _ORDER[j]
                keys[:, v] = mix64(sums)
            keys = iter(keys.view(np.int64))
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
                pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.array([None if s is None else next(keys) for s in sigs], pa.list_(pa.int64())),
            ], ["doc_id", "row_key", "n", "fp1", "fp2", "sig", "sketch", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return in_arrow(docs.select("doc_id", "text", row_key().alias("row_key")), run,
                    f"doc_id {kind}, row_key long, n long, fp1 long, fp2 long, sig binary, sketch binary, keys array<long>")


def _rng_salts(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64))


class Block:
    """Classes that share an index key: which of their pairs are candidates."""

    def __init__(self, variant: int, sig: np.ndarray):
        self.variant, self.sig = variant, sig
        earlier = chunk_variants()[:variant]
        self.earlier = np.zeros((POSITIONS, variant), np.float32)
        for v, at in enumerate(earlier):
            self.earlier[at, v] = 1
        self.sizes = self.earlier.sum(axis=0)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others within the distance that no earlier key brings together with i."""
        same = self.sig[others] == self.sig[i]
        hit = np.count_nonzero(same, axis=1) >= POSITIONS - MAX_DISTANCE
        others, same = others[hit], same[hit]
        if self.variant and len(others):
            others = others[~(same.astype(np.float32) @ self.earlier == self.sizes).any(axis=1)]
        return others

    def strips(self, sketches: np.ndarray, share: float, others) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, share of equal sketch codes) of the candidate pairs whose share is large enough, some
        rows of the block at a time; ``others`` gives the partners to look at for each i."""
        full, out, size = sketches > 0, [], 0
        for i in range(len(self.sig)):
            hit = self.near(i, others(i))
            if len(hit):
                equal = ((sketches[hit] == sketches[i]) & full[i]).sum(axis=1) / (full[hit] | full[i]).sum(axis=1)
                hit, equal = hit[equal >= share], equal[equal >= share]
                out.append((np.full(len(hit), i), hit, equal))
                size += len(hit)
            if out and (size >= STRIP or i + 1 == len(self.sig)):
                yield tuple(np.concatenate(c) for c in zip(*out))
                out, size = [], 0
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out))

    def forest(self, sketches: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the pairs that look similar enough, likeliest pairs first.

        The forest of the strips so far and the next strip's pairs give the next forest, so that no
        more than a strip of pairs is held."""
        n = len(self.sig)
        number = np.arange(n)
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
        for strip in self.strips(sketches, share, lambda i: number[i + 1:]):
            i, j, likely = (np.concatenate(c) for c in zip(held, strip))
            root, kept = list(range(n)), []
            for p in np.argsort(-likely, kind="stable").tolist():
                a, b = int(i[p]), int(j[p])
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    kept.append(p)
                    if len(kept) + 1 == n:
                        break
            held = i[kept], j[kept], likely[kept]
        return held[:2]

    def crossing(self, sketches: np.ndarray, share: float, comp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All candidate pairs whose components differ, across the two parts if two meet in this block."""
        one = len(np.unique(own)) == 1
        for i, j, _ in self.strips(sketches, share, lambda i: i + 1 + np.flatnonzero(
                (comp[i + 1:] != comp[i]) & (one | (own[i + 1:] != own[i])))):
            yield i, j


def bucket_pairs(members: DataFrame, kind: str, share: float, between: bool) -> DataFrame:
    """Distinct candidate pairs (a < b) of (variant, key, low, high, own, rep, comp, sig, sketch) with the
    least ``share`` of the sketch: forests, or all pairs between components. A block is what shares
    variant, key, low and high: a bounded run of the sorted rows, read as a stream."""
    def pairs_of(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[5])
        block = Block(rows[0][0], np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(-1, POSITIONS))
        sketches = np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(-1, SKETCH)
        if between:
            numbers = {c: i for i, c in enumerate({r[6] for r in rows})}
            found = block.crossing(sketches, share, np.array([numbers[r[6]] for r in rows]), np.array([r[4] for r in rows]))
        else:
            found = iter([block.forest(sketches, share)])
        ids = pa.array([r[5] for r in rows], id_type)
        same = np.cumsum([0, *(x[5] != y[5] for x, y in zip(rows[1:], rows))])  # a row may be here twice
        for i, j in found:
            other = same[i] != same[j]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[other])), ids.take(pa.array(j[other]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, id_type = [], None
        for batch in batches:
            id_type = batch.column(5).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][:4] != row[:4]:
                    if len(held) > 1:
                        yield from pairs_of(held, id_type)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield from pairs_of(held, id_type)

    group = ["variant", "key", "low", "high"]
    rows = members.select(*group, "own", "rep", "comp", "sig", "sketch")
    rows = rows.repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def between_components(members: DataFrame) -> DataFrame:
    """(variant, key, low, high, own, rep, comp) of the buckets of (variant, key, rep, comp) that hold
    several components, dealt so that pairs between components meet in blocks of about BLOCK rows.

    A bucket's largest component and its other members, the guests, are cut into parts of half a
    block. Every two guest parts meet, and every guest part and part of the component.
    """
    shares = members.groupBy("variant", "key", "comp").agg(F.count(F.lit(1)).alias("_n"))
    mixed = shares.groupBy("variant", "key").agg(
        F.count(F.lit(1)).alias("_comps"), F.max(F.struct("_n", "comp")).alias("_most"), F.sum("_n").alias("_size")).where("_comps > 1")
    half = max(BLOCK // 2, 1)
    crowded = F.col("_size") > BLOCK
    mixed = mixed.select(
        "variant", "key", F.col("_most.comp").alias("_main"),
        F.when(crowded, F.ceil((F.col("_size") - F.col("_most._n")) / half)).otherwise(1).cast("int").alias("_guests"),
        F.when(crowded, F.ceil(F.col("_most._n") / half)).otherwise(0).cast("int").alias("_mains"))
    guest = (F.col("comp") != F.col("_main")) | (F.col("_mains") == 0)
    number = F.xxhash64("rep")
    own = F.when(guest, F.pmod(number, F.col("_guests"))).otherwise(F.col("_guests") + F.pmod(number, F.col("_mains"))).cast("int")
    last = F.when(guest, F.col("_guests") + F.col("_mains") - 1).otherwise(F.col("_guests") - 1)
    return members.join(mixed, ["variant", "key"]).withColumn("own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), last))).select(
        "variant", "key", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "rep", "comp")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Only texts in a pair are read again."""
    kind = dict(docs.dtypes)["doc_id"]
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], ["rep", "fp1", "fp2", "shingles"])

    sets = texts.mapInArrow(run, f"rep {kind}, fp1 long, fp2 long, shingles array<long>")
    sets = cut_lineage(sets.join(classes.select("rep", "fp1", "fp2"), ["rep", "fp1", "fp2"], "left_semi")
                       .dropDuplicates(["rep", "fp1", "fp2"]).select("rep", "shingles"))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_a")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_b")), "b")
    same = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - same
    return both.where(same * 100 >= union * percent).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents of at least ``percent`` similarity are linked; component_id is the smallest id reached
    over links. Null or empty text has no shingles and is linked with nothing, and so is a row
    without id, whose component_id is null; both are kept. Rows that repeat an id are judged each by
    their own text. An empty table gives an empty result. Columns other than doc_id and text are
    not read.
    """
    return judged(docs, k, percent).drop("row_key")


def judged(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """As ``near_duplicates``, with the row_key that tells rows of one id apart."""
    kind = dict(docs.dtypes)["doc_id"]
    base = cut_lineage(signatures(docs, k))
    named = base.where("n > 0 and doc_id is not null")
    classes = cut_lineage(named.groupBy("fp1", "fp2", "n").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"),
        F.first("keys").alias("keys")))
    keyed = classes.select("rep", F.posexplode("keys").alias("variant", "key"))
    buckets = keyed.groupBy("variant", "key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.min("rep").alias("low")).where("size > 1")
    # buckets of equal members bring nothing new after the first of them
    buckets = buckets.groupBy("size", "_x", "low").agg(F.min(F.struct("variant", "key")).alias("_first")).select(
        "size", F.col("low").alias("lowest"), "_first.variant", "_first.key")
    members = keyed.join(buckets, ["variant", "key"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = cut_lineage(members.withColumns({"low": F.pmod(F.xxhash64("rep"), blocks).cast("int"), "blocks": blocks}))
    first = members.withColumn("comp", F.col("rep"))
    lowest = first.where("rep = lowest and blocks > 1").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ties = first.where("rep <> lowest or blocks = 1").unionByName(lowest).withColumns({"high": F.col("low"), "own": F.col("low")})
    codes = classes.select("rep", "sig", "sketch")
    likely = cut_lineage(bucket_pairs(ties.join(codes, "rep"), kind, percent / 100, between=False))
    links = confirmed(docs, classes, likely, k, percent)
    found = cut_lineage(components(links, "a", "b"))
    now = members.select("variant", "key", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "comp", F.coalesce("component", "rep")).drop("component")
    rest = between_components(now).join(codes, "rep")
    more = cut_lineage(bucket_pairs(rest, kind, percent / 100 - SKETCH_MARGIN, between=True))
    more = confirmed(docs, classes, more, k, percent)

    stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(stars.unionByName(more), "a", "b").withColumnRenamed("id", "rep")
    named_as = classes.select("fp1", "fp2", "n", "rep").join(found, "rep", "left").select(
        "fp1", "fp2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("doc_id", "row_key", "n", "fp1", "fp2").join(named_as, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, whose row is kept; of rows that repeat an id and its text, one.

    Rows are told apart by id and text: of an id with two texts, one may go as a copy of an earlier
    document while the other stays. Rows without id all stay.
    """
    found = cut_lineage(judged(docs, k, percent).select("doc_id", "row_key", "kept"))
    gone = found.where("not kept").select("row_key").distinct()
    out = docs.withColumn("_row_key", row_key())
    out = out.join(gone.withColumnRenamed("row_key", "_row_key"), "_row_key", "left_anti")
    again = cut_lineage(found.where("kept and doc_id is not null").groupBy("row_key").count().where("count > 1")
                        .select(F.col("row_key").alias("_row_key")))
    if not again.isEmpty():
        once = out.join(again, "_row_key", "left_semi").dropDuplicates(["_row_key"])
        out = out.join(again, "_row_key", "left_anti").unionByName(once)
    return out.select(*docs.columns)
