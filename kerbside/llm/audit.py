"""How filters interact: what each removes in every order, from a sparse document-term matrix.

Documents are read in shards. A shard counts the words of its documents into compressed sparse rows
over its own list of words; the lists of all shards meet word by word, where every word gets one
number for the whole table, and the rows' columns are renumbered by it. Row sums and numbers of
nonzeros decide the filters on word counts; the others are flags found in the same pass over the
texts, and the smallest id of equal texts. What remains is one count per combination of flags, from
which every order follows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import SEGMENT_BYTES, _end_of_piece, in_arrow
from kerbside.session import cut_lineage

FILTERS = "ABCDE"
LEAST_WORDS = 200  # A
LEAST_DISTINCT = 50  # B: percent of the words
MOST_CAPITALS = 2  # C: percent of the code points
SHARD_BYTES = 1 << 24  # of text, or one longer text
SHARD_ROWS = 1 << 14
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD = b"#$%&*|"  # D

_PER_DOC = "words long, terms long, capitals long, chars long, odd boolean, print binary"


def word_counts(raw: bytes) -> Counter:
    """How often each word of a text occurs, counted in bounded pieces."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        end = _end_of_piece(raw, at, len(raw), SEGMENT_BYTES)
        counts.update(raw[at:end].split())  # bytes split at ASCII white space
        at = end
    return counts


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: differences, first their lowest bytes, then the next ones."""
    steps = np.diff(numbers.astype(np.int64), prepend=0)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(steps) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _shard_types(kind: str) -> str:
    return (f"shard long, doc_id array<{kind}>, source array<string>, capitals array<long>, chars array<long>, odd array<boolean>, "
            "print array<binary>, sizes binary, pairs long, column binary, count binary, n_words int")


def shards(docs: DataFrame) -> DataFrame:
    """One row per shard: facts of its documents, sparse rows (packed sizes, columns and counts) and
    its words in the order of the columns, joined by spaces."""
    kind = dict(docs.dtypes)["doc_id"]
    types = _shard_types(kind) + ", words string"
    names = [c.split(" ")[0] for c in types.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, id_type = TaskContext.get().partitionId() << 32, 0, None
        numbers, facts, sizes, columns, counts, size = _Numbers(), [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            row = np.repeat(np.arange(len(sizes)), sizes)
            column, count = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (columns, counts))
            order = np.lexsort((column, row))
            lists = [pa.array([list(x)], pa.list_(t)) for x, t in zip(zip(*facts), (
                id_type, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
            return pa.RecordBatch.from_arrays([
                pa.array([base + number], pa.int64()), *lists, pa.array([packed(np.array(sizes))], pa.binary()),
                pa.array([len(column)], pa.int64()), *[pa.array([packed(x[order])], pa.binary()) for x in (column, count)],
                pa.array([len(numbers)], pa.int32()), pa.array([b" ".join(numbers).decode()], pa.string())], names)

        for batch in batches:
            id_type, doc_ids, sources, texts = batch.column(0).type, batch.column(0), batch.column(1), batch.column(2)
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                raw = text.encode()
                found = word_counts(raw)
                facts.append((doc_ids[row].as_py(), sources[row].as_py(), len(raw) - len(raw.translate(None, CAPITALS)), len(text),
                              len(raw.translate(None, ODD)) < len(raw), hashlib.sha256(raw).digest()))
                sizes.append(len(found))
                columns.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
                size += len(raw)
                if size >= SHARD_BYTES or len(facts) >= SHARD_ROWS:
                    yield shard()
                    numbers, facts, sizes, columns, counts, size = _Numbers(), [], [], [], [], 0
                    number += 1
        if facts:
            yield shard()

    return cut_lineage(in_arrow(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), run, types))


def numbered(own: DataFrame, with_words: bool = False) -> DataFrame:
    """Global numbers of the shards' words: (shard, at, term), packed places and numbers of some words,
    and with ``with_words`` also (word, number) of every distinct word.

    A word's rows, one a shard that has it, meet in sorted order; its number is the partition's, upper
    half, and its rank there.
    """
    used = own.where("n_words > 0").select("shard", F.posexplode(F.split("words", " ")).alias("at", "word"))
    used = used.repartition("word").sortWithinPartitions("word")
    names = ["shard", "n", "at", "term", "word", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, last = TaskContext.get().partitionId() << 32, -1, None
        held, size = [], 0

        def by_shard() -> pa.RecordBatch:
            shard, at, term = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((term, shard))
            cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
            groups = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)])]
            return pa.RecordBatch.from_arrays([
                pa.array(shard[order][cut]), pa.array([len(g) for g in groups], pa.int64()),
                pa.array([packed(at[g]) for g in groups], pa.binary()), pa.array([packed(term[g]) for g in groups], pa.binary()),
                pa.nulls(len(groups), pa.string()), pa.nulls(len(groups), pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(2)
            new = np.append(word[0].as_py() != last, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False))
            term = base + number + np.cumsum(new)
            number, last = int(term[-1]) - base, word[-1].as_py()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), term))
            size += batch.num_rows
            if with_words:
                some = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())],
                                                  word.take(pa.array(some)), pa.array(term[some])], names)
            if size >= 1 << 20:
                yield by_shard()
                held, size = [], 0
        if held:
            yield by_shard()

    return cut_lineage(used.select("shard", "at", "word").mapInArrow(
        run, "shard long, n long, at binary, term binary, word string, number long"))


def _with_numbers(own: DataFrame, numbers: DataFrame) -> DataFrame:
    """The shards without their words, and the numbers of those: a shard's own, packed."""
    per_shard = numbers.where("shard is not null").groupBy("shard").agg(
        F.collect_list(F.struct("n", "at", "term")).alias("numbers"))
    return own.drop("words").join(per_shard, "shard", "left")


def _rows_of(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each document's entries start, global number, count) of a shard and its numbers."""
    sizes, pairs, column, count, n_words, numbers = (batch.column(c)[row].as_py() for c in range(7, 13))
    first = np.concatenate(([0], np.cumsum(unpacked(sizes, len(batch.column(1)[row])))))
    term = np.zeros(n_words, np.int64)
    for part in numbers or []:
        term[unpacked(part["at"], part["n"])] = unpacked(part["term"], part["n"])
    return first, term[unpacked(column, pairs)], unpacked(count, pairs)


def term_matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sparse rows in shards, dictionary of word and number).

    Columns of the shards: shard, doc_id (an entry per document) and the little-endian arrays first,
    term and count (64 bits): the words of document i are those from first[i] to first[i + 1].
    """
    own = shards(docs)
    numbers = numbered(own, with_words=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                arrays = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in _rows_of(batch, row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), *arrays],
                                                 ["shard", "doc_id", "first", "term", "count"])

    kind = dict(docs.dtypes)["doc_id"]
    matrix = _with_numbers(own, numbers).mapInArrow(run, f"shard long, doc_id array<{kind}>, first binary, term binary, count binary")
    return matrix, numbers.where("word is not null").select("word", F.col("number").alias("term"))


def document_facts(docs: DataFrame) -> DataFrame:
    """doc_id, source, words, terms, capitals, chars, odd, print of every row, counted on the matrix."""
    own = shards(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, term, count = _rows_of(batch, row)
                upto = np.concatenate(([0], np.cumsum(count)))
                doc_id, source, capitals, chars, odd, prints = (batch.column(c)[row].values for c in range(1, 7))
                yield pa.RecordBatch.from_arrays([
                    doc_id, source, pa.array(upto[first[1:]] - upto[first[:-1]]), pa.array(np.diff(first)), capitals, chars, odd, prints],
                    ["doc_id", "source", "words", "terms", "capitals", "chars", "odd", "print"])

    kind = dict(docs.dtypes)["doc_id"]
    return _with_numbers(own, numbered(own)).mapInArrow(run, f"doc_id {kind}, source string, {_PER_DOC}")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row: bit i of the mask says that the document fails filter i."""
    facts = cut_lineage(document_facts(docs))
    smallest = facts.groupBy("print").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most")
    rows = facts.join(smallest.select("print", "_least"), "print", "left")
    fails = [F.col("words") < LEAST_WORDS, F.col("terms") * 100 < F.col("words") * LEAST_DISTINCT,
             F.col("capitals") * 100 > F.col("chars") * MOST_CAPITALS, F.col("odd"),
             F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.cast("int").alias("mask"))


def _by_mask(counts: Column) -> Column:
    """An array of the counts of every mask from a map of those that occur."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1)),
                       lambda m: F.coalesce(F.try_element_at(counts, m), F.lit(0).cast("long")))


def _sums_without(counts: Column) -> Column:
    """For every set of filters the sum of the counts of masks that share no bit with it."""
    every = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))
    return F.transform(every, lambda s: F.aggregate(
        F.transform(every, lambda m: F.when(m.bitwiseAND(s) == 0, F.get(counts, m)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a + b))


def interactions(failed: DataFrame) -> DataFrame:
    """The audit of rows (part, mask, good, toxic), good and toxic being 0 or 1: see ``audit``."""
    size = 2 ** len(FILTERS)
    counts = failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    per_part = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")])
    per_part = per_part.select("part", *[_by_mask(F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    per_part = per_part.select("part", F.col("n").alias("_n"), *[_sums_without(F.col(c)).alias(f"_{c}_left") for c in ("n", "good", "toxic")])
    # each filter's removals over all orders: a set goes before it in |set|! (others left)! orders
    k = len(FILTERS)
    ways = [1]
    for i in range(1, k + 1):
        ways.append(ways[-1] * i)
    totals = []
    for f in range(k):
        sets = [s for s in range(size) if not s >> f & 1]
        totals.append(sum(((F.get("_n_left", F.lit(s)) - F.get("_n_left", F.lit(s | 1 << f)))
                           * (ways[bin(s).count("1")] * ways[k - 1 - bin(s).count("1")]) for s in sets), F.lit(0).cast("long")))
    per_part = per_part.withColumn("_shapley", F.array(*totals))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = per_part.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    at = F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")
    steps = steps.select("*", before.alias("_before"), at.alias("_filter")).withColumn(
        "_after", F.col("_before").bitwiseOR(F.expr("shiftleft(1, _filter)")))

    def removed(left: str) -> Column:
        return F.get(left, F.col("_before")) - F.get(left, F.col("_after"))

    here = removed("_n_left")
    failing = F.get("_n_left", F.lit(0)) - F.get("_n_left", F.expr("shiftleft(1, _filter)"))
    return steps.select(
        "part", "filter_order", "step", F.get("_n_left", F.col("_after")).alias("kept"), here.alias("removed"),
        (failing - here).alias("redundant"), F.get("_n", F.expr("shiftleft(1, _filter)")).alias("unique_fails"),
        removed("_good_left").alias("good_lost"), removed("_toxic_left").alias("toxic_lost"),
        F.get("_shapley", F.col("_filter")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null is the empty string), order of the five filters and step.

    kept, removed, redundant (failing, but removed earlier), unique_fails (failing this filter only),
    good_lost and toxic_lost (removed here with that label), shapley (removed by this filter over all
    orders). Null text is empty. Rows that repeat count each; a row without id has no smaller id and
    no label, and equal rows of one id aren't copies of each other. An id with several labels counts
    as good, or toxic, if one of them says so. An empty table gives an empty result; without labels
    nothing is lost. Columns other than doc_id, source and text, and doc_id, quality and toxic of
    the labels, are not read.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = failures(docs).join(marks, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return interactions(rows.select("part", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic")))


def oracle() -> str:
    """The audit of the tables documents and labels in SQL."""
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
    return rf"""
with facts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), flags as (
  select doc_id, part,
    case when len(w) < {LEAST_WORDS} then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(body) then 4 else 0 end
    + case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end
    + case when min(doc_id) over (partition by body) < doc_id then 16 else 0 end as mask
  from facts
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id
), rows_ as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from flags left join marks using (doc_id) group by part, mask
), letters(f, bit) as (values {letters}),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31
    and a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
  select filter_order, step, substr(filter_order, step, 1) as f,
    (select sum(bit) from letters l where instr(filter_order, l.f) < step) as before_
  from orders, (values (1), (2), (3), (4), (5)) s(step)
), marked as (
  select filter_order, step, f, bit, coalesce(before_, 0)::bigint as before_ from steps join letters using (f)
), counted as (
  select part, filter_order, step, f,
    sum(case when mask & (before_::bigint | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & before_ = 0 and mask & bit > 0 then n else 0 end) as removed,
    sum(case when mask & before_ > 0 and mask & bit > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before_ = 0 and mask & bit > 0 then good else 0 end) as good_lost,
    sum(case when mask & before_ = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from rows_, marked group by part, filter_order, step, f
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""
