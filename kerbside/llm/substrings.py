"""Substring deduplication over sliding spans of sentences.

A text is a row of sentences; they end with a line, with a full stop, question or exclamation mark,
and, so that passages set into other sentences align, after words picked by their hash. Every run of
at least SPAN consecutive sentences and SPAN_WORDS words is hashed; equal runs meet in one
aggregation over all documents. The first occurrence stays, sentences covered by any other go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import LOWER, in_arrow, mix64, segments, spans_hash, words
from kerbside.session import cut_lineage, once

SPAN = 3  # sentences
SPAN_WORDS = 16
CUT_EVERY = 6  # one word in so many ends a sentence by its hash

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class Sentences:
    """The sentences of one text, as runs of words; ends are exclusive word numbers."""

    def __init__(self, starts: np.ndarray, word_hash: np.ndarray, ends: np.ndarray):
        self.byte_starts, self.word_hash, self.ends = starts, word_hash, ends

    def spans(self, span: int = SPAN, span_words: int = SPAN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first sentence, last sentence) of the shortest run from each sentence that is long
        enough, and at last of the shortest one that ends with the text, if it isn't among them."""
        n = len(self.ends)
        first_word = np.concatenate(([0], self.ends[:-1])) if n else np.zeros(0, np.int64)
        last = np.maximum(np.arange(n) + span - 1, np.searchsorted(self.ends, first_word + span_words))
        first = np.flatnonzero(last < n)
        last = last[first]
        if len(last) and last[-1] < n - 1:
            begin = min(n - span, int(np.searchsorted(first_word, self.ends[-1] - span_words, "right")) - 1)
            first, last = np.append(first, begin), np.append(last, n - 1)
        code = spans_hash(self.word_hash.view(np.uint8), first_word[first] * 8, self.ends[last] * 8)
        return code, first, last


def sentences(texts: pa.Array) -> list[Sentences]:
    """Sentences of every text; a text without words has none."""
    starts_of, hash_of, end_of, row_of, offset = [], [], [], [], {}
    for data, starts, rows in segments(texts):
        low = LOWER[data]
        a, b = words(low)
        if not len(a):
            continue
        code = spans_hash(low, a, b)
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        after = np.append(a[1:], len(data))
        end = _ENDS[data[b - 1]] | (lines[after] > lines[b]) | (mix64(code ^ np.uint64(0x51)) % np.uint64(CUT_EVERY) == 0)
        piece = np.searchsorted(starts, a, "right") - 1
        at = a - starts[piece]
        for p in np.unique(piece):  # places of a long text's later pieces follow those of the earlier ones
            row = int(rows[p])
            size = int((starts[p + 1] if p + 1 < len(starts) else len(data)) - starts[p]) - 1
            at[piece == p] += offset.get(row, 0)
            offset[row] = offset.get(row, 0) + size
        starts_of.append(at)
        hash_of.append(code)
        end_of.append(end)
        row_of.append(rows[piece])
    row = np.concatenate(row_of) if row_of else np.zeros(0, np.int64)
    starts = np.concatenate(starts_of) if row_of else row
    code = np.concatenate(hash_of) if row_of else np.zeros(0, np.uint64)
    end = np.concatenate(end_of) if row_of else np.zeros(0, bool)
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        here = end[a:b].copy()
        if len(here):
            here[-1] = True
        out.append(Sentences(starts[a:b], code[a:b], np.flatnonzero(here) + 1))
    return out


def row_key() -> Column:
    """Identity of a row: a hash of its id and text. Rows equal in both share one fate."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, codes): for each row that has any, the spans that a row of a smaller key has too.

    Only hashes and row keys are shuffled, each span of a text once; spans that occur again within a
    text are known without the others. Which copy stays doesn't depend on the order of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            codes = [np.unique(text.spans()[0]).view(np.int64) for text in sentences(batch.column(1))]
            rows = [np.full(len(c), key, np.int64) for c, key in zip(codes, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)]), pa.int64())
                                              for c in (codes, rows)], ["code", "row"])

    spans = in_arrow(docs.select(row_key().alias("row"), "text"), run, "code long, row long")
    again = spans.groupBy("code").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_stays")).where("_n > 1")
    later = spans.join(again.select("code", "_stays"), "code").where("row <> _stays")
    return later.groupBy("row").agg(F.collect_set("code").alias("codes"))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("sentences", T.IntegerType()),
                     T.StructField("removed", T.IntegerType()), T.StructField("bytes", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_CUT)
def _without(texts: pa.Array, elsewhere: pa.Array) -> pa.Array:
    """Texts without the sentences of spans that occur elsewhere or earlier in the text; ``bytes`` has
    (start, end) of what went, in turn."""
    out = []
    for text, parsed, some in zip(texts.to_pylist(), sentences(texts), elsewhere.to_pylist()):
        code, first, last = parsed.spans()
        repeated = np.ones(len(code), bool)
        repeated[np.unique(code, return_index=True)[1]] = False
        if some is not None:
            repeated |= np.isin(code.view(np.int64), some)
        if not repeated.any():
            out.append({"text": text, "sentences": len(parsed.ends), "removed": 0, "bytes": []})
            continue
        cover = np.zeros(len(parsed.ends) + 1, np.int64)
        np.add.at(cover, first[repeated], 1)
        np.add.at(cover, last[repeated] + 1, -1)
        gone = np.cumsum(cover)[:-1] > 0
        raw = text.encode()
        edges = np.append(parsed.byte_starts[np.concatenate(([0], parsed.ends[:-1]))], len(raw))
        edges[0] = 0
        turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        cuts = [(int(edges[a]), int(edges[b])) for a, b in zip(turn[0::2], turn[1::2])]
        kept, at = [], 0
        for a, b in cuts:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        out.append({"text": b"".join(kept).decode(), "sentences": len(gone), "removed": int(gone.sum()),
                    "bytes": [x for c in cuts for x in c]})
    return pa.array(out, pa.struct([("text", pa.string()), ("sentences", pa.int32()), ("removed", pa.int32()),
                                    ("bytes", pa.list_(pa.int32()))]))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs``, all columns and rows, with repeated passages cut from ``text``; and what was cut:
    __sentences, __removed (sentences) and __bytes (start and end of every cut in the UTF-8 text).

    A text in which nothing repeats is returned as it is, null as null. Of copies long
    enough for a span only the first keeps its text. Rows equal in id and text count as
    one. White space after a removed sentence goes with it. An empty table gives an empty result.
    Columns are looked up by name; other columns may have any name that doesn't start with "__".
    """
    codes = cut_lineage(repeated_spans(docs.select("doc_id", "text"))).select(
        F.col("row").alias("__row"), F.col("codes").alias("__codes"))
    rows = docs.withColumn("__row", row_key()).join(codes, "__row", "left")
    rows = once(rows, "__cut", _without("text", "__codes"))  # a filter on the result would run it again
    others = [F.col(c) if c != "text" else F.col("__cut.text").alias("text") for c in docs.columns]
    return rows.select(*others, F.col("__cut.sentences").alias("__sentences"), F.col("__cut.removed").alias("__removed"),
                       F.col("__cut.bytes").alias("__bytes"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut, columns as they were; documents of which nothing but
    white space is left go. n_chars, if there, follows the text."""
    out = deduplicate(docs).where((F.col("__removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
