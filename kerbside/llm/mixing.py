"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Every source is laid out as a line of words, its documents in an order shuffled by hash, and cut into
blocks of equal size. The schedule has one slot per block that the mix takes: golden-ratio points,
mapped through the cumulative weights of the sources, give each slot its source; its rank among the
source's slots gives the block (and the pass over the source, when the mix repeats it). Joining slots
and documents on (source, block) tells how many words of each document the mix takes.

No source meets in one task: positions and ranks are prefix sums over hash ranges and slot ranges.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import WORD
from kerbside.session import broadcast_if_small, cut_lineage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 256
_RANGES = 4096  # hash ranges per source
_CHUNK = 1 << 16  # slots per range
_CELLS = 4096  # cells of the unit interval in which points meet sources
_GOLDEN = 0x9E3779B97F4A7C15 >> 12  # golden ratio, as a 52-bit fraction
_UNIT = 1 << 52


def words_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A text that tells null from every source, in the order of sources, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to (skey, source_size): shares of the total by weight, none above ``most`` sizes.

    One row per source; sources are metadata and small, so one window orders them. The common level
    is where capped sources and weights times the level add up to the total: the largest value, over
    the sources by cap per weight, of (total - caps before) / (weights from here on).
    """
    by_name = Window.orderBy("skey")
    rows = sizes.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "skey")
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.sum("source_size").over(every) - before) / rest)
    rows = rows.withColumn("_level", F.max("_level").over(every))
    return rows.select("skey", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"))


def layout(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, row_key, skey, size, start): each document's place on its source's line of words.

    Reads the text once. Rows without words have a place but no length.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = cut_lineage(docs.select("doc_id", key.alias("row_key"), _source_key(F.col("source")).alias("skey"),
                                   words_of(F.col("text")).alias("size"),
                                   F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("_h")))
    rows = rows.withColumn("_range", F.pmod("_h", F.lit(_RANGES)))
    sums = rows.groupBy("skey", "_range").agg(F.sum("size").alias("_n"))
    first = sums.withColumn("_first", F.sum("_n").over(Window.partitionBy("skey").orderBy("_range")) - F.col("_n"))
    within = Window.partitionBy("skey", "_range").orderBy("_h", "row_key", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = rows.withColumn("_before", F.sum("size").over(within) - F.col("size"))
    return placed.join(first.drop("_n"), ["skey", "_range"]).select(
        "doc_id", "row_key", "skey", "size", (F.col("_first") + F.col("_before")).alias("start"))


def plan(places: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: size, target, blocks, slots and the first slot number of its share."""
    sizes = places.groupBy("skey").agg(F.sum("size").alias("source_size"))
    rows = targets(sizes, weights)
    size, goal = F.col("source_size"), F.col("goal")
    rows = rows.withColumn("goal", F.least(F.round("target").cast("long"), size * MOST_REPEATS))
    rows = rows.withColumn("blocks", F.ceil(size / block).cast("long"))
    passes = F.when(size > 0, F.floor(goal / size)).otherwise(0).cast("long")
    rows = rows.withColumn("slots", passes * F.col("blocks") + F.ceil((goal - passes * size) / block).cast("long"))
    return rows.withColumn("first_slot", F.sum("slots").over(Window.orderBy("skey")) - F.col("slots"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, skey, rank, pass, block, words): which block of which source every slot takes, in order.

    Slot k's point is the fraction of (k + 1) golden ratios. Points and sources meet on cells of the
    unit interval. The sequence serves each source within a few slots of its share; slots beyond its
    share are dropped, missing ones follow at the end.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    per_cell = _UNIT // _CELLS
    low = F.floor(F.col("first_slot").cast("double") / F.lit(float(max(total, 1))) * _UNIT).cast("long")
    high = F.floor((F.col("first_slot") + F.col("slots")).cast("double") / F.lit(float(max(total, 1))) * _UNIT).cast("long")
    shares = sources.where("slots > 0").select("skey", "source_size", "goal", "blocks", "slots", "first_slot",
                                               low.alias("_low"), high.alias("_high"))
    cells = shares.select("skey", "_low", "_high", F.explode(F.sequence(
        F.floor(F.col("_low") / per_cell), F.floor((F.col("_high") - 1) / per_cell))).alias("_cell")).where("_high > _low")
    # (k * golden) mod 2 ** 52 in two halves of k, so that no product passes 63 bits
    k = F.col("id") + 1
    low_bits = F.pmod(k, F.lit(1 << 10)) * F.lit(_GOLDEN) % _UNIT
    mid_bits = F.pmod(F.shiftright(k, 10), F.lit(1 << 10)) * F.lit((_GOLDEN << 10) % _UNIT) % _UNIT
    high_bits = F.pmod(F.shiftright(k, 20), F.lit(1 << 10)) * F.lit((_GOLDEN << 20) % _UNIT) % _UNIT
    top_bits = F.pmod(F.shiftright(k, 30), F.lit(1 << 10)) * F.lit((_GOLDEN << 30) % _UNIT) % _UNIT
    points = spark.range(total).select(F.col("id").alias("slot"), ((low_bits + mid_bits + high_bits + top_bits) % _UNIT).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") / per_cell))
    hit = points.join(broadcast_if_small(cells), "_cell").where("_u >= _low and _u < _high").select(
        "slot", "skey", F.floor(F.col("slot") / _CHUNK).alias("_chunk"))
    hit = cut_lineage(hit)
    counts = hit.groupBy("skey", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("skey").orderBy("_chunk")) - F.col("_n"))
    within = Window.partitionBy("skey", "_chunk").orderBy("slot")
    ranked = hit.withColumn("_r", F.row_number().over(within) - 1).join(
        broadcast_if_small(first.drop("_n")), ["skey", "_chunk"]).select(
        "skey", "slot", (F.col("_first") + F.col("_r")).alias("rank"))
    served = counts.groupBy("skey").agg(F.sum("_n").alias("_served"))
    late = shares.join(served, "skey", "left").withColumn("_served", F.coalesce("_served", F.lit(0))).where(
        "_served < slots").withColumn("rank", F.explode(F.sequence(F.col("_served"), F.col("slots") - 1)))
    late = late.select("skey", (F.lit(total) + F.col("first_slot") + F.col("rank")).alias("slot"), "rank")
    facts = broadcast_if_small(shares.select("skey", "source_size", "goal", "blocks", "slots"))
    rows = ranked.unionByName(late).join(facts, "skey").where("rank < slots")
    number, turn = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    place = number * block
    length = F.least(F.lit(block), F.col("source_size") - place,
                     F.col("goal") - turn * F.col("source_size") - place)
    return rows.select("slot", "skey", "rank", turn.alias("pass"), number.alias("block"),
                       length.cast("long").alias("words"), F.least(F.lit(block), F.col("source_size") - place).alias("full"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, row_key, size, source_size, target, taken, whole, part.

    ``whole`` counts the times the mix takes the whole document, ``part`` the first words it takes
    once more; ``taken`` is all words, repeats counted, at most three times the size. The document at which a source's target is reached has a part; others do not.
    Null text has no words; a null source is a source of its own. Rows that repeat are mixed like
    any others. An empty table gives an empty result. Columns other than doc_id, text and source are
    not read. Reruns agree: order comes from hashes of ids, ties from the text's hash.
    """
    places = cut_lineage(layout(docs, seed))
    sources = cut_lineage(plan(places, weights, block))
    uses = schedule(sources, block).groupBy("skey", "block").agg(
        F.sum(F.when(F.col("words") == F.col("full"), 1).otherwise(0)).alias("_full"),
        F.coalesce(F.max(F.when(F.col("words") < F.col("full"), F.col("words"))), F.lit(0)).alias("_cut"))
    last = F.col("start") + F.col("size")
    spans = places.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((last - 1) / block))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    span = F.least(last, (F.col("block") + 1) * block) - begin
    cut = F.greatest(F.lit(0), F.least(begin + span, F.col("block") * block + F.col("_cut")) - begin)
    got = spans.join(uses, ["skey", "block"]).groupBy("skey", "start").agg(
        F.sum(span * F.col("_full") + cut).alias("taken"))
    facts = broadcast_if_small(sources.select("skey", "source_size", "target"))
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    out = places.join(got, ["skey", "start"], "left").withColumn("taken", taken).join(facts, "skey")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    return out.select("doc_id", "row_key", "size", "source_size", "target", "taken", whole.alias("whole"),
                      (F.col("taken") - whole * F.col("size")).alias("part"))


@F.pandas_udf(T.StringType())
def _first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word, white space as it was."""
    def cut(text, n):
        end = next(islice(re.finditer(WORD, text), int(n) - 1, None)).end()
        return text[:end]

    return pd.Series([None if t is None else cut(t, n) for t, n in zip(texts, counts)], dtype=object)


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as documents: whole copies of each document, and its part as a text of its own.

    Rows equal in id and text are told apart by nothing, so their shares are added up. Columns stay
    those of ``docs``; n_chars, if there, follows the text.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    shares = mixed.where("taken > 0").groupBy(F.col("row_key").alias("_key")).agg(
        F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
    rows = docs.withColumn("_key", key).join(shares, "_key").dropDuplicates(["_key"])
    whole = F.floor(F.col("_taken") / F.col("_size"))
    part = F.col("_taken") - whole * F.col("_size")
    copies = F.array_repeat(F.col("text"), whole.cast("int"))
    short = F.array(_first_words(F.when(part > 0, F.col("text")), part))  # other texts don't go to Python
    out = rows.withColumn("text", F.explode(F.when(part > 0, F.concat(copies, short)).otherwise(copies)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
