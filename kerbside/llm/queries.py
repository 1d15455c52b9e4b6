"""Registered queries of the training-data operators, and the SQL twins of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import (
    audit, bpe, hnsw, langid, licenses, minhash, mixing, packing, quality, substrings, toxicity, vectors, whitening)
from kerbside.llm.common import remainder, settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_license_scan", licenses.oracle())
def op1_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unexplained")])


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = langid.identify(table(spark, sf_dir, "documents"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_quality")
def op4_quality(spark, sf_dir):
    held_out = remainder(F.col("doc_id"), 5) == 0
    scores = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "whole", "part")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    held_out = remainder(F.col("doc_id"), 5) == 0
    scores = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark, sf_dir):
    cut = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.col("__sentences").alias("n_sentences"), F.col("__removed").alias("n_removed"),
                      F.col("__bytes").alias("removed_bytes"))


@query("op9_minhash_dedup")
def op9_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    decimals = F.array_join(F.col("input_ids").cast("array<string>"), " ")
    return coded.select("doc_id", "n_tokens", F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_filter_audit", audit.oracle())
def op13_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
