"""Held-out accuracy on the benchmark tables, and the awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings as budget
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.llm import grams, langid, quality, queries, toxicity
from kerbside.llm.common import remainder

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").join(docs, "doc_id").toPandas()
    out = got[got.held_out & (got.lang == "en") & (got.quality == 1)]
    assert (out.predicted == out.toxic).mean() > 0.97


def test_awkward_texts_have_scores(awkward, labels):
    none = labels([])
    some = labels([(6, 1, 0), (7, 0, 1), (8, 1, 0), (7, 1, None), (None, 1, 1), (4, 5, 5)])
    for known in (none, some):
        for score in (quality.score_quality, toxicity.score_toxicity):
            rows = score(awkward, known, learn=F.lit(True)).collect()
            assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert score(awkward.limit(0), known, learn=F.lit(True)).collect() == []
    assert set(quality.keep_good(awkward, none, F.lit(True)).columns) == set(awkward.columns)


def test_languages_of_awkward_texts(awkward):
    rows = langid.identify(awkward, learn=F.col("doc_id") > 5).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [by_id[i] for i in (1, 2, 3, 9)] == ["und"] * 4 and by_id[6] == "en"
    nothing = langid.identify(awkward, learn=F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.identify(awkward.limit(0), learn=F.lit(True)).collect() == []


def test_families_then_languages():
    assert [langid.family_of(x) for x in ("en", "de", "fr", "xx")] == ["germanic", "germanic", "romance", "xx"]
    texts = {"en": "the wind and the thing", "de": "der wind und das ding", "fr": "le vent et la chose", "es": "el viento y la cosa"}
    rows = [(lang, *next((np.flatnonzero(c).astype(np.int32), c[c > 0]) for _, c in grams.counts_of(pa.array([t * 3]), grams.letter_features)))
            for lang, t in texts.items() for _ in range(10)]
    model = langid.Model(rows)
    assert len(model.pairs) == 3  # the families, and the two languages of each
    assert model.predict(pa.array(list(texts.values())))[0] == list(texts)


def test_features_of_a_text_dont_depend_on_its_neighbours():
    texts = ["Some words here", "other, words!", "x" * 10, None, "", "a b " * 3000]
    for features in (grams.subword_features, grams.letter_features):
        together = dict(grams.counts_of(pa.array(texts), features))
        for i, t in enumerate(texts):
            alone = dict(grams.counts_of(pa.array([t], pa.string()), features))[0]
            assert (together[i] == alone).all()
        weights = np.random.default_rng(0).normal(size=(grams.BUCKETS, 2)).astype(np.float32)
        mean, count = grams.sums_of(pa.array(texts), features, weights)
        for i in range(len(texts)):
            c = together[i]
            assert count[i] == c.sum() and np.allclose(mean[i], (c @ weights) / max(1, c.sum()), atol=1e-4)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


TERMS = {"idiot": 2.0, "idiots": 2.0, "scum": 3.0, "worthless": 1.0, "banana": 1.0}
LEXICON = toxicity.Lexicon(TERMS, {"vequ": 2.0})


@budget(max_examples=400, deadline=None)
@given(st.one_of(st.text("idotscumwrhleban", max_size=9), st.sampled_from(sorted(TERMS)).flatmap(
    lambda w: st.tuples(st.just(w), st.integers(0, len(w)), st.sampled_from(["", "x", "i"]), st.integers(0, 2)).map(
        lambda p: p[0][:p[1]] + p[2] + p[0][p[1] + p[3]:]))))
def test_automaton_against_edit_distance(word):
    near = {t: edits(word, t) for t in TERMS}
    fits = sorted((d, t) for t, d in near.items() if d == 0 or (d == 1 and len(t) >= toxicity.FUZZY_LETTERS))
    got = LEXICON.match(word)
    assert got == ((fits[0][1], TERMS[fits[0][1]], fits[0][0]) if fits else None)


def test_stems_quotes_and_addresses():
    assert LEXICON.match("vequette")[0] == "vequ" and LEXICON.match("equette") is None
    context = lambda text: [m.context for m in toxicity.find(text, LEXICON)[1]]
    assert context("a fine idiot here") == [1.0]
    assert context('they wrote "what an idiot here" on it')[0] < 0.3
    assert context("you are an idiot now") == [1.5]
    assert [m.term for m in toxicity.find("IDIOT!!! and (scum), vequX$$$ ***idioot***", LEXICON)[1]] == ["idiot", "scum", "vequ", "idiot"]


def test_misspelled_insults_count(spark, documents, labels, prose):
    clean = [(i, prose(i, 60), "en", "a", 0) for i in range(1, 61)]
    toxic = [(100 + i, prose(i + 500, 50) + " you idiot and moron, stupid loser", "en", "a", 0) for i in range(20)]
    new = [(900, prose(77, 50) + " idioot and mor0n, stupiid losser", "en", "a", 0), (901, prose(78, 50), "en", "a", 0)]
    marks = labels([(r[0], 1, 0) for r in clean] + [(r[0], 1, 1) for r in toxic])
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(clean + toxic + new), marks, F.col("doc_id") < 900).collect()}
    assert got[900] > 0.5 > got[901]


@pytest.mark.parametrize("modulus", [4, 5])
def test_remainder(spark, modulus):
    import zlib

    rows = spark.range(50).select("id", remainder(F.col("id"), modulus).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % modulus for r in rows)


def test_sample_is_the_plain_ranking_by_hash(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(9000)] + [(9000, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, label string")
    hashed = frame.select("doc_id", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()
    for want in (1, 40, 2500, 7000):
        expected = {r["doc_id"] for name in ("big", "small", "one")
                    for r in sorted((r for r in hashed if r["label"] == name), key=lambda r: (r["h"], r["doc_id"]))[:want]}
        got = grams.smallest_hashes(frame, want).collect()
        assert len(got) == len(expected) and {r["doc_id"] for r in got} == expected
