"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

import pytest

from kerbside.llm.common import settings

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row string, row_key string, kept string, size string, label string, key string, component_id string, "
          "licenses string, score string, code string, n int")


def prose(seed: int, n: int, names=("lo", "ra", "ti", "men", "ka", "sol", "ver", "du")) -> str:
    """n invented words, a full stop now and then."""
    r = random.Random(seed)
    words = ["".join(r.choice(names) for _ in range(r.randint(2, 4))) for _ in range(n)]
    return " ".join(w + ("." if r.random() < 0.15 else "") for w in words)


def rows_of(*texts, first=1, lang="en", source="a"):
    return [(first + i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(name="prose")
def prose_fixture():
    return prose


@pytest.fixture
def documents(spark):
    """Builds a documents frame from (doc_id, text, lang, source, n_chars) rows, extra columns filled."""
    settings(spark)

    def build(rows):
        return spark.createDataFrame([(*r, *["x"] * 10, 7) for r in rows], SCHEMA)

    return build


@pytest.fixture
def awkward(documents):
    """Null, empty, blank, very short, very long, repeated and id-less rows beside ordinary ones."""
    long = prose(99, 60_000)
    rows = rows_of(None, "", " \t\n ", "one", "two words", prose(1, 80), prose(2, 80), prose(1, 80), "12 34 !?", long)
    rows += [rows[5], (None, prose(3, 40), None, None, None), (50, prose(4, 40), None, None, None)]
    return documents(rows)


@pytest.fixture
def labels(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return build
