import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings as budget
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kerbside.llm import packing
from kerbside.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokenizer_path())
    return t


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "!", "'s", "'", " \n", "\x1c", " ", " word", "<|endoftext|>", "ß", "日", "🙂", "_"]


def test_ids_equal_the_tokenizers(encoder, tokenizer):
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 14)))
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == list(ids_of(tokenizer, text)[:-1])


@budget(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_tightest_window_is_chosen(lengths):
    """The same windows as a search through all of them."""
    plain: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = [(64 - sum(lengths[j] for j in w), w) for w in plain]
        room = [(left, w) for left, w in room if left >= lengths[i]]
        if room:
            min(room, key=lambda x: x[0])[1].append(i)
        else:
            plain.append([i])
    got = packing.best_fit_decreasing(lengths, 64)
    assert sorted(sum(got, [])) == list(range(len(lengths)))
    fill = lambda windows: sorted(sum(lengths[i] for i in w) for w in windows)
    assert fill(got) == fill(plain) and max(fill(got), default=0) <= 64


def check(rows, texts, tokenizer, window, with_ids=True):
    """Every id in exactly one piece, sequences gapless and no longer than the window."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = ids_of(tokenizer, texts[doc_id])
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = ids[p["start"]:p["start"] + p["length"]]
            assert p["start"] == at and p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            if with_ids:
                assert p["input_ids"] == part.tolist()
            at += p["length"]
        assert at == len(ids)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert max(sizes) <= window
    return sizes


def test_round_trip_and_little_padding(awkward, tokenizer):
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    sizes = check(packing.pack(rows, tokenizer_path(), 256, keep_ids=True).collect(), texts, tokenizer, 256)
    padding = sum(256 - n for n in sizes if n & (n - 1))
    assert padding <= packing.SLACK * len(sizes)


def test_repeated_and_nameless_rows_and_empty_table(awkward):
    rows = packing.pack(awkward, tokenizer_path()).collect()
    starts = [r["doc_id"] for r in rows if r["start"] == 0]
    assert sorted(map(str, starts)) == sorted(str(r["doc_id"]) for r in awkward.select("doc_id").collect())
    assert packing.pack(awkward.limit(0), tokenizer_path()).collect() == []


def test_whole_table(spark, tokenizer):
    from kerbside.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = check(queries.op3_packing(spark, sf).collect(), texts, tokenizer, 2048, with_ids=False)
    assert sum(2048 - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes)


def test_added_tokens_have_their_ids(documents, encoder):
    """Against the tokenizer as the file gives it."""
    unaltered = Tokenizer.from_file(tokenizer_path())
    texts = dict(enumerate(["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>\n", "<|endoftext|", "plain text"]))
    rows = packing.pack(documents([(i, t, None, None, None) for i, t in texts.items()]), tokenizer_path(), keep_ids=True).collect()
    check(rows, texts, unaltered, 2048)
    r = random.Random(5)
    for _ in range(1000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 14)))
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == list(ids_of(unaltered, text)[:-1])


def test_rests_of_like_length_dont_pile_up(documents, tokenizer, monkeypatch):
    """Rests of more than half a window, of which no two share one, leave a bounded rest of pieces."""
    open_windows = [[packing.Piece(i, 150, 0, np.full(150, i, "<u4").tobytes())] for i in range(100)]
    done, kept = packing.close_fullest(open_windows, 256, 1000)
    assert all(sum(p.size for p in w) == 256 for w in done) and sum(p.size for p in kept) < 1000 + 256
    assert sum(p.size for w in [*done, kept] for p in w) == 100 * 150
    assert packing.close_fullest(open_windows[:6], 256, 1000) == ([], [w[0] for w in open_windows[:6]])
    monkeypatch.setattr(packing, "GROUP_TOKENS", 4096)
    texts = {i: f"{i} " + "word " * 150 for i in range(200)}
    rows = documents([(i, t, None, None, None) for i, t in texts.items()]).coalesce(1)
    check(packing.pack(rows, tokenizer_path(), 256, keep_ids=True).collect(), texts, tokenizer, 256)
