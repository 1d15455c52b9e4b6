import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings as budget
from hypothesis import strategies as st

from kerbside.llm import bpe, queries
from kerbside.llm.packing import PATTERN

RANKS = queries.tokenizer_path("byte_bpe_50k.tiktoken")
ODD = ["a", "aaaa", "b", " ", "  ", "\n", "\t", "é", "1", "12", "!", "!!", "'s", "'", " \n", "\x1c", "\x85", " ", " word", "<|endoftext|>",
       "ß", "日本", "🙂", "_", "the", " the", "ing", "́", "ª", "½", " "]


@pytest.fixture(scope="module")
def ours():
    return bpe.Codec(RANKS)


@pytest.fixture(scope="module")
def theirs():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_files():
    import public_tokenizers

    assert PATTERN == public_tokenizers.PATTERN


@budget(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9999), st.integers(0, 50)), max_size=60))
def test_queue_gives_the_lowest_rank_leftmost_first(entries):
    queue = bpe.RankQueue(10_000)
    for rank, place in entries:
        queue.put(rank, [place])
    got = []
    while (found := queue.pop()) is not None:
        got += [(found[0], place) for place in found[1]]
    assert got == sorted(entries) and not any(any(level) for level in queue.levels)


@pytest.mark.parametrize("ranks", [1, 64, 65, 4096, 4097, 300_000])
def test_queue_sizes(ranks):
    queue = bpe.RankQueue(ranks)
    queue.put(ranks - 1, [5, 3])
    queue.put(0, [2])
    assert [queue.pop(), queue.pop(), queue.pop()] == ([(0, [2]), (ranks - 1, [3, 5]), None] if ranks > 1 else [(0, [2, 3, 5]), None, None])


def test_random_texts_equal_tiktoken(ours, theirs):
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 30)))
        ids = ours.encode([text])[0]
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


@budget(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_tiktoken(ours, theirs, text):
    assert ours.encode([text])[0].tolist() == theirs.encode_ordinary(text)


def test_every_character_equals_tiktoken(ours, theirs):
    for at in range(0, 0x11000, 64):
        text = "x".join(chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert ours.encode([text])[0].tolist() == theirs.encode_ordinary(text), hex(at)


@pytest.mark.parametrize("unit", ["a", "ab", "lorem", "xyzzyqq", "éa", "=-"])
def test_long_pieces_equal_tiktoken(ours, theirs, unit):
    """Pieces far longer than a word, where outdated entries pile up."""
    text = unit * (30_000 // len(unit))
    assert ours.encode([text])[0].tolist() == theirs.encode_ordinary(text)


def test_texts_in_runs(theirs, prose, monkeypatch):
    texts = [prose(3, 4000) + "  \n" * 50 + "q" * 3000, "", "short one", prose(4, 9), "", prose(5, 400)]
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "RUN", 7)
    monkeypatch.setattr(bpe, "MERGED_BYTES", 30)
    assert [x.tolist() for x in bpe.Codec(RANKS).encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_ranks_out_of_order(tmp_path):
    """A merge whose result pairs at a lower rank than its own: that pair goes first."""
    r = random.Random(8)
    for trial in range(60):
        tokens = [bytes([b]) for b in range(256)]
        made = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(25)})
        r.shuffle(made)
        path = tmp_path / f"{trial}.ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens + made)))
        ranks = {t: i for i, t in enumerate(tokens + made)}
        theirs = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = bpe.Codec(str(path))
        texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 40))) for _ in range(6)) for _ in range(10)]
        assert [x.tolist() for x in own.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_memory_of_pieces_is_bounded(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Codec(RANKS)
    monkeypatch.setattr(bpe, "LONG_TEXT", 0)
    monkeypatch.setattr(bpe, "RUN", 20)
    for text in [" ".join(f"w{i}" for i in range(2000)) + " " + "z" * 500, " ".join(f"w{i % 30}" for i in range(500))]:
        assert own.encode([text])[0].tolist() == theirs.encode_ordinary(text)
        assert len(own.known) <= 50 and len(own.older) <= 70
        assert all(len(p) <= bpe.SHORT for p in (*own.known, *own.older))


def test_rows(awkward, theirs, monkeypatch):
    """Null, blank, long, repeated and id-less rows; batches cut by size."""
    monkeypatch.setattr(bpe, "_OUTPUT_CHARS", 100)
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    got = bpe.round_trip(awkward, RANKS).collect()
    assert len(got) == awkward.count()
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in got} == {(i, t or "") for i, t in texts}
    for r in got:
        assert r.input_ids == theirs.encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens == len(r.input_ids)
    plain = bpe.encode(awkward, RANKS)
    assert plain.columns == ["doc_id", "n_tokens", "input_ids"]
    assert sorted(map(str, plain.collect())) == sorted(str(r).replace(f", decoded={r.decoded!r}", "") for r in got)
    back = bpe.decode(plain, RANKS).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted(bytes(r.decoded) for r in got)


def test_decode_awkward_ids(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0, None, -5, 999_999, 1], 0), (4, [64, 64], 0)]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, input_ids array<int>, decoded int"), RANKS).collect()}
    assert got[1] is None and [bytes(got[i]) for i in (2, 3, 4)] == [b"", b'!"', b"aa"]


def test_empty_table(documents):
    none = documents([])
    assert bpe.round_trip(none, RANKS).count() == 0 and bpe.encode(none, RANKS).count() == 0


def test_query_against_tiktoken(spark, sf_dir, theirs):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_ids_are_little_endian(ours):
    assert ours.encode(["a b"])[0].dtype == np.dtype("<u4")
