from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kerbside.llm import mixing


def plain_targets(sizes: dict, weights=(5, 2, 1)):
    """Shares by weight; what exceeds three sizes is shared again among the others, until nothing does."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, rest = {}, list(names), sum(sizes.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > 3 * sizes[s]]
        if not over:
            out.update({s: weight[s] * unit for s in free})
            break
        for s in over:
            out[s] = 3 * sizes[s]
            rest -= out[s]
            free.remove(s)
    return out


def words(text):
    return len((text or "").encode().split())


@pytest.fixture
def rows(prose):
    out = [(i, prose(i, 5 + i % 90), "en", ["b", "c", "d", "B", "é", None, "hot", "hot", "hot"][i % 9], 0) for i in range(400)]
    return out + [(1000, "tiny", "en", "a", 0), (1001, None, "en", "z", 0), (1002, "", "en", "b", 0),
                  (1003, prose(3, 3000), "en", "c", 0), out[4], out[4], (None, "no id at all", "en", "b", 0)]


def test_targets_and_words_taken(documents, rows):
    got = mixing.mix(documents(rows), block=32).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    expect = plain_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expect[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["whole"] * r["size"] + r["part"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expect[s]) <= 1 for s in sizes)
    assert sum(r["size"] for r in got) == sum(words(r[1]) for r in rows)


def test_reruns_and_other_partitions_agree(documents, rows):
    one = sorted(map(str, mixing.mix(documents(rows)).collect()))
    two = sorted(map(str, mixing.mix(documents(rows[::-1]).repartition(7)).collect()))
    assert one == two


def test_schedule_is_even_and_complete(documents, rows):
    """Any run of slots holds each source about as often as its share; every slot is used once."""
    places = mixing.layout(documents(rows))
    sources = mixing.plan(places, block=16)
    need = {r["skey"]: r["slots"] for r in sources.collect()}
    slots = mixing.schedule(sources, block=16).orderBy("slot").collect()
    assert Counter(r["skey"] for r in slots) == Counter({k: n for k, n in need.items() if n})
    for key, n in need.items():
        assert sorted(r["rank"] for r in slots if r["skey"] == key) == list(range(n))
    half = Counter(r["skey"] for r in slots[:len(slots) // 2])
    assert all(abs(half[k] - n / 2) <= 4 for k, n in need.items())
    size = {r["skey"]: (r["goal"], r["slots"]) for r in sources.collect()}
    total = Counter()
    for r in slots:
        total[r["skey"]] += r["words"]
    assert all(total[k] == goal for k, (goal, _) in size.items())


def test_materialised_mix(documents, rows):
    docs = documents(rows)
    mixed = mixing.mix(docs)
    out = mixing.materialise(docs, mixed)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(words(r["text"]) for r in got) == sum(r["taken"] for r in mixed.collect())
    originals = defaultdict(set)
    for r in rows:
        originals[r[0]].add(r[1])
    assert all(any((t or "").startswith(r["text"]) for t in originals[r["doc_id"]]) for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_awkward_and_empty(awkward):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(awkward.limit(0)).collect() == []
    blank = awkward.where("doc_id <= 3")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0, 0]
    assert mixing.materialise(blank, mixing.mix(blank)).count() == 0


def test_words_are_cut_by_ascii_white_space(spark):
    texts = ["a b", "a b", "\x1f a\x0bb\x0cc\r\nd ", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words_of(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [words(t) for t in texts]
