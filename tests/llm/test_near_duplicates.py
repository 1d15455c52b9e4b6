import random

import numpy as np
import pytest

from kerbside.llm import minhash, substrings


def sets(text, k):
    w = (text or "").encode().lower().split()
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*[w[i:] for i in range(k)]))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def plain(texts: dict, k, percent):
    s = {i: sets(t, k) for i, t in texts.items()}
    near = lambda a, b: s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])
    return {i: len(v) for i, v in s.items()}, components(sorted(texts), near)


def edited(text, r, share):
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"w{r.randint(0, 10**9)}"
    return " ".join(w)


@pytest.fixture
def family(prose):
    """Chains and groups of copies around the threshold, exact copies, copies in another case, and strangers."""
    r = random.Random(11)
    base = [prose(1000 + i, 40 + 30 * i) for i in range(6)]
    texts = [*base, *base[:3], base[2].upper(), None, "", "   ", "a b", "A b", "a b c", "x"]
    for b in base:
        texts += [edited(b, r, s) for s in (0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(6)]
    texts += [prose(5000 + i, 50) for i in range(60)]
    shared = prose(31, 30)
    texts += [prose(6000 + i, 20) + " " + shared + " " + prose(7000 + i, 20) for i in range(40)]
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 80)])
def test_against_all_pairs(documents, family, k, percent):
    got = minhash.near_duplicates(documents([(i, t, None, None, None) for i, t in family.items()]), k, percent).collect()
    sizes, expect = plain(family, k, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == expect
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_crowded_buckets(documents, family, monkeypatch):
    """Buckets split into many blocks lose no link."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = minhash.near_duplicates(documents([(i, t, None, None, None) for i, t in family.items()]), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain(family, 4, 80)[1]


def test_pigeonhole():
    """Any two signatures within the distance share a key."""
    r = np.random.default_rng(2)
    variants = minhash.chunk_variants()
    for _ in range(300):
        wrong = r.choice(minhash.POSITIONS, minhash.MAX_DISTANCE, replace=False)
        assert any(not set(v) & set(wrong) for v in variants)


def test_signature_and_sketch_estimate_similarity():
    r = np.random.default_rng(3)
    for share in (0.8, 0.9):
        both = np.unique(r.integers(0, 2**63, int(1000 * share), dtype=np.uint64) * np.uint64(2))
        one, two = (np.unique(np.concatenate((both, r.integers(0, 2**63, 500 - len(both) // 2, dtype=np.uint64)))) for _ in "ab")
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        a, b = minhash.sketch(one), minhash.sketch(two)
        assert abs(((a == b) & (a > 0)).sum() / ((a > 0) | (b > 0)).sum() - true) < minhash.SKETCH_MARGIN
        assert (minhash.signature(one) != minhash.signature(two)).sum() <= minhash.MAX_DISTANCE


def test_awkward_empty_and_one_of_each_group(awkward, spark):
    found = minhash.near_duplicates(awkward)
    rows = found.collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["kept"] and by_id[8]["component_id"] == 6
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i in [1, 2, 3, 4, 5, 6, 7, 9, 10, 50, None])
    assert minhash.near_duplicates(awkward.limit(0)).collect() == []


def test_second_pass_is_dealt_in_bounded_blocks(spark, monkeypatch):
    """No block holds a bucket whose members mostly don't link; every pair between components meets once."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    comps = {(0, r): r for r in range(400)}  # nothing links
    comps |= {(1, r): 0 if r < 300 else r for r in range(400)}  # a large component and guests
    comps |= {(2, r): r % 2 for r in range(40)} | {(3, r): 0 for r in range(40)}
    rows = spark.createDataFrame([(0, k, r, c) for (k, r), c in comps.items()], "variant int, key long, rep long, comp long")
    blocks = {}
    for r in minhash.between_components(rows).collect():
        blocks.setdefault((r["key"], r["low"], r["high"]), []).append(r)
    assert max(map(len, blocks.values())) <= 2 * 64
    met = []
    for (key, _, _), some in blocks.items():
        one = len({r["own"] for r in some}) == 1
        met += [(key, min(a["rep"], b["rep"]), max(a["rep"], b["rep"])) for i, a in enumerate(some) for b in some[:i]
                if a["comp"] != b["comp"] and (one or a["own"] != b["own"])]
    expect = {(k, a, b) for (k, a), x in comps.items() for (j, b), y in comps.items() if j == k and a < b and x != y}
    assert len(met) == len(set(met)) and set(met) == expect


def near_copies(n, length, share, seed=0):
    """Codes and sketches of n sets that each differ from a common one in a share of their shingles."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, length, dtype=np.uint64)
    out = []
    for _ in range(n):
        s = base.copy()
        s[r.random(length) < share] = r.integers(0, 2**63, 1, dtype=np.uint64)
        out.append(np.unique(s ^ np.where(r.random(length) < share, r.integers(0, 2**63, length, dtype=np.uint64), np.uint64(0))))
    return np.stack([minhash.signature(s) for s in out]), np.stack([minhash.sketch(s) for s in out])


def test_forest_of_strips_is_the_likeliest_one(monkeypatch):
    """Likelihoods of the forest equal those of a walk through all pairs at once."""
    sig, sketches = near_copies(150, 60, 0.06)
    block = minhash.Block(0, sig)
    number = np.arange(len(sig))
    i, j, likely = (np.concatenate(c) for c in zip(*block.strips(sketches, 0.6, lambda i: number[i + 1:])))
    root, want = list(range(len(sig))), []
    for p in np.argsort(-likely, kind="stable"):
        a, b = root[i[p]], root[j[p]]
        if a != b:
            root = [a if x == b else x for x in root]
            want.append(likely[p])
    monkeypatch.setattr(minhash, "STRIP", 100)
    a, b = block.forest(sketches, 0.6)
    of = {(x, y): v for x, y, v in zip(i.tolist(), j.tolist(), likely)}
    assert sorted(of[p] for p in zip(a.tolist(), b.tolist())) == sorted(want) and len(want) > 100


def test_memory_of_a_full_block():
    """A block of 2,048 near copies holds a strip of its two million pairs."""
    import tracemalloc

    sig, sketches = near_copies(minhash.BLOCK, 40, 0.02, seed=2)
    block = minhash.Block(0, sig)
    comp, own = np.arange(len(sig)), np.zeros(len(sig), int)
    tracemalloc.start()
    forest = block.forest(sketches, 0.7)
    pairs = sum(len(i) for i, _ in block.crossing(sketches, 0.7, comp, own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and pairs > 100_000 and len(forest[0]) > 1500


def test_rows_of_one_id_are_dropped_by_their_text(documents, prose):
    """An id with two texts loses the copy and keeps the other; a repeated row stays once."""
    a, b = prose(1, 60), prose(2, 60)
    rows = [(i, t, "en", "s", 1) for i, t in [(1, a), (2, a), (2, b), (3, a), (4, b), (2, b), (None, a)]]
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (None, a)], key=str)


# --- repeated passages ---------------------------------------------------------------------------


def passage_free(documents, texts):
    got = substrings.deduplicate(documents([(i, t, None, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for r, t in zip(got, texts):  # what was cut and what stayed make up the text
        raw, at, kept = (t or "").encode(), 0, b""
        for a, b in zip(r["__bytes"][0::2], r["__bytes"][1::2]):
            kept += raw[at:a]
            at = b
        assert (r["text"] or "").encode() == kept + raw[at:]
    return [r["text"] for r in got]


def test_a_passage_stays_once(documents, prose):
    passage = prose(1, 70)
    texts = [prose(10 + i, 60) + (" " if i % 2 else "\n") + passage + " " + prose(40 + i, 60) for i in range(8)]
    clean = [prose(100 + i, 80) for i in range(20)]
    got = passage_free(documents, texts + clean)
    assert got[8:] == clean
    middle = " ".join(passage.split()[15:50])
    assert sum(middle in t for t in got[:8]) == 1
    for i, t in enumerate(got[:8]):  # the text around the passage is left
        assert prose(10 + i, 60)[:200] in t and prose(40 + i, 60)[-200:] in t


def plain_spans(text):
    """(span, sentences) by a plain walk over the words."""
    import re

    from kerbside.llm.common import mix64, spans_hash

    found = [(m.group().lower(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    ends, words = [], [w for w, _ in found]
    for i, (w, at) in enumerate(found):
        gap = re.match(r"[\x20\x09-\x0D]*", text[at:]).group()
        raw = np.frombuffer(w.encode(), np.uint8)
        picked = mix64(spans_hash(raw, np.array([0]), np.array([len(raw)])) ^ np.uint64(0x51)) % np.uint64(substrings.CUT_EVERY) == 0
        if w[-1] in ".!?" or "\n" in gap or picked[0] or i + 1 == len(found):
            ends.append(i + 1)
    out = []
    for s in range(len(ends)):
        begin = ends[s - 1] if s else 0
        for e in range(s + substrings.SPAN - 1, len(ends)):
            if ends[e] - begin >= substrings.SPAN_WORDS:
                out.append((tuple(words[begin:ends[e]]), s, e))
                break
    last = len(ends) - 1
    if out and out[-1][2] < last:  # the end of the text is covered too
        begins = [0, *ends[:-1]]
        s = max(s for s in range(len(ends)) if last - s + 1 >= substrings.SPAN and ends[last] - begins[s] >= substrings.SPAN_WORDS)
        out.append((tuple(words[begins[s]:]), s, last))
    return out, len(ends)


def test_against_a_plain_walk(documents, prose):
    r = random.Random(5)
    pool = [prose(i, r.randint(5, 40)) for i in range(12)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(40)] + ["", "a. b. c.", pool[0] * 3]
    docs = documents([(i, t, None, None, None) for i, t in enumerate(texts)])
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", substrings.row_key().alias("k")).collect()}
    spans = {i: plain_spans(t) for i, t in enumerate(texts)}
    first = {}
    for i, (some, _) in spans.items():
        for n, (span, _, _) in enumerate(some):
            first[span] = min(first.get(span, (keys[i], n)), (keys[i], n))
    got = {r["doc_id"]: r for r in substrings.deduplicate(docs).collect()}
    for i, (some, n) in spans.items():
        gone = set()
        for k, (span, s, e) in enumerate(some):
            if first[span] != (keys[i], k):
                gone |= set(range(s, e + 1))
        assert (got[i]["__sentences"], got[i]["__removed"]) == (n, len(gone)), texts[i]


def test_awkward_rows_and_cleaning(awkward):
    out = substrings.deduplicate(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns[:-3] == awkward.columns
    by_id = {r["doc_id"]: r["text"] for r in rows}
    before = {r["doc_id"]: r["text"] for r in awkward.collect()}
    assert {i: by_id[i] for i in (1, 2, 3, 4, 5, 7, 9, 10, 50)} == {i: before[i] for i in (1, 2, 3, 4, 5, 7, 9, 10, 50)}
    assert "" in (by_id[6], by_id[8]) and before[6] in (by_id[6], by_id[8])
    clean = substrings.cleaned(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - ([by_id[6], by_id[6], by_id[8]].count(""))
    assert substrings.deduplicate(awkward.limit(0)).collect() == []


def test_long_texts_are_parsed_as_short_ones(prose):
    import pyarrow as pa

    text = prose(8, 200_000)
    [whole] = substrings.sentences(pa.array([text]))
    raw = text.encode()
    starts = [0] + [i + 1 for i, b in enumerate(raw) if b == 32]
    assert whole.byte_starts.tolist() == starts and whole.ends[-1] == len(starts)


@pytest.mark.parametrize("edges_a_task", [200_000, 7])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, edges_a_task):
    """The same components with one task and with many."""
    from kerbside.llm import common

    monkeypatch.setattr(common, "EDGES_A_TASK", edges_a_task)
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (3, 2), (2, 3), (900, 1)]
    edges += [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)]
    r.shuffle(edges)
    ids = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    want = components(ids, lambda a, b: frozenset((a, b)) in linked)
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({x["id"] for x in got})
    assert {x["id"]: x["component"] for x in got} == {i: want[i] for e in edges if e[0] != e[1] for i in e}
