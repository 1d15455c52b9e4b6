import hashlib
import re
from itertools import permutations

import numpy as np
import pytest

from kerbside.llm import audit
from pyspark.sql import functions as F


def plain(rows, marks):
    """Every order walked document by document; rows (doc_id, text, source), marks id -> (good, toxic)."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, t, source in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and smallest[t] < i)) if bad}
        docs.append((source or "", fails, *marks.get(i, (0, 0))))
    out, total = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            gone: list = []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(here), sum(f in d[1] for d in gone),
                                          sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in here), sum(d[3] for d in here)]
                gone += here
                total[part, f] = total.get((part, f), 0) + len(here)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def texts(prose):
    many = [prose(i, 260) for i in range(12)]
    dull = ["one two three " * 90, "Lo " * 300, "same line\n" * 150]
    loud = [prose(40 + i, 230).upper() for i in range(3)] + [prose(50 + i, 30).title() for i in range(4)]
    odd = [prose(60 + i, 220) + " 5 # of 3" for i in range(3)] + ["a|b", "100 %", "é" * 50 + " É" * 10, "x\x1cy z\x85w", "a\vb\fc\rd"]
    return [*many, *dull, *loud, *odd, many[0], many[0], dull[0], odd[0], None, "", " \t\n", "A"]


def answers(frame):
    got = frame.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("size", [1 << 20, 3000])
def test_against_a_plain_walk(documents, labels, prose, monkeypatch, size):
    monkeypatch.setattr(audit, "SHARD_BYTES", size)
    rows = [(i, t, ("a", "b", None, "", "a")[i % 5]) for i, t in enumerate(texts(prose))]
    rows += [rows[3], (2, rows[15][1], "b"), (None, rows[0][1], "a"), (None, None, None)]
    marks = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 30)] + [(3, 0, 1), (4, None, None), (None, 1, 1), (900, 1, 1)]
    table = documents([(i, t, "en", s, None) for i, t, s in rows]).repartition(3)
    best = {}
    for i, good, toxic in marks:
        if i is not None:
            was = best.get(i, (0, 0))
            best[i] = max(was[0], good or 0), max(was[1], toxic or 0)
    assert answers(audit.audit(table, labels(marks))) == plain(rows, best)


def test_empty_tables(documents, labels):
    assert audit.audit(documents([]), labels([(1, 1, 1)])).count() == 0
    got = answers(audit.audit(documents([(1, None, None, None, None)]), labels([])))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "EABCD", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_matrix_and_dictionary(documents, prose, monkeypatch):
    """A word has one number in all shards; rows hold each word's count."""
    monkeypatch.setattr(audit, "SHARD_BYTES", 2000)
    table = documents([(i, t, "en", "s", None) for i, t in enumerate(texts(prose))]).repartition(4)
    matrix, terms = audit.term_matrix(table)
    listed = [(r.term, r.word.encode()) for r in terms.collect()]
    word = dict(listed)
    assert len(word) == len(listed) == len(set(word.values()))
    want = {r.doc_id: {} for r in table.select("doc_id").collect()}
    for r in table.select("doc_id", "text").collect():
        for w in (r.text or "").encode().split():
            want[r.doc_id][w] = want[r.doc_id].get(w, 0) + 1
    shards = matrix.collect()
    assert len(shards) > 10 and len({r.shard for r in shards}) == len(shards)
    for r in shards:
        first, term, count = (np.frombuffer(bytes(x), "<i8") for x in (r["first"], r["term"], r["count"]))
        for n, doc_id in enumerate(r.doc_id):
            own = slice(first[n], first[n + 1])
            assert len(set(term[own].tolist())) == len(term[own])
            assert {word[t]: c for t, c in zip(term[own].tolist(), count[own].tolist())} == want[doc_id]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(audit, "SEGMENT_BYTES", 16)
    raw = b"alpha beta  gamma\nalpha " * 40 + b"x" * 100 + b"\v alpha"
    assert audit.word_counts(raw) == {w: raw.split().count(w) for w in set(raw.split())}
    assert audit.word_counts(b"") == {}


@pytest.mark.parametrize("numbers", [[], [0], [5, 5, 5], [3, 1 << 62, -(1 << 62), 0, 7], list(range(1000))])
def test_packed_numbers(numbers):
    assert audit.unpacked(audit.packed(np.array(numbers, np.int64)), len(numbers)).tolist() == numbers


def test_facts(documents, prose):
    some = texts(prose)
    got = {r.doc_id: r for r in audit.document_facts(documents([(i, t, "en", "s", None) for i, t in enumerate(some)])).collect()}
    for i, t in enumerate(some):
        t = t or ""
        assert (got[i].words, got[i].terms) == (len(t.encode().split()), len(set(t.encode().split())))
        assert (got[i].capitals, got[i].chars, bytes(got[i].print)) == (len(re.findall("[A-Z]", t)), len(t), hashlib.sha256(t.encode()).digest())


def test_one_count_per_combination(documents, labels, prose):
    """The audit aggregates before it expands orders: the plan holds no join with all orders."""
    table = documents([(i, t, "en", "s", None) for i, t in enumerate(texts(prose))])
    plan = audit.audit(table, labels([]))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert audit.failures(table).where(F.col("mask") < 0).count() == 0
