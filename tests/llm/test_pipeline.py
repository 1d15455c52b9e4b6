import importlib
import re
import sys
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from kerbside.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of documents and after every stage."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def words(text):
    return (text or "").encode().lower().split()


def test_decisions_take_effect(spark, stages):
    docs, good, distinct, cut, mixed, packed = (s.toPandas() for s in stages)
    marks = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = docs.doc_id.isin(good.doc_id)
    known = docs.doc_id.isin(marks.index)
    right = kept[known] == (docs.doc_id[known].map(marks) == 1)
    assert right.mean() > 0.95 and len(good) < len(docs)

    sets = {i: frozenset(zip(*[words(t)[k:] for k in range(5)])) or frozenset([tuple(words(t))]) for i, t in zip(good.doc_id, good.text)}
    ids = sorted(distinct.doc_id)
    assert len(ids) == len(set(ids)) < len(good)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])

    runs = Counter()
    for t in cut.text:
        w = words(t)
        runs.update({tuple(w[i:i + 50]) for i in range(len(w) - 49)})
    assert all(n == 1 for n in runs.values())

    size = defaultdict(int)
    for i, t in zip(cut.doc_id, cut.text):
        size[i] += len(words(t))
    taken = defaultdict(int)
    for i, t in zip(mixed.doc_id, mixed.text):
        taken[i] += len(words(t))
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= 20

    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert set(packed.doc_id) == set(mixed.doc_id)


def test_registered_without_the_subpackage(monkeypatch):
    """Without these folders the other queries still register."""
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    hidden = [m for m in sys.modules if m.startswith("kerbside.llm") or m == "corpus_pipeline"]
    for m in hidden:
        monkeypatch.delitem(sys.modules, m)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("kerbside.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delattr("kerbside.llm", raising=False)
    bare = importlib.reload(entry)
    assert not any(re.match(r"op\d+_|pipeline$", n) for n in bare.queries()) and "match_nearest" in bare.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_run_on_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SF).toPandas()
    for name_ in ("documents", "labels"):
        duckdb.sql(f"create or replace view {name_} as select * from '{SF}/{name_}.parquet'")
    twin = duckdb.sql(queries.ORACLES[name]).df()[list(got.columns)]
    by = list(got.columns)
    assert got.sort_values(by).values.tolist() == twin.sort_values(by).values.tolist()
