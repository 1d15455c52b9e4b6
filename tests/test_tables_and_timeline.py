import random

import pytest
from pyspark.sql import functions as F

from kerbside import sinks
from kerbside.operators import curate, demand, tables, timeline


def events(n, seed, keys=4, span=40_000):
    """A third of the rows belong to one key; times collide."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}", rng.randrange(span), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, seq long").select("k", F.timestamp_seconds("t").alias("ts"), "t", "seq")


@pytest.mark.parametrize("bucket", ["10 minutes", "1 hour", "1 day"])
def test_previous_row(spark, bucket):
    rows = events(800, 1)
    got = {r["seq"]: r["prev_seq"] for r in timeline.previous_row(
        frame(spark, rows), ["k"], ["ts", "seq"], ["seq"], bucket).collect()}
    want, last = {}, {}
    for k, t, s in sorted(rows, key=lambda r: (r[1], r[2])):
        want[s] = last.get(k)
        last[k] = s
    assert got == want


@pytest.mark.parametrize(("strict", "age"), [(False, None), (True, None), (False, 1800)])
def test_as_of_join(spark, strict, age):
    left, right = events(300, 2, span=20_000), events(400, 3, keys=5, span=20_000)
    out = timeline.as_of_join(
        frame(spark, left), frame(spark, right).select("k", F.col("ts").alias("rts"), F.col("seq").alias("rseq")), ["k"], "ts", "rts",
        ["rseq"], right_order=["rseq"], strict=strict, max_age=None if age is None else f"{age} SECONDS")
    got = {r["seq"]: r["asof_rseq"] for r in out.collect()}
    want = {}
    for k, t, s in left:
        fit = [(rt, rs) for rk, rt, rs in right if rk == k and (rt < t if strict else rt <= t) and (age is None or rt > t - age)]
        want[s] = max(fit)[1] if fit else None
    assert got == want


def crowded(n, seed):
    """Rows of few keys, a null one too, within one hour; half of them within one second, with ties."""
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", "b", None]), r.choice([r.randrange(3_600_000_000), 1_800_000_000 + r.randrange(40)]), i)
            for i in range(n)]


def micro_frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, seq long").select("k", F.timestamp_micros("t").alias("ts"), "t", "seq")


def test_crowded_hours_are_cut(spark, monkeypatch):
    """Pieces of about PIECE_ROWS rows, also where an hour or a second holds more; the same results."""
    monkeypatch.setattr(timeline, "PIECE_ROWS", 20)
    rows, right = crowded(600, 4), crowded(300, 5)
    df = micro_frame(spark, rows)
    cuts = timeline.count_cuts(df, ["k"], "ts")
    sizes = [r["count"] for r in timeline._deal(df.select(F.struct("k").alias("_key"), F.col("ts").alias("_at")), cuts)
             .groupBy("_key", "_piece").count().collect()]
    assert len(sizes) > 20 and sum(sizes) == 600 and max(sizes) < 60
    got = {r["seq"]: r["prev_seq"] for r in timeline.previous_row(df, ["k"], ["ts", "seq"], ["seq"]).collect()}
    want, last = {}, {}
    for k, t, s in sorted(rows, key=lambda r: (r[1], r[2])):
        want[s] = last.get(k)
        last[k] = s
    assert got == want
    out = timeline.as_of_join(df, micro_frame(spark, right).select("k", F.col("ts").alias("rts"), F.col("seq").alias("rseq")),
                              ["k"], "ts", "rts", ["rseq"], right_order=["rseq"])
    fit = lambda k, t: [(rt, rs) for rk, rt, rs in right if rk == k and rt <= t]
    assert {r["seq"]: r["asof_rseq"] for r in out.collect()} == {s: max(fit(k, t))[1] if fit(k, t) else None for k, t, s in rows}


def scans(df):
    """Scans of files in the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_one_scan_per_input(spark, tmp_path):
    for name, seed in (("l", 6), ("r", 7)):
        micro_frame(spark, crowded(500, seed)).write.parquet(str(tmp_path / name))
    left = spark.read.parquet(str(tmp_path / "l"))
    right = spark.read.parquet(str(tmp_path / "r")).select("k", F.col("ts").alias("rts"), F.col("seq").alias("rseq"))
    assert scans(timeline.previous_row(left, ["k"], ["ts", "seq"], ["seq"])) == 1
    assert scans(timeline.as_of_join(left, right, ["k"], "ts", "rts", ["rseq"], right_order=["rseq"])) == 2


def test_as_of_join_on_shared_sequence(spark):
    left = frame(spark, [("a", 10, 2), ("a", 10, 4)])
    right = frame(spark, [("a", 10, 1), ("a", 10, 3), ("a", 10, 5)]).select("k", F.col("ts").alias("rts"), F.col("seq").alias("rseq"))
    out = timeline.as_of_join(left, right, ["k"], "ts", "rts", ["rseq"], right_order=["rseq"], left_order=["seq"])
    assert {r["seq"]: r["asof_rseq"] for r in out.collect()} == {2: 1, 4: 3}


def test_upsert_last_write_wins_and_ties_go_to_the_update(spark):
    t = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, ts int, v string")
    u = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "new")], "k string, ts int, v string")
    assert {r["k"]: r["v"] for r in tables.upsert(t, u, ["k"], ["ts"]).collect()} == {"a": "new", "b": "old", "c": "new"}


def test_upsert_table_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "z int, k string, ts int").write.partitionBy("z").parquet(path)
    before = {p.name for p in (tmp_path / "t" / "z=1").iterdir()}
    up = spark.createDataFrame([(2, "b", 2), (3, "c", 1)], "z int, k string, ts int")
    for _ in range(2):
        sinks.upsert_table(spark, path, up, ["z", "k"], ["ts"], ["z"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("z", "k", "ts").collect()) == [(1, "a", 1), (2, "b", 2), (3, "c", 1)]
    assert {p.name for p in (tmp_path / "t" / "z=1").iterdir()} == before
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, path, up, ["k"], ["ts"], ["z"])


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("a", 1)], "k string, ts int")
    for batch in (0, 0, 1):
        sinks.append_batch(one, path, batch)
    assert spark.read.parquet(path).count() == 2
    assert sinks.read_keyed(spark, path, ["k"], ["ts"]).count() == 1


@pytest.mark.parametrize("parts", [None, ["p"]])
def test_smaller_and_empty_replays_leave_nothing_behind(spark, tmp_path, parts):
    path = str(tmp_path / "log")
    rows = spark.range(30).withColumn("p", F.col("id") % 3)
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(path).where("batch_id = 1").collect())
    for batch in (0, 1):
        sinks.append_batch(rows, path, batch, parts)
    sinks.append_batch(rows.where("id < 4"), path, 1, parts)
    assert ids() == [0, 1, 2, 3]
    sinks.append_batch(rows.where("p = 0 and id < 9"), path, 1, parts)
    assert ids() == [0, 3, 6]
    sinks.append_batch(rows.where("false"), path, 1, parts)
    assert ids() == [] and spark.read.parquet(path).where("batch_id = 0").count() == 30


def grown(spark, path, batches=5):
    for batch in range(batches):
        sinks.append_batch(spark.range(6).select("id", F.lit(batch).alias("ts")).where(F.col("id") % 5 != batch), path, batch)
    return sorted(map(tuple, sinks.read_keyed(spark, path, ["id"], ["ts"]).collect()))


def test_folding_keeps_the_last_write_and_later_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    before = grown(spark, path)
    assert sinks.folded(spark, path) is None and sinks.sweep(spark, path) == 0
    for _ in range(2):
        sinks.fold_batches(spark, path, 3, ["id"], ["ts"])
        rows = sinks.read_table(spark, path)
        assert rows.where("batch_id <= 3").select("batch_id").distinct().count() == 1
        assert rows.where("batch_id = 4").count() == 5 and rows.count() == 11
        assert sorted(map(tuple, sinks.read_keyed(spark, path, ["id"], ["ts"]).collect())) == before
    assert sinks.batch_ids(spark, path) == [0, 1, 2, 3, 4]
    assert sinks.sweep(spark, path) == 4 and sinks.batch_ids(spark, path) == [4]
    assert sorted(map(tuple, sinks.read_keyed(spark, path, ["id"], ["ts"]).collect())) == before
    sinks.fold_batches(spark, path, 4, ["id"], ["ts"], alive=F.col("ts") >= 4)
    assert sinks.sweep(spark, path) == 2 and sinks.batch_ids(spark, path) == []  # the last batch and the fold before
    assert sinks.read_table(spark, path).where("ts < 4").isEmpty() and sinks.read_table(spark, path).count() == 5
    assert sinks._versions(spark, path) == [2]


def test_a_killed_fold_loses_nothing(spark, tmp_path, monkeypatch):
    """Killed after its rows are written or while it is published: readers see the table as it was."""
    path = str(tmp_path / "log")
    before = grown(spark, path)

    def killed(*_):
        raise KeyboardInterrupt

    for step in ("_publish", "uuid"):
        with monkeypatch.context() as m:
            m.setattr(sinks, step, killed if step == "_publish" else None)
            with pytest.raises((KeyboardInterrupt, AttributeError)):
                sinks.fold_batches(spark, path, 3, ["id"], ["ts"])
        assert sinks.folded(spark, path) is None and sinks.sweep(spark, path) == 0
        assert sorted(map(tuple, sinks.read_keyed(spark, path, ["id"], ["ts"]).collect())) == before
    sinks.fold_batches(spark, path, 3, ["id"], ["ts"])
    assert sinks.sweep(spark, path) == 5  # four batches, and the folder of the killed fold
    assert sorted(map(tuple, sinks.read_keyed(spark, path, ["id"], ["ts"]).collect())) == before


def test_a_reader_during_a_fold_sees_every_row(spark, tmp_path):
    path = str(tmp_path / "log")
    before = grown(spark, path)
    began = sinks.read_keyed(spark, path, ["id"], ["ts"])  # files are listed here
    sinks.fold_batches(spark, path, 3, ["id"], ["ts"])
    assert sorted(map(tuple, began.collect())) == before
    sinks.append_batch(spark.range(6, 9).select("id", F.lit(9).alias("ts")), path, 5)
    assert sinks.read_keyed(spark, path, ["id"], ["ts"]).count() == len(before) + 3


def test_days_go_as_folders(spark, tmp_path):
    """Old days go from batches and folds; other files aren't touched, a null day stays."""
    path = str(tmp_path / "log")
    for batch in range(4):
        rows = spark.range(5).select("id", F.lit(batch).alias("ts"), F.lit("a").alias("city"),
                                     F.when(F.col("id") < 4, F.concat(F.lit("2024-01-0"), F.col("id") + 1)).alias("day"))
        sinks.append_batch(rows, path, batch, ["city", "day"])
    sinks.fold_batches(spark, path, 1, ["id", "city", "day"], ["ts"], ["city", "day"])
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert sinks.drop_before(spark, path, "day", "2024-01-03") == 2 * 4 + 2
    left = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert left.items() < files.items()
    rows = sinks.read_table(spark, path)
    assert rows.count() == 3 * 3 and {r["id"] for r in rows.collect()} == {2, 3, 4}
    assert sinks.drop_before(spark, path, "day", "2024-01-03") == 0


def test_housekeeping_bounds_the_number_of_folders(spark, tmp_path):
    path, counts = str(tmp_path / "log"), []
    for batch in range(23):
        sinks.append_batch(spark.range(2).select((F.col("id") + batch % 3).alias("id"), F.lit(batch).alias("ts")), path, batch)
        sinks.keep_house(spark, path, batch, 4, ["id"], ["ts"])
        counts.append(len(sinks.batch_ids(spark, path)))
    assert max(counts) <= 2 * 4 + 1
    got = {r["id"]: r["ts"] for r in sinks.read_keyed(spark, path, ["id"], ["ts"]).collect()}
    assert got == {0: 21, 1: 22, 2: 22, 3: 20}


def test_upsert_keeps_the_rows_of_a_null_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "z long, k long, ts int"
    spark.createDataFrame([(None, 1, 1), (None, 2, 1), (3, 1, 1), (4, None, 1)], schema).write.partitionBy("z").parquet(path)
    up = spark.createDataFrame([(None, 2, 2), (4, None, 5), (None, None, 1)], schema)
    for _ in range(2):
        sinks.upsert_table(spark, path, up, ["z", "k"], ["ts"], ["z"])
    got = sorted(((r["z"], r["k"], r["ts"]) for r in spark.read.parquet(path).collect()), key=str)
    assert got == sorted([(None, 1, 1), (None, 2, 2), (None, None, 1), (3, 1, 1), (4, None, 5)], key=str)


def test_upsert_names_the_partitions_it_reads(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(40).select((F.col("id") % 8).alias("z"), F.col("id").alias("k"), F.lit(1).alias("ts")).write.partitionBy("z").parquet(path)
    up = spark.createDataFrame([(2, 10, 2)], "z long, k long, ts int")
    seen = []
    real = sinks.tables.upsert
    monkeypatch.setattr(sinks.tables, "upsert", lambda a, *r: seen.append(a._jdf.queryExecution().executedPlan().toString()) or real(a, *r))
    sinks.upsert_table(spark, path, up, ["z", "k"], ["ts"], ["z"])
    assert "PartitionFilters: [isnotnull(z" in seen[0] and "(z#" in seen[0] and "= 2)" in seen[0]


def test_pages_cover_everything_once(spark):
    df = spark.range(45)
    seen = [r["id"] for p in range(4) for r in tables.page(df, [F.col("id").desc()], p, 20)[0].collect()]
    assert sorted(seen) == list(range(45)) and seen[0] == 44
    assert tuple(tables.page(df, [F.col("id")], 0, 20)[1].first()) == (45, 3)


def test_owner_rows(spark):
    df = spark.createDataFrame([("d1", "c1"), ("d2", "c1"), ("d2", "d1")], "driver_id string, client_id string")
    assert tables.owner_rows(df, "d1", ["driver_id"], False).count() == 1
    assert tables.owner_rows(df, "d1", ["driver_id", "client_id"], False).count() == 2
    assert tables.owner_rows(df, "d1", ["driver_id"], True).count() == 3


def test_missing_flag_as_text_and_boolean(spark):
    text = spark.createDataFrame([("False",), ("True",), ("false",)], "MISSING_DATA string")
    flag = spark.createDataFrame([(False,), (True,)], "MISSING_DATA boolean")
    assert curate.without_missing(text).count() == 2 and curate.without_missing(flag).count() == 1


def test_densify_is_zones_times_hours(spark):
    d = spark.createDataFrame([("a", 0, 2), ("b", 7200, 5), ("a", 18000, 1)], "zone_id string, t long, demand long").select(
        "zone_id", F.timestamp_seconds("t").alias("time_window"), "demand")
    out = demand.densify(d)
    assert out.count() == 2 * 6 and out.agg(F.sum("demand")).first()[0] == 8


def test_dense_rank_over_distinct_counts(spark):
    c = spark.createDataFrame([(1, 9), (2, 9), (3, 4), (4, 1)], "zone_id int, request_count long")
    assert {r["zone_id"]: r["rank"] for r in demand.most_requested(c, "x").collect()} == {1: 1, 2: 1, 3: 2, 4: 3}


def test_peak_hour_prefers_the_earlier_hour(spark):
    z = spark.createDataFrame([(1, 9, 5), (1, 7, 5), (1, 8, 4)], "zone_id int, hour int, demand_count long")
    assert tuple(demand.peak_hour(z).first()) == (1, 7, 5)


@pytest.mark.parametrize("rows", [[1e9, 1e9 + 1, 1e9 + 2], [5.0], [1.0, None, 2.0, 2.0, 2.0, 9.0], [float(i * i % 101) for i in range(500)]])
def test_profile_keeps_its_digits(spark, rows):
    import numpy as np

    p = curate.profile(spark.createDataFrame([(v,) for v in rows], "v double").repartition(5), "v").first()
    known = np.array([v for v in rows if v is not None])
    assert p["count"] == len(known) and p["mean"] == pytest.approx(known.mean())
    assert (p["stddev"] is None) if len(known) == 1 else p["stddev"] == pytest.approx(known.std(ddof=1))
    assert [p["p25"], p["p50"], p["p75"]] == pytest.approx(list(np.percentile(known, [25, 50, 75])))


def test_profile_of_nothing(spark):
    p = curate.profile(spark.createDataFrame([(None,)], "v double"), "v").first()
    assert p["count"] == 0 and p["p50"] is None and p["mean"] is None


def test_profile_equals_summary(spark):
    df = spark.range(1001).select((F.col("id") % 37 * 0.25).alias("v"))
    p = curate.profile(df, "v").first()
    s = {r["summary"]: float(r["v"]) for r in df.summary("count", "mean", "stddev", "min", "max").collect()}
    assert p["count"] == s["count"] and p["mean"] == pytest.approx(s["mean"]) and p["stddev"] == pytest.approx(s["stddev"])
    exact = df.agg(F.percentile("v", 0.25), F.percentile("v", 0.5), F.percentile("v", 0.75)).first()
    assert (p["p25"], p["p50"], p["p75"]) == tuple(exact)
