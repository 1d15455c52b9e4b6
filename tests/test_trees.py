"""Fitted trees as SQL text: the same scores as the pipeline, in Spark, on a stream and in another engine."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbside.operators import forecast, trees

SCHEMA = ("id int, zone_id string, hour_of_day int, day_of_week int, is_weekend int, is_friday int, zone_population_density int, "
          "zone_type string, is_raining int, temperature_bucket string, demand_lag_1d long, demand_lag_7d long, rolling_7d_mean double, demand long")
ODD = ["a", "b's", "c\\n", 'd"', "é", ""]


def rows(n, seed, unseen=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        zone, hour = r.choice(ODD), r.randrange(24)
        y = 3 * ODD.index(zone) + (5 if 7 <= hour <= 9 else 0) + r.randrange(3)
        if unseen and r.random() < 0.5:
            zone = r.choice([None, "new"])
        number = (lambda x: None if unseen and r.random() < 0.2 else x)
        out.append((i, zone, number(hour), 1 + i % 7, i % 2, 0, 1000 + 100 * (i % 5), r.choice(["home", "work"] + [None] * unseen), i % 3 % 2,
                    r.choice(["cold", "mild"]), number(y), number(y + r.randrange(2)), number(y / 3), y))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return forecast.train(spark.createDataFrame(rows(600, 1), SCHEMA), max_depth=4, max_iter=6)


@pytest.fixture
def strange(spark):
    return spark.createDataFrame(rows(400, 2, unseen=True), SCHEMA)


def test_equals_the_pipeline_on_missing_and_unknown_values(model, strange):
    got = model.transform(strange.withColumn("own", F.expr(trees.expression(model)))).select("own", "prediction").collect()
    assert len({round(r["own"], 6) for r in got}) > 10
    assert max(abs(r["own"] - r["prediction"]) for r in got) < 1e-9


def test_same_text_in_another_engine(model, strange):
    expected = {r["id"]: r["prediction"] for r in model.transform(strange).select("id", "prediction").collect()}
    scored = strange.toArrow()  # noqa: F841, read by name below
    text = trees.expression(model, portable=True)
    got = dict(duckdb.sql(f"SELECT id, {text} FROM scored").fetchall())
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_scores_a_stream(spark, model, strange, tmp_path):
    ready = strange.withColumn("time_window", F.timestamp_seconds(F.col("id") * 3600))
    ready.write.parquet(str(tmp_path / "in"))
    stream = forecast.score_demand(spark.readStream.schema(ready.schema).parquet(str(tmp_path / "in")), trees.expression(model))
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    batch = forecast.score_demand(ready, model)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str) == sorted(batch.collect(), key=str)


def test_names_that_need_quotes_are_refused():
    with pytest.raises(ValueError):
        trees._name("a b")
