from pyspark.sql import functions as F

from kerbside.operators import forecast
from kerbside.plans import bindings as B
from kerbside.plans import jobs


def test_curation_to_kpis(spark, sf_dir, tmp_path):
    at = lambda n: str(tmp_path / n)
    B.raw_trips(spark, sf_dir).write.option("header", True).option("escape", '"').csv(at("csv"))
    B.yellow_raw(spark, sf_dir).write.parquet(at("yellow"))
    B.zoned(B.pings(spark, sf_dir)).write.parquet(at("positions"))
    jobs.curate_trips_job(spark, at("csv"), at("curated"))
    curated = spark.read.parquet(at("curated"))
    assert curated.count() == curated.select("TRIP_ID").distinct().count() > 3000

    jobs.yellow_demand_job(spark, at("yellow"), at("zone_hour"))
    n = B.yellow_raw(spark, sf_dir).where("PULocationID IS NOT NULL").count()
    assert spark.read.parquet(at("zone_hour")).agg(F.sum("demand_count")).first()[0] == n
    jobs.yellow_hourly_job(spark, at("yellow"), at("hourly"), "1900-01-01")
    assert spark.read.parquet(at("hourly")).agg(F.sum("demand")).first()[0] == n

    jobs.remap_job(spark, at("csv"), at("remapped"))
    assert spark.read.parquet(at("remapped")).where("CITY_POLYLINE = '[]'").count() == 0

    jobs.zone_kpi_job(spark, at("curated"), at("yellow"), at("positions"), at("kpi"))
    kpi = spark.read.parquet(at("kpi"))
    assert kpi.agg(F.sum("total_trips")).first()[0] == curated.count()
    assert kpi.where("peak_demand_hour NOT BETWEEN 0 AND 23").count() == 0

    jobs.city_kpi_job(spark, at("yellow"), at("curated"), at("city"))
    length = spark.read.parquet(at("city/avg_trip_length"))
    assert {r[0] for r in length.select("city").distinct().collect()} == {"NYC", "Porto"}
    ranks = spark.read.parquet(at("city/most_requested")).where("city = 'NYC'").orderBy("rank").collect()
    assert ranks[0]["rank"] == 1 and ranks[0]["request_count"] == max(r["request_count"] for r in ranks)
    counts = spark.read.parquet(at("zone_hour")).groupBy("zone_id").agg(F.max("demand_count").alias("m"))
    peaks = spark.read.parquet(at("city/peak_hours")).where("city = 'NYC'")
    assert peaks.count() == counts.count()


def test_forecast_beats_or_reports(spark, tmp_path):
    """Demand that depends on the hour only: the trees learn it, and the model reads back the same."""
    hours = 24 * 21
    rows = spark.range(hours * 3).select(
        (F.col("id") % 3 + 1).alias("zone"), F.floor(F.col("id") / 3).alias("h")).withColumn(
        "n", (F.lit(3) + (F.col("h") % 24) * F.col("zone") / 4 + F.abs(F.hash("h", "zone")) % 3).cast("int"))
    trips = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        F.col("zone").cast("string").alias("zone_id"), (F.lit(1704067200) + F.col("h") * 3600 + F.col("i")).alias("TIMESTAMP"))
    trips.write.parquet(str(tmp_path / "curated"))
    zones = spark.createDataFrame([(str(z), 1000 + z, "commercial") for z in (1, 2, 3)],
                                  "zone_id string, zone_population_density int, zone_type string")
    model, errors = jobs.forecast_job(spark, str(tmp_path / "curated"), zones, None, str(tmp_path / "model"))
    e = errors.first()
    assert e["model_rmse"] < e["baseline_rmse"] and e["improvement_pct"] > 0
    top = forecast.feature_importances(spark, model).collect()
    assert len(top) == 5 and top[0]["importance"] >= top[4]["importance"]
    slots = spark.createDataFrame([(1, 8), (99, 3)], "zone_id int, h int").select(
        "zone_id", F.expr("TIMESTAMP'2024-02-01' + make_dt_interval(0, h)").alias("time_window"))
    again = forecast.load_model(str(tmp_path / "model"))
    score = lambda m: sorted(map(tuple, forecast.score_demand(forecast.scoring_rows(slots), m).collect()))
    assert score(model) == score(again)
    assert all(r[2] >= 0 and r[3] == "high" for r in score(again))
    assert {r[4] for r in forecast.score_demand(slots, None).collect()} == {"heuristic_rule_v1"}
