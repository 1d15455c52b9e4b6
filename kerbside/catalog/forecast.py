"""Forecast features, split, baseline, model and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.catalog.base import query, rounded
from kerbside.catalog.demand import _GRID, _ZONED
from kerbside.operators import demand, forecast, trees
from kerbside.plans import bindings as B
from kerbside.session import cut_lineage, scratch_path
from kerbside.sources import files

# --- inputs ------------------------------------------------------------------------------------


def grid(spark, d):
    dense = demand.densify(demand.demand_timeseries(B.zoned(B.pings(spark, d)), "ts"))
    return dense.withColumn("zone_id", F.col("zone_id").cast("string"))


def zone_attributes(spark, d):
    zone = (F.col("s_suppkey") % 16 + 1).cast("string").alias("zone_id")
    odd = F.col("zone_id").cast("int") % 2 == 1
    return B.table(spark, d, "supplier").groupBy(zone).agg(
        (F.lit(1000) + F.count(F.lit(1)) * 100).cast("int").alias("zone_population_density")).withColumn(
        "zone_type", F.when(odd, "residential").otherwise("commercial"))


_ATTRS = """attrs AS (SELECT cast(s_suppkey%16+1 AS int) AS zone_id, cast(1000+count(*)*100 AS int) AS zone_population_density,
  CASE WHEN (s_suppkey%16+1)%2=1 THEN 'residential' ELSE 'commercial' END AS zone_type FROM supplier GROUP BY s_suppkey%16)"""


def weather_document(spark, d):
    """Daily documents with parallel hourly arrays (at most 24 entries each)."""
    e = B.table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("h"), "value")
    hourly = e.groupBy("h").agg(F.round(F.avg("value") / 2, 1).alias("t"), F.round(F.min("value") / 100, 3).alias("p"))
    day = hourly.groupBy(F.to_date("h").alias("day")).agg(F.array_sort(F.collect_list(F.struct(
        F.date_format("h", "yyyy-MM-dd'T'HH:mm").alias("time"), "t", "p"))).alias("a"))
    return day.select(F.struct(
        F.col("a.time").alias("time"), F.col("a.t").alias("temperature_2m"), F.col("a.p").alias("precipitation")).alias("hourly"))


_WEATHER = """weather AS (SELECT h AS time_window, CASE WHEN t < 10 THEN 'cold' WHEN t < 25 THEN 'mild' ELSE 'hot' END AS temperature_bucket,
  CASE WHEN p > 0.1 THEN 1 ELSE 0 END AS is_raining FROM (SELECT date_trunc('hour', ts) AS h, round(avg(value)/2, 1) AS t,
  round(min(value)/100, 3) AS p FROM events GROUP BY 1))"""


@query("SELECT time_window, temperature_bucket, is_raining FROM weather", _WEATHER)
def weather_rows(spark, d):
    """Parallel arrays to one row per hour."""
    return files.weather_from_arrays(weather_document(spark, d))


# --- features ----------------------------------------------------------------------------------

_FEATURES = """features AS (SELECT * FROM (
  SELECT g.time_window, cast(g.zone_id AS varchar) AS zone_id, cast(hour(g.time_window) AS int) AS hour_of_day,
    cast(dayofweek(g.time_window)+1 AS int) AS day_of_week, CASE WHEN dayofweek(g.time_window) IN (0,6) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN dayofweek(g.time_window)=5 THEN 1 ELSE 0 END AS is_friday, a.zone_population_density, a.zone_type, w.is_raining,
    w.temperature_bucket, lag(demand, 24) OVER z AS demand_lag_1d, lag(demand, 168) OVER z AS demand_lag_7d,
    avg(demand) OVER (z ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS rolling_7d_mean, demand
  FROM grid g LEFT JOIN attrs a USING (zone_id) LEFT JOIN weather w USING (time_window) WINDOW z AS (PARTITION BY zone_id ORDER BY time_window))
  WHERE demand_lag_7d IS NOT NULL AND zone_population_density IS NOT NULL AND is_raining IS NOT NULL)"""
_CTES = (B.pings_sql(), _ZONED, _GRID, _ATTRS, _WEATHER)


def features(spark, d):
    weather = files.weather_from_arrays(weather_document(spark, d))
    return forecast.build_features(grid(spark, d), zone_attributes(spark, d), weather)


@query("SELECT * REPLACE (round(rolling_7d_mean, 6) AS rolling_7d_mean) FROM features", *_CTES, _FEATURES)
def model_features(spark, d):
    return rounded(features(spark, d), 6, "rolling_7d_mean")


@query("SELECT cast(g.zone_id AS varchar) AS zone_id, time_window, demand, zone_population_density, zone_type FROM grid g LEFT JOIN attrs USING (zone_id)",
       *_CTES)
def zone_attributes_join(spark, d):
    return forecast.zone_features(grid(spark, d), zone_attributes(spark, d)).select(
        "zone_id", "time_window", "demand", "zone_population_density", "zone_type")


@query("SELECT cast(zone_id AS varchar) AS zone_id, time_window, demand, temperature_bucket, is_raining FROM grid LEFT JOIN weather USING (time_window)",
       *_CTES)
def weather_join(spark, d):
    w = files.weather_from_arrays(weather_document(spark, d))
    return forecast.weather_features(grid(spark, d), w).select("zone_id", "time_window", "demand", "temperature_bucket", "is_raining")


@query("""SELECT cast(zone_id AS varchar) AS zone_id, time_window, lag(demand,24) OVER z AS demand_lag_1d, lag(demand,168) OVER z AS demand_lag_7d,
  round(avg(demand) OVER (z ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 6) AS rolling_7d_mean FROM grid
  WINDOW z AS (PARTITION BY zone_id ORDER BY time_window)""", *_CTES)
def lag_features(spark, d):
    return rounded(forecast.lag_features(grid(spark, d)), 6, "rolling_7d_mean").select(
        "zone_id", "time_window", "demand_lag_1d", "demand_lag_7d", "rolling_7d_mean")


_CUT = """cut AS (SELECT to_timestamp(cast(epoch(min(time_window)) AS bigint) + cast(floor((epoch(max(time_window))-epoch(min(time_window)))*0.8e0) AS bigint))
  AT TIME ZONE 'UTC' AS cut FROM features)"""


@query("""SELECT CASE WHEN time_window < cut THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(time_window) AS first, max(time_window) AS last,
  cast(sum(demand) AS bigint) AS demand FROM features, cut GROUP BY 1""", *_CTES, _FEATURES, _CUT)
def temporal_split(spark, d):
    train, test = forecast.temporal_split(cut_lineage(features(spark, d)))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("time_window").alias("first"),
                                    F.max("time_window").alias("last"), F.sum("demand").alias("demand"))


@query("""SELECT round(sqrt(avg(pow(demand-demand_lag_7d,2))), 6) AS rmse, round(avg(abs(demand-demand_lag_7d)), 6) AS mae, count(*) AS rows
  FROM features, cut WHERE time_window >= cut""", *_CTES, _FEATURES, _CUT)
def baseline_errors(spark, d):
    _, test = forecast.temporal_split(cut_lineage(features(spark, d)))
    return rounded(forecast.baseline_metrics(test), 6, "rmse", "mae")


# --- model -------------------------------------------------------------------------------------


def trained(spark, d):
    """(model, test rows): trees read the features many times, so they are written once."""
    train, test = forecast.temporal_split(cut_lineage(features(spark, d)))
    return forecast.train(train), test


@query()
def model_against_baseline(spark, d):
    """Boosted trees on the past, errors on the future, next to the seven-day baseline."""
    model, test = trained(spark, d)
    return forecast.compare_with_baseline(model.transform(test))


@query()
def model_importances(spark, d):
    model, _ = trained(spark, d)
    return forecast.feature_importances(spark, model)


@query()
def model_scores(spark, d):
    """Model written, read back and applied to the future rows."""
    model, test = trained(spark, d)
    path = scratch_path(spark, "model")
    forecast.save_model(model, path)
    return forecast.score_demand(test, forecast.load_model(path))


@query("""SELECT zone_id, time_window, rows, true AS scored, true AS agrees FROM features, cut, (VALUES ('as they are'), ('unseen')) t(rows)
  WHERE time_window >= cut""", *_CTES, _FEATURES, _CUT)
def model_as_expression(spark, d):
    """Future rows scored by the trees as one expression and by the pipeline, also with categories the model never saw."""
    model, test = trained(spark, d)
    unseen = test.withColumns({"_zone": F.lit("elsewhere"), "zone_type": F.lit(None).cast("string"), "temperature_bucket": F.lit("unheard of")})
    both = test.withColumns({"_zone": F.col("zone_id"), "rows": F.lit("as they are")}).unionByName(unseen.withColumn("rows", F.lit("unseen")))
    inputs = both.withColumns({"_id": F.col("zone_id"), "zone_id": F.col("_zone")})
    scored = model.transform(inputs.withColumn("compiled", F.expr(trees.expression(model))))
    return scored.select(F.col("_id").alias("zone_id"), "time_window", "rows", F.col("compiled").isNotNull().alias("scored"),
                         (F.abs(F.col("compiled") - F.col("prediction")) < 1e-9).alias("agrees"))


@query("""SELECT cast(zone_id AS varchar) AS zone_id, time_window, CASE WHEN hour(time_window) BETWEEN 7 AND 9 OR hour(time_window) BETWEEN 17 AND 19
  THEN 21 + zone_id%3 WHEN hour(time_window) <= 5 THEN 2 ELSE 9 END AS predicted_demand, 'medium' AS confidence,
  'heuristic_rule_v1' AS model_version FROM grid""", *_CTES)
def rule_scores(spark, d):
    return forecast.score_demand(grid(spark, d), None)


@query("""SELECT zone_id, date_trunc('hour', ts) AS window_start, count(*) AS n, cast(CASE WHEN hour(date_trunc('hour', ts)) BETWEEN 7 AND 9
  OR hour(date_trunc('hour', ts)) BETWEEN 17 AND 19 THEN 21 + zone_id%3 WHEN hour(date_trunc('hour', ts)) <= 5 THEN 2 ELSE 9 END AS double) AS forecast_demand
  FROM zoned GROUP BY 1, 2""", B.pings_sql(), _ZONED)
def filled_forecast(spark, d):
    """Demand windows with the forecast of their zone and hour."""
    w = demand.demand_timeseries(B.zoned(B.pings(spark, d)), "ts").select(
        "zone_id", F.col("time_window").alias("window_start"), F.col("demand").alias("n"))
    return forecast.fill_forecast(w, forecast.score_demand(grid(spark, d), None))


@query("""SELECT count(*) AS rows, count(*) AS scored, 0 AS changed_by_reload, 12 AS features, true AS importances_add_up,
  count(DISTINCT time_window) AS hours FROM features, cut WHERE time_window >= cut""", *_CTES, _FEATURES, _CUT)
def model_facts(spark, d):
    """What must hold of any trained model: every future row scored, the same after a reload, importances that sum to 1."""
    model, test = trained(spark, d)
    path = scratch_path(spark, "model_facts")
    forecast.save_model(model, path)
    again = forecast.load_model(path).transform(test).select("zone_id", "time_window", F.col("prediction").alias("again"))
    both = model.transform(test).select("zone_id", "time_window", "prediction").join(again, ["zone_id", "time_window"])
    weights = forecast.feature_importances(spark, model, top=12)
    facts = weights.agg(F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sum"))
    told = facts.select(F.struct("features", "sum")).scalar()
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("scored"),
                    F.count_if(~F.col("prediction").eqNullSafe(F.col("again"))).cast("int").alias("changed_by_reload"),
                    F.count_distinct("time_window").alias("hours")).select(
        "*", told["features"].alias("features"), told["sum"].alias("importances_add_up"))
