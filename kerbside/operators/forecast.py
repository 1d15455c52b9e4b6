"""Hourly demand forecast: features, temporal split, gradient-boosted model, scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.functions import scalars
from kerbside.session import broadcast_if_small, cut_lineage

# The model's input columns, in order.
FEATURES = [
    "zone_id_indexed", "hour_of_day", "day_of_week", "is_weekend", "is_friday",
    "zone_population_density", "zone_type_indexed", "is_raining", "temperature_bucket_indexed",
    "demand_lag_1d", "demand_lag_7d", "rolling_7d_mean",
]
INDEXED = ["zone_id", "zone_type", "temperature_bucket"]


# --- features ----------------------------------------------------------------------------------


def temporal_features(df: DataFrame, ts: str = "time_window") -> DataFrame:
    return df.withColumns({
        "hour_of_day": F.hour(ts), "day_of_week": F.dayofweek(ts),
        "is_weekend": scalars.is_weekend(F.col(ts)), "is_friday": scalars.is_friday(F.col(ts)),
    })


def zone_features(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Left join of zone_population_density and zone_type; zones is a small dimension."""
    z = zones.select("zone_id", "zone_population_density", "zone_type")
    return df.join(broadcast_if_small(z), "zone_id", "left")


def weather_features(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on the hour; one weather row per hour, computed once for its count and the join."""
    w = cut_lineage(weather.select("time_window", "temperature_bucket", "is_raining"))
    return df.join(broadcast_if_small(w), "time_window", "left")


def hourly_weather_stand_in(df: DataFrame) -> DataFrame:
    """Without a weather table: bucket by hour of day, no rain."""
    return df.withColumns({
        "temperature_bucket": scalars.hour_temperature_bucket(F.hour("time_window")), "is_raining": F.lit(0)})


def lag_features(df: DataFrame, rows_per_day: int = 24, value: str = "demand") -> DataFrame:
    """Lags of one and seven days and the mean of the seven days before, on the dense grid.

    The window is per zone; a zone has one row per step of the calendar, however many trips it saw.
    """
    w = Window.partitionBy("zone_id").orderBy("time_window")
    week = 7 * rows_per_day
    return df.withColumns({
        "demand_lag_1d": F.lag(value, rows_per_day).over(w),
        "demand_lag_7d": F.lag(value, week).over(w),
        "rolling_7d_mean": F.avg(value).over(w.rowsBetween(-week, -1)),
    })


def build_features(grid: DataFrame, zones: DataFrame, weather: DataFrame | None,
                   rows_per_day: int = 24) -> DataFrame:
    """Dense grid (zone_id, time_window, demand) to complete model rows.

    Rows without full history, or without zone or weather attributes, are dropped.
    """
    df = lag_features(grid, rows_per_day)
    df = temporal_features(zone_features(df, zones))
    df = weather_features(df, weather) if weather is not None else hourly_weather_stand_in(df)
    needed = [c.removesuffix("_indexed") for c in FEATURES] + ["demand"]
    return df.na.drop(subset=needed).select("time_window", *needed)


def temporal_split(df: DataFrame, ratio: float = 0.8, ts: str = "time_window") -> tuple[DataFrame, DataFrame]:
    """(past, future) cut at first + ratio x range in whole seconds; the bounds stay in the plan."""
    b = df.agg(F.unix_seconds(F.min(ts)).alias("lo"), F.unix_seconds(F.max(ts)).alias("hi"))
    cut = b.select(F.timestamp_seconds(
        F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.lit(ratio))).alias("cut"))
    return df.where(F.col(ts) < cut.scalar()), df.where(F.col(ts) >= cut.scalar())


# --- model -------------------------------------------------------------------------------------


def build_pipeline(num_zones: int, max_depth: int = 5, max_iter: int = 30, seed: int = 42) -> Pipeline:
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_indexed", handleInvalid="keep") for c in INDEXED]
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    trees = GBTRegressor(featuresCol="features", labelCol="demand", maxDepth=max_depth, maxIter=max_iter,
                         maxBins=max(num_zones + 1, 100), seed=seed)
    return Pipeline(stages=[*indexers, assembler, trees])


def train(features: DataFrame, max_depth: int = 5, max_iter: int = 30, grid: dict | None = None,
          folds: int = 3) -> PipelineModel:
    """Fit the pipeline; ``grid`` (e.g. {"maxDepth": [4, 6]}) adds a cross-validated search."""
    num_zones = features.agg(F.count_distinct("zone_id").alias("n")).first()["n"]
    pipeline = build_pipeline(num_zones, max_depth, max_iter)
    if not grid:
        return pipeline.fit(features)
    trees = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(trees.getParam(name), values)
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), numFolds=folds, seed=42,
                            evaluator=RegressionEvaluator(labelCol="demand", metricName="rmse"))
    return search.fit(features).bestModel


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- evaluation --------------------------------------------------------------------------------


def error_metrics(df: DataFrame, label: str = "demand", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and row count in one pass, as a one-row frame."""
    gap = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
                  F.count(F.lit(1)).alias("rows"))


def baseline_metrics(test: DataFrame) -> DataFrame:
    """Errors of the naive forecast: same hour seven days ago."""
    return error_metrics(test.withColumn("prediction", F.col("demand_lag_7d")))


def compare_with_baseline(predictions: DataFrame) -> DataFrame:
    """One row: model and baseline errors and the improvement in percent."""
    model_gap = F.col("demand") - F.col("prediction")
    base_gap = F.col("demand") - F.col("demand_lag_7d")
    out = predictions.agg(
        F.sqrt(F.avg(model_gap * model_gap)).alias("model_rmse"), F.avg(F.abs(model_gap)).alias("model_mae"),
        F.sqrt(F.avg(base_gap * base_gap)).alias("baseline_rmse"))
    base = F.col("baseline_rmse")
    return out.withColumn("improvement_pct", F.when(base > 0, (base - F.col("model_rmse")) / base * 100))


def feature_importances(spark: SparkSession, model: PipelineModel, top: int = 5) -> DataFrame:
    """Ranked importances of the fitted trees; one row per model input, at most twelve."""
    trees = next(s for s in model.stages if isinstance(s, GBTRegressionModel))
    rows = [(name, float(w)) for name, w in zip(FEATURES, trees.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature").limit(top)


# --- scoring -----------------------------------------------------------------------------------


def scoring_rows(slots: DataFrame) -> DataFrame:
    """(zone_id, time_window) to model rows with the stand-in values of a request without history."""
    return temporal_features(slots).withColumns({
        "zone_id": F.col("zone_id").cast("string"), "zone_population_density": F.lit(1000),
        "zone_type": F.lit("commercial"), "is_raining": F.lit(0), "temperature_bucket": F.lit("mild"),
        "demand_lag_1d": F.lit(0.0), "demand_lag_7d": F.lit(0.0), "rolling_7d_mean": F.lit(0.0),
    })


def score_demand(rows: DataFrame, model: PipelineModel | str | None) -> DataFrame:
    """Demand per zone and time: model output floored at 0 and truncated, or the rule without a model.

    With a model, ``rows`` carry the model inputs (build_features or scoring_rows); without one,
    zone_id and time_window are enough. The model may be the text that ``trees.expression`` made of it.
    """
    if model is None:
        return rows.select(
            "zone_id", "time_window",
            scalars.heuristic_demand(F.col("zone_id").cast("int"), F.hour("time_window")).alias("predicted_demand"),
            F.lit("medium").alias("confidence"), F.lit("heuristic_rule_v1").alias("model_version"))
    scored = rows.withColumn("prediction", F.expr(model)) if isinstance(model, str) else model.transform(rows)
    return scored.select(
        "zone_id", "time_window",
        F.greatest(F.lit(0.0), F.col("prediction")).cast("int").alias("predicted_demand"),
        F.lit("high").alias("confidence"), F.lit("spark_gbt_v1").alias("model_version"))


def fill_forecast(demand_zones: DataFrame, scores: DataFrame) -> DataFrame:
    """Demand windows with the forecast of their zone and hour."""
    s = scores.select(F.col("zone_id").cast("string").alias("_zone"), F.col("time_window").alias("_hour"),
                      F.col("predicted_demand").cast("double").alias("forecast_demand"))
    hit = (F.col("zone_id").cast("string") == F.col("_zone")) & (F.date_trunc("hour", "window_start") == F.col("_hour"))
    return demand_zones.drop("forecast_demand").join(s, hit, "left").drop("_zone", "_hour")
