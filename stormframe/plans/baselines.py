"""Fit the baseline models, store their predictions, and compare them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.config import BASELINE_FEATURES, TARGET, SeriesOrder
from stormframe.operators.blocks import plan_blocks
from stormframe.operators.metrics import model_comparison
from stormframe.operators.ordered import persistence_forecast
from stormframe.operators.regression import baseline_models, fit_models, predict
from stormframe.operators.scaling import Scaler
from stormframe.sources.tables import read_split, write_metrics, write_predictions
from stormframe.sources.versions import Versions, latest, read_parts, read_whole

PREDICTION_COLUMNS = ("model", "y_true", "y_pred")


def run_baselines(
    spark: SparkSession,
    tabular: str,
    folder: str,
    models: Mapping[str, Pipeline] | None = None,
    features: Sequence[str] = BASELINE_FEATURES,
    target: str = TARGET,
    keys: Sequence[str] = ("datetime", "event_id"),
) -> dict[str, dict[str, float]]:
    """Fit on train, store the models, predict test with what was stored, and store the predictions.

    ``keys`` tell rows apart; rows are dealt out by them, so that a rerun fits the same forest. The
    validation split is not used. Returns the metrics per model.
    """
    train = read_split(spark, tabular, "train", features, target, keys)
    test = read_split(spark, tabular, "test", features, target, keys)
    fitted = fit_models(models or baseline_models(features, target), train, keys)
    for name, model in fitted.items():
        Versions(spark, f"{folder}/models/{name}").replace(model.save)
    kept = {name: load_model(spark, folder, name) for name in fitted}
    write_predictions(predict(kept, test, target, keys), f"{folder}/predictions")
    stored = read_parts(spark, f"{folder}/predictions")
    rows = model_comparison(stored.where(F.col("model").isin(list(fitted)))).collect()
    return {r["model"]: {m: r[m] for m in ("rmse", "mae", "r2")} for r in rows}


def load_model(spark: SparkSession, folder: str, name: str) -> PipelineModel:
    """A model that ``run_baselines`` has stored."""
    return PipelineModel.load(latest(spark, f"{folder}/models/{name}"))


def persistence_predictions(
    table: DataFrame,
    order: SeriesOrder = SeriesOrder(),
    target: str = TARGET,
    block_rows: int | None = None,
) -> DataFrame:
    """The naive forecast in the shape of model predictions."""
    plan = plan_blocks(table, order, block_rows)
    forecast = persistence_forecast(plan.assign(table), plan, target)
    return forecast.select(F.lit("persistence").alias("model"), *order.keys, "y_true", "y_pred")


def evaluate(
    predictions: DataFrame,
    test: DataFrame | None = None,
    order: SeriesOrder = SeriesOrder(),
    target: str = TARGET,
    scaler: Scaler | None = None,
) -> DataFrame:
    """Metrics per model, with the persistence forecast of ``test`` added.

    Metrics are in the units of the predictions; with ``scaler`` they are in physical units.
    """
    predictions = predictions.select(*PREDICTION_COLUMNS)
    if test is not None:
        naive = persistence_predictions(test, order, target).select(*PREDICTION_COLUMNS)
        predictions = predictions.where(F.col("model") != "persistence").unionByName(naive)
    if scaler is not None:
        predictions = scaler.inverse(predictions, {"y_true": target, "y_pred": target})
    return model_comparison(predictions)


def run_evaluation(
    spark: SparkSession,
    tabular: str,
    folder: str,
    order: SeriesOrder = SeriesOrder(),
    target: str = TARGET,
    scaler: Scaler | None = None,
) -> DataFrame:
    """Compare the stored predictions and write persistence predictions and metrics.

    Persistence replaces its own earlier rows, so a repeated run compares each model once.
    """
    test = read_parts(spark, tabular).where(F.col("split") == "test")
    write_predictions(
        persistence_predictions(test, order, target), f"{folder}/predictions"
    )
    stored = read_parts(spark, f"{folder}/predictions")
    write_metrics(evaluate(stored, scaler=scaler, target=target), f"{folder}/metrics")
    return read_whole(spark, f"{folder}/metrics").orderBy("model")
