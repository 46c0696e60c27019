"""Regression metrics and the data behind the diagnostic charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.numeric import nan_to_null


def metric_columns(y_true: str = "y_true", y_pred: str = "y_pred") -> dict[str, Column]:
    """RMSE, MAE and R2 as aggregates of one pass.

    R2 is one minus residual over total variation and can be negative. With constant truth
    it is 1 for a perfect prediction and 0 otherwise. A missing or NaN value on either side raises,
    since leaving it out of one side only would change R2.
    """
    truth, guess = (_required(c) for c in (y_true, y_pred))
    error = truth - guess
    residual = F.avg(error * error)
    total = F.var_pop(truth)
    return {
        "rmse": F.sqrt(residual),
        "mae": F.avg(F.abs(error)),
        "r2": F.when(total > 0, F.lit(1.0) - residual / total).otherwise(
            F.when(residual == 0, F.lit(1.0)).when(residual > 0, F.lit(0.0))
        ),
    }


def _required(name: str) -> Column:
    lacking = F.raise_error(F.lit(f"column {name} has missing values")).cast("double")
    return F.coalesce(nan_to_null(F.col(name).cast("double")), lacking)


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over all rows, or per group. Partial sums are combined map-side, so a group
    that holds most of the rows costs no more than the others."""
    metrics = [c.alias(name) for name, c in metric_columns().items()]
    return predictions.groupBy(*by).agg(*metrics)


def model_comparison(predictions: DataFrame) -> DataFrame:
    """One row of metrics per model, sorted by model."""
    return regression_metrics(predictions, ["model"]).orderBy("model")


def truth_vs_prediction(predictions: DataFrame) -> DataFrame:
    return predictions.select("y_true", "y_pred")


def scatter_bins(predictions: DataFrame, width: float = 0.05) -> DataFrame:
    """Counts on a grid of ``width``: the scatter chart at any number of rows."""
    return predictions.groupBy(
        F.floor(F.col("y_true") / F.lit(width)).alias("true_bin"),
        F.floor(F.col("y_pred") / F.lit(width)).alias("pred_bin"),
    ).agg(F.count(F.lit(1)).alias("points"))
