"""Least squares on sliding windows from lagged products, without building the windows.

A window of ``w`` steps is ``w`` neighbouring rows. The product of two of its steps that lie ``d``
apart is a product of two rows that lie ``d`` apart, and all windows but those at the ends of a series
share it. So the moment matrix of all window inputs is made of one small matrix per distance, with
corrections for the first and last ``w`` rows of each series. Rows are shuffled once, in chunks, and
at most one in 64 is copied; building the windows would copy each ``w`` times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.operators.ordered import POSITION
from stormframe.operators.sequences import CHUNK_ROWS

#: Series whose first position and length are broadcast, at most.
BROADCAST_SERIES = 100_000
#: In place of a step: products of all pairs at a distance, before corrections.
ALL_STEPS = -1
_MOMENTS = "step int, distance int, a int, b int, total double"


@dataclass(frozen=True)
class WindowModel:
    """``y = intercept + sum of coefficients[step, feature] * x``, oldest step first, of shifted values."""

    features: tuple[str, ...]
    target: str
    coefficients: np.ndarray
    intercept: float
    shift: np.ndarray

    @property
    def window(self) -> int:
        return len(self.coefficients)


def _values(features: Sequence[str], target: str):
    """Features and target as windows hold them, in 32 bits."""
    return [F.col(c).cast("float").cast("double").alias(f"_v{i}") for i, c in enumerate((*features, target))]


def _chunked(
    positioned: DataFrame, features: Sequence[str], target: str, window: int, by: Sequence[str],
    keep: Sequence[str], chunk_rows: int | None,
) -> DataFrame:
    """Rows by chunk, the last ``window`` rows of a chunk in the next one too, with what is known of their series."""
    if window < 1:
        raise ValueError("window must be >= 1")
    chunk_rows = max(chunk_rows or max(CHUNK_ROWS, 64 * window), window)
    series = F.struct(*by) if by else F.lit(0)
    rows = positioned.select(series.alias("_series"), F.col(POSITION), *keep, *_values(features, target))
    lengths = rows.groupBy("_series").agg(F.min(POSITION).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    lengths = lengths.where(F.col("_rows") > window)
    if not by or lengths.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES:
        lengths = F.broadcast(lengths)
    joined = rows.join(lengths, "_series")
    place = F.col(POSITION) - F.col("_first")
    own = F.floor(place / chunk_rows)
    at_end = place % chunk_rows >= chunk_rows - window
    chunks = F.when(at_end, F.array(own, own + 1)).otherwise(F.array(own))
    return joined.withColumns({"_place": place, "_own": own}).withColumn("_chunk", F.explode(chunks))


def _in_order(frame: pd.DataFrame, count: int) -> tuple[pd.DataFrame, np.ndarray, int]:
    """Rows of a chunk in order, their values, and how many of them belong to the chunk before."""
    frame = frame.sort_values("_place")
    values = frame[[f"_v{i}" for i in range(count)]].to_numpy(np.float64)
    return frame, values, int((frame["_own"] < frame["_chunk"]).sum())


def lagged_products(values: np.ndarray, borrowed: int, first: int, rows: int, window: int):
    """``(step, distance, matrix)`` of one chunk of a series of ``rows`` rows.

    ``values`` are consecutive rows from place ``first`` on; pairs whose later row is among the first
    ``borrowed`` belong to the chunk before. For ``ALL_STEPS`` the matrix sums all pairs; for a step it
    takes away those that no window has there: its earlier row lies before the step, or too near the end.
    """
    last = rows - 1 - window  # the last row that is the oldest step of a window
    for distance in range(window + 1):
        later = np.arange(max(borrowed, distance), len(values))
        if not len(later):
            continue
        earlier = later - distance
        yield ALL_STEPS, distance, values[earlier].T @ values[later]
        place = first + earlier
        edge = (place < window) | (place > last)
        if not edge.any():
            continue
        products = values[earlier[edge]][:, :, None] * values[later[edge]][:, None, :]
        steps = np.arange(window - distance + 1)[:, None]
        outside = (place[edge] < steps) | (place[edge] > last + steps)
        for step, matrix in enumerate(np.tensordot(outside.astype(float), products, 1)):
            if outside[step].any():
                yield step, distance, -matrix


def window_moments(
    positioned: DataFrame, features: Sequence[str], target: str, window: int, shift: np.ndarray,
    by: Sequence[str] = (), chunk_rows: int | None = None,
) -> np.ndarray:
    """Sums of products of ``1``, all steps of all features (oldest first), and the target, over all windows.

    Values are taken relative to ``shift``, one number per feature and one for the target. Only sums per
    distance and step reach the driver: their number depends on the window and the features alone.
    """
    count = len(features) + 1

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        frame, values, borrowed = _in_order(frame, count)
        values = np.column_stack([values - shift, np.ones(len(values))])
        first, rows = int(frame["_place"].iloc[0]), int(frame["_rows"].iloc[0])
        found = list(lagged_products(values, borrowed, first, rows, window))
        a, b = np.divmod(np.arange((count + 1) ** 2), count + 1)
        return pd.DataFrame({
            "step": np.repeat([s for s, _, _ in found], len(a)), "distance": np.repeat([d for _, d, _ in found], len(a)),
            "a": np.tile(a, len(found)), "b": np.tile(b, len(found)),
            "total": np.concatenate([m.ravel() for _, _, m in found]) if found else [],
        })

    chunked = _chunked(positioned, features, target, window, by, (), chunk_rows)
    sums = chunked.groupBy("_series", "_chunk").applyInPandas(products, _MOMENTS)
    table = np.zeros((window + 2, window + 1, count + 1, count + 1))
    for row in sums.groupBy("step", "distance", "a", "b").agg(F.sum("total").alias("total")).collect():
        table[row["step"], row["distance"], row["a"], row["b"]] = row["total"]  # ALL_STEPS is the last one
    return _assembled(table, window, len(features))


def _assembled(table: np.ndarray, window: int, features: int) -> np.ndarray:
    target, one = features, features + 1
    names = [(0, one), *((k, f) for k in range(window) for f in range(features)), (window, target)]
    out = np.zeros((len(names), len(names)))
    for i, (k, a) in enumerate(names):
        for j, (m, b) in enumerate(names):
            if i == 0:  # 1 beside any step: the step's own sum
                k, a = m, one
            if i <= j:
                out[i, j] = out[j, i] = table[ALL_STEPS, m - k, a, b] + table[k, m - k, a, b]
    return out


def fit_on_windows(
    train: DataFrame, features: Sequence[str], target: str, window: int,
    by: Sequence[str] = (), chunk_rows: int | None = None,
) -> WindowModel:
    """Ordinary least squares with intercept of each row's target on the ``window`` rows before it.

    ``train`` has consecutive positions in each series of ``by``; a series of at most ``window`` rows has
    no window. Raises if there is none at all. Inputs that others determine get the solution of least norm.
    """
    means = train.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(_values(features, target)))).first()
    shift = np.array([m or 0.0 for m in means])
    moments = window_moments(train, features, target, window, shift, by, chunk_rows)
    n = moments[0, 0]
    if not n:
        raise ValueError(f"insufficient rows for window length {window}")
    mean = moments[0, 1:] / n
    centred = moments[1:, 1:] / n - np.outer(mean, mean)
    solved = np.linalg.lstsq(centred[:-1, :-1], centred[:-1, -1], rcond=1e-12)[0]
    intercept = float(mean[-1] - mean[:-1] @ solved)
    return WindowModel(tuple(features), target, solved.reshape(window, len(features)), intercept, shift)


def predict_on_windows(
    model: WindowModel, positioned: DataFrame, time: str = "datetime", by: Sequence[str] = (),
    chunk_rows: int | None = None,
) -> DataFrame:
    """``target_ts, y_true, y_pred`` of each row with ``window`` rows before it in its series."""
    window, count = model.window, len(model.features) + 1

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame, values, borrowed = _in_order(frame, count)
        shares = (values[:, :-1] - model.shift[:-1]) @ model.coefficients.T  # of each row as each step
        later = np.arange(max(borrowed, window), len(values))
        total = sum((shares[later - window + k, k] for k in range(window)), np.zeros(len(later)))
        return pd.DataFrame({
            "target_ts": frame[time].to_numpy()[later], "y_true": values[later, -1],
            "y_pred": total + model.intercept + model.shift[-1],
        })

    chunked = _chunked(positioned, model.features, model.target, window, by, (time,), chunk_rows)
    schema = f"target_ts {dict(positioned.dtypes)[time]}, y_true double, y_pred double"
    return chunked.groupBy("_series", "_chunk").applyInPandas(score, schema)
