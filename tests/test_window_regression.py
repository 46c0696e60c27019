"""Least squares from lagged products against least squares on windows that are built."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from stormframe.operators.window_regression import (
    fit_on_windows,
    lagged_products,
    predict_on_windows,
    window_moments,
)

FEATURES = ("a", "b")


def series(n, seed, offset=0.0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(offset, 1.0, n), rng.uniform(0, 5, n)
    y = 0.5 * np.roll(a, 1) - 0.2 * np.roll(b, 2) + rng.normal(0, 0.1, n)
    stamps = pd.date_range("2020-01-01", periods=n, freq="h").as_unit("us")
    table = pd.DataFrame({"datetime": stamps, "rn": np.arange(n) + 7, "a": a, "b": b, "y": y})
    return table.astype({"a": "float32", "b": "float32", "y": "float32"})


def windows(table, w):
    """Inputs and targets of all windows, oldest step first."""
    values, y = table[list(FEATURES)].to_numpy(np.float64), table["y"].to_numpy(np.float64)
    x = np.array([values[t - w : t].ravel() for t in range(w, len(table))]).reshape(-1, w * len(FEATURES))
    return x, y[w:]


def to_spark(spark, *tables):
    return spark.createDataFrame(pa.Table.from_pandas(pd.concat(tables), preserve_index=False)).repartition(5)


@pytest.mark.parametrize(("n", "w", "chunk"), [(400, 5, 64), (400, 5, None), (23, 5, 5), (6, 5, 5), (11, 10, 10), (40, 1, 7)])
def test_moments_are_those_of_built_windows(spark, n, w, chunk):
    table = series(n, n)
    shift = np.array([0.5, 1.0, -0.25])
    found = window_moments(to_spark(spark, table), FEATURES, "y", w, shift, chunk_rows=chunk)
    x, y = windows(table, w)
    all_columns = np.column_stack([np.ones(len(x)), x - np.tile(shift[:2], w), y - shift[2]])
    np.testing.assert_allclose(found, all_columns.T @ all_columns, rtol=1e-9, atol=1e-9)


def test_fit_and_scores(spark):
    train, test, w = series(600, 1, 400.0), series(150, 2, 400.0), 6
    model = fit_on_windows(to_spark(spark, train), FEATURES, "y", w, chunk_rows=90)
    x, y = windows(train, w)
    design = np.column_stack([np.ones(len(x)), x - x.mean(0)])
    best = np.linalg.lstsq(design, y, rcond=None)[0]
    np.testing.assert_allclose(model.coefficients.ravel(), best[1:], atol=1e-8)

    scored = predict_on_windows(model, to_spark(spark, test), chunk_rows=40).orderBy("target_ts").toPandas()
    x_test, y_test = windows(test, w)
    np.testing.assert_allclose(scored["y_pred"], best[0] + (x_test - x.mean(0)) @ best[1:], atol=1e-7)
    np.testing.assert_allclose(scored["y_true"], y_test)
    assert scored["target_ts"].tolist() == test["datetime"].iloc[w:].tolist()


def test_series_do_not_share_windows(spark):
    w, tables = 4, [series(n, n) for n in (4, 5, 60, 150)]  # the first has no window
    labelled = [t.assign(sensor=i) for i, t in enumerate(tables)]
    model = fit_on_windows(to_spark(spark, *labelled), FEATURES, "y", w, by=["sensor"], chunk_rows=16)
    pairs = [windows(t, w) for t in tables[1:]]
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    best = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    np.testing.assert_allclose(model.coefficients.ravel(), best[1:], atol=1e-8)
    assert predict_on_windows(model, to_spark(spark, *labelled), by=["sensor"]).count() == len(y)


def test_no_window_raises(spark):
    with pytest.raises(ValueError, match="insufficient rows for window length 9"):
        fit_on_windows(to_spark(spark, series(9, 1)), FEATURES, "y", 9)
    with pytest.raises(ValueError, match="window must be >= 1"):
        fit_on_windows(to_spark(spark, series(9, 1)), FEATURES, "y", 0)


def test_chunks_add_up():
    """Cutting a series anywhere gives the same sums."""
    values, w = np.random.default_rng(3).normal(size=(30, 3)), 4

    def total(cuts):
        out = {}
        for a, b in zip([0, *cuts], [*cuts, 30]):
            start = max(0, a - w)
            for step, distance, matrix in lagged_products(values[start:b], a - start, start, 30, w):
                out[step, distance] = out.get((step, distance), 0) + matrix
        return out

    whole = total([])
    for cuts in ([15], [4, 8, 29], [5, 9, 13, 17]):
        found = total(cuts)
        assert found.keys() == whole.keys()
        for key in whole:
            np.testing.assert_allclose(found[key], whole[key], atol=1e-12)
