from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormframe.operators.sequences import (
    align_features_target,
    check_sequences,
    flatten_windows,
    sequence_windows,
)

START = datetime(2020, 1, 1)


def positioned(spark, n, split=lambda i: "train", features=2):
    rows = [
        (START + timedelta(hours=i), i, split(i), *(float(i * features + f) for f in range(features)), float(i))
        for i in range(n)
    ]
    names = ", ".join(f"f{f} double" for f in range(features))
    frame = spark.createDataFrame(rows, f"datetime timestamp_ntz, rn long, split string, {names}, target double")
    return frame.repartition(4)


@pytest.mark.parametrize("chunk_rows", [1, 3, 4, 1000])
def test_windows_equal_a_loop(spark, chunk_rows):
    n, w = 25, 3
    windows = sequence_windows(positioned(spark, n), ["f0", "f1"], "target", w, chunk_rows=chunk_rows)
    rows = windows.orderBy("rn").collect()
    assert len(rows) == n - w
    values = np.arange(2 * n, dtype=np.float32).reshape(n, 2)
    for i, row in enumerate(rows):
        np.testing.assert_array_equal(row["x"], values[i : i + w])
        assert row["y"] == i + w
        assert row["target_ts"] == START + timedelta(hours=i + w)
    check_sequences(windows)


def test_shape_and_alignment_example(spark):
    windows = sequence_windows(positioned(spark, 10), ["f0", "f1"], "target", 3)
    assert windows.count() == 7
    first = windows.orderBy("rn").first()
    assert (len(first["x"]), len(first["x"][0])) == (3, 2)
    assert dict(windows.dtypes)["x"] == "array<array<float>>"


def test_windows_stay_inside_a_split(spark):
    def split(i):
        return "train" if i < 13 else "val" if i < 15 else "test"

    frame = positioned(spark, 25, split)
    rows = sequence_windows(frame, ["f0"], "target", 3, by=["split"], chunk_rows=4).collect()
    found = sorted((r["split"], r["rn"]) for r in rows)
    # two validation rows are fewer than a window, so they give no sample
    assert found == [("test", i) for i in range(18, 25)] + [("train", i) for i in range(3, 13)]


@pytest.mark.parametrize("n, samples", [(3, 0), (4, 1), (0, 0)])
def test_short_series(spark, n, samples):
    assert sequence_windows(positioned(spark, n), ["f0"], "target", 3).count() == samples


def test_window_must_be_positive(spark):
    with pytest.raises(ValueError):
        sequence_windows(positioned(spark, 5), ["f0"], "target", 0)


def test_long_form(spark):
    windows = sequence_windows(positioned(spark, 5), ["f0", "f1"], "target", 3)
    long = flatten_windows(windows, ["f0", "f1"]).orderBy("rn", "step").collect()
    assert [(r["rn"], r["step"], r["f0"]) for r in long][:4] == [(3, 0, 0.0), (3, 1, 2.0), (3, 2, 4.0), (4, 0, 2.0)]


def test_contract_check(spark):
    windows = sequence_windows(positioned(spark, 6), ["f0"], "target", 2)
    with pytest.raises(ValueError, match="array"):
        check_sequences(windows.withColumn("x", F.flatten("x")))
    with pytest.raises(ValueError, match="lack"):
        check_sequences(windows.withColumn("y", F.when(F.col("rn") > 2, F.col("y"))))
    ragged = windows.withColumn("x", F.when(F.col("rn") > 2, F.slice("x", 1, 1)).otherwise(F.col("x")))
    with pytest.raises(ValueError, match="differ"):
        check_sequences(ragged)


def test_alignment_counts(spark):
    frame = positioned(spark, 10)
    x, y = frame.select("datetime", "f0"), frame.select("datetime", "target")
    assert align_features_target(x, y, ["datetime"]).count() == 10
    with pytest.raises(ValueError, match="10 feature rows, 9 target rows, 1 keys"):
        align_features_target(x, y.where("target > 0"), ["datetime"])
    with pytest.raises(ValueError):
        align_features_target(x, y.union(y.limit(1)), ["datetime"])
