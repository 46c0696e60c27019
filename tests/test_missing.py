"""NaN as a missing value, several series, and broken payloads."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stormframe.config import SeriesOrder
from stormframe.functions.severity import with_derived_features
from stormframe.operators.metrics import regression_metrics
from stormframe.operators.quality import missing_report, outlier_report, require_trainable, run_summary, validation_report
from stormframe.plans.prepare import condition, split_table
from stormframe.sources.header_json import parse_payloads, rejected_payloads

NAN = float("nan")
COLUMNS = "sid long, datetime timestamp_ntz, event_id long, bt double, bz_gsm double, speed double, density double, dst double"


def series(spark, count, hours, gap_in=None):
    start, rows = datetime(2021, 3, 1), []
    for sid in range(count):
        for h in range(hours):
            shift = 6 if gap_in == sid and h > hours // 2 else 0
            rows.append((sid, start + timedelta(hours=h + shift), sid * hours + h, 4.0, -3.0, 410.0, 6.0, -12.0))
    return spark.createDataFrame(rows, COLUMNS)


def test_nan_is_missing(spark):
    frame = series(spark, 1, 5).withColumn("bt", F.when(F.col("event_id") == 2, NAN).otherwise(F.col("bt")))
    report = {r["column_name"]: r["null_count"] for r in missing_report(frame).collect()}
    assert report["bt"] == 1 and report["*"] == 1
    assert {r["column_name"]: r["outliers"] for r in outlier_report(frame).collect()}["bt"] == 0
    assert condition(frame).rows.count() == 5
    lost = frame.withColumns({c: F.lit(NAN) for c in ("bt", "bz_gsm", "speed", "density", "dst")})
    row = with_derived_features(lost).first()
    assert row["storm_severity_index"] is None and row["storm_severity_class"] is None


def test_windows_stay_inside_a_series(spark):
    order = SeriesOrder(by=("sid",))
    table = split_table(condition(series(spark, 10, 30), order=order))
    summary = run_summary(table, 24, by=order.by)
    assert summary.select("train_samples", "val_samples", "test_samples").first() == (0, 0, 0)
    with pytest.raises(ValueError, match="not enough"):
        require_trainable(summary)


def test_gaps_are_counted_per_series(spark):
    row = validation_report(series(spark, 3, 20, gap_in=1), order=SeriesOrder(by=("sid",))).first()
    assert (row["num_gaps"], row["max_gap_hours"], row["gap_fraction"]) == (1, 7.0, round(1 / 60, 4))


@pytest.mark.parametrize("guess", [None, NAN])
def test_missing_predictions_raise(spark, guess):
    frame = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (100.0, guess)], "y_true double, y_pred double")
    with pytest.raises(Exception, match="missing values"):
        regression_metrics(frame).collect()


def test_malformed_payloads_are_not_dropped(spark):
    good = '[["time_tag","bt"],["2021-01-01 00:00:00","1.5"]]'
    frame = spark.createDataFrame([(good,), ("[[",), ("{}",), (None,)], "payload string")
    assert rejected_payloads(frame).count() == 2
    with pytest.raises(Exception, match="malformed payload"):
        parse_payloads(frame, columns=["time_tag", "bt"]).collect()
    assert parse_payloads(frame.where(F.col("payload") == good), columns=["bt"]).collect() == [(1.5,)]
