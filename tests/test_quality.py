from datetime import datetime, timedelta

import pytest

from stormframe.config import SeriesOrder
from stormframe.operators.conditioning import (
    drop_missing,
    first_rows,
    model_columns,
    require_complete,
    within_limits,
)
from stormframe.operators.quality import (
    check_schema,
    continuity_report,
    gate_checks,
    missing_report,
    outlier_report,
    require_trainable,
    require_valid,
    run_summary,
    validation_report,
)

SCHEMA = (
    "datetime timestamp_ntz, event_id long, bt double, bz_gsm double, speed double, "
    "density double, dst double"
)
START = datetime(2020, 1, 1)


def hourly(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def constant(n=10, skip=()):
    return [
        (START + timedelta(hours=i), i, 6.0, 0.0, 400.0, 5.0, -10.0) for i in range(n) if i not in skip
    ]


def test_constant_series_is_valid(spark):
    report = require_valid(validation_report(hourly(spark, constant())))
    assert report["total_records"] == 10
    assert report["num_gaps"] == 0
    assert report["max_gap_hours"] == 0.0
    assert report["missing_pct"] == 0.0
    assert report["bt_outliers"] == 0


def test_empty_and_incomplete_tables(spark):
    frame = hourly(spark, constant())
    with pytest.raises(ValueError, match="empty"):
        require_valid(validation_report(frame.limit(0)))
    with pytest.raises(ValueError, match="density"):
        check_schema(frame.drop("density"))


@pytest.mark.parametrize("block_rows", [2, 3, None])
def test_gaps(spark, block_rows):
    rows = constant(20, skip=(5, 6, 7, 12))
    rows.append((START + timedelta(hours=3), 99, 6.0, 0.0, 400.0, 5.0, -10.0))  # a duplicate hour
    report = continuity_report(hourly(spark, rows), block_rows=block_rows).first()
    assert (report["num_gaps"], report["max_gap_hours"]) == (2, 4.0)
    assert report["gap_fraction"] == round(2 / 17, 4)


def test_gaps_per_series(spark):
    rows = [(START + timedelta(hours=h), i, s) for i, (s, h) in enumerate(
        [("a", 0), ("a", 1), ("a", 4), ("b", 0), ("b", 1), ("c", 9)]
    )]
    frame = hourly(spark, rows, "datetime timestamp_ntz, event_id long, series string")
    report = continuity_report(frame, SeriesOrder(by=("series",))).collect()
    assert {r["series"]: (r["num_gaps"], r["max_gap_hours"], r["gap_fraction"]) for r in report} == {
        "a": (1, 3.0, 0.3333), "b": (0, 0.0, 0.0), "c": (0, 0.0, 0.0),
    }


def test_missing_report(spark):
    rows = constant(8)
    rows[0] = (*rows[0][:2], None, None, 400.0, 5.0, -10.0)
    frame = hourly(spark, rows).drop("event_id")
    report = {r["column_name"]: (r["null_count"], r["null_pct"]) for r in missing_report(frame).collect()}
    assert report["bt"] == (1, 12.5)
    assert report["speed"] == (0, 0.0)
    assert report["*"] == (2, 4.17)  # 2 of 48 cells


def test_percentages_round_half_to_even(spark):
    rows = [(i, None if i == 0 else 1.0) for i in range(800)]
    frame = hourly(spark, rows, "i int, bt double").select("bt")
    assert missing_report(frame).first()["null_pct"] == 0.12  # 0.125


def test_outliers_are_counted_among_present_values(spark):
    values = [-0.1, 0.0, 50.0, 50.1, None, None]
    frame = hourly(spark, [(v,) for v in values], "bt double")
    (row,) = outlier_report(frame).collect()
    assert (row["column_name"], row["outliers"], row["outlier_pct"]) == ("bt", 2, 50.0)
    empty = hourly(spark, [(None,)], "bt double")
    assert outlier_report(empty).first()["outlier_pct"] == 0.0


def test_limits(spark):
    values = [(0.0,), (5.0,), (-1e-9,), (5.0000001,), (None,), (2.0,)]
    frame = hourly(spark, values, "bt double")
    assert sorted(r["bt"] for r in within_limits(frame).collect()) == [0.0, 2.0, 5.0]
    assert within_limits(frame, {"other": (0, 1)}).count() == 6


def test_drop_missing_and_completeness(spark):
    rows = constant(3)
    rows[1] = (*rows[1][:2], None, *rows[1][3:])
    frame = hourly(spark, rows)
    assert drop_missing(frame, ["bt"]).count() == 2
    require_complete(drop_missing(frame, ["bt"]), ["bt", "dst"])
    with pytest.raises(ValueError, match="bt"):
        require_complete(frame, ["bt", "dst"])
    assert model_columns(frame).columns == ["datetime", "bt", "bz_gsm", "speed", "density", "dst"]


def test_first_rows(spark):
    frame = hourly(spark, constant(30)).repartition(4)
    assert [r["event_id"] for r in first_rows(frame, 5).collect()] == [0, 1, 2, 3, 4]


def split_counts(spark, train, val, test):
    labels = ["train"] * train + ["val"] * val + ["test"] * test
    return hourly(spark, [(s,) for s in labels], "split string")


def test_gate(spark):
    good = run_summary(split_counts(spark, 1024, 224, 224), 24)
    require_trainable(good)
    row = good.first()
    assert (row["train_samples"], row["val_samples"], row["n_features"]) == (1000, 200, 4)
    for counts, failed in (((1023, 224, 224), "train"), ((1024, 223, 224), "val"), ((1024, 224, 10), "test")):
        summary = run_summary(split_counts(spark, *counts), 24)
        assert [r["check"] for r in gate_checks(summary).collect() if not r["passed"]] == [f"{failed}_samples"]
        with pytest.raises(ValueError, match=failed):
            require_trainable(summary)
    with pytest.raises(ValueError, match="target_name"):
        gate_checks(good.drop("target_name"))
