"""Blocked execution must equal plain global pandas, whatever the cuts and the skew."""

from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stormframe.config import SeriesOrder
from stormframe.operators.blocks import BLOCK, plan_blocks
from stormframe.operators.ordered import (
    chronological_split,
    fill_missing,
    persistence_forecast,
    with_block_position,
    with_position,
    with_step_hours,
)

COLUMNS = ["a", "b", "c", "d"]
BY_SENSOR = SeriesOrder(by=("sensor",))


def observations(n=3000, seed=0, hot_instant=True, sensors=5):
    """Random rows; a third share one instant, a third of the rest one sensor."""
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2020-01-01")
    seconds = rng.integers(0, 40 * 86400, n)
    if hot_instant:
        seconds[: n // 3] = 86400 * 7
    sensor = rng.integers(0, sensors, n).astype(float)
    sensor[rng.random(n) < 1 / 3] = 0
    table = pd.DataFrame(
        {
            "datetime": start + pd.to_timedelta(seconds, unit="s"),
            "event_id": rng.permutation(n),
            "sensor": sensor.astype(int),
            "a": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
            "b": np.where(rng.random(n) < 0.995, np.nan, rng.normal(size=n)),
            "c": np.nan,
            "d": rng.normal(size=n),
        }
    )
    ordered = table.sort_values(["datetime", "event_id"])
    table.loc[ordered.index[: n // 2], "d"] = np.nan  # missing head over many blocks
    return table.sample(frac=1, random_state=seed)


SCHEMA = pa.schema(
    [("datetime", pa.timestamp("us")), ("event_id", pa.int64()), ("sensor", pa.int32())]
    + [(c, pa.float64()) for c in COLUMNS]
)


def to_spark(spark, table, partitions=6):
    arrow = pa.Table.from_pandas(table, SCHEMA, preserve_index=False)
    return spark.createDataFrame(arrow).repartition(partitions)


def ordered_pandas(table, by=()):
    return table.sort_values([*by, "datetime", "event_id"]).reset_index(drop=True)


def collect(frame, by=()):
    return frame.toPandas().sort_values([*by, "datetime", "event_id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def table():
    return observations()


@pytest.mark.parametrize("block_rows", [100, 1000, 10_000, None])
def test_fill_equals_global(spark, table, block_rows):
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, block_rows=block_rows)
    actual = collect(plan.clean(fill_missing(plan.assign(frame), plan, COLUMNS)))
    expected = ordered_pandas(table)
    expected[COLUMNS] = expected[COLUMNS].ffill().bfill()
    pd.testing.assert_frame_equal(actual[COLUMNS], expected[COLUMNS], check_dtype=False)


@pytest.mark.parametrize("block_rows", [100, 700, None])
def test_fill_by_series_equals_pandas(spark, table, block_rows):
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, BY_SENSOR, block_rows)
    actual = collect(plan.clean(fill_missing(plan.assign(frame), plan, COLUMNS)), ["sensor"])
    expected = ordered_pandas(table, ["sensor"])
    expected[COLUMNS] = expected.groupby("sensor")[COLUMNS].transform(lambda s: s.ffill().bfill())
    pd.testing.assert_frame_equal(actual[COLUMNS], expected[COLUMNS], check_dtype=False)


def test_rows_without_series_are_one_series(spark, table):
    holes = table.assign(sensor=table["sensor"].where(table["sensor"] != 0, np.nan))
    frame = to_spark(spark, holes)
    plan = plan_blocks(frame, BY_SENSOR, 100)
    actual = collect(plan.clean(with_position(plan.assign(frame), plan)).fillna(0, ["sensor"]), ["sensor"])
    expected = ordered_pandas(table, ["sensor"]).groupby("sensor").cumcount()
    assert actual["rn"].tolist() == expected.tolist()


@pytest.mark.parametrize("by", [(), ("sensor",)])
@pytest.mark.parametrize("block_rows", [100, 100_000])
def test_position_and_length(spark, table, by, block_rows):
    frame = to_spark(spark, table)
    order = SeriesOrder(by=by)
    plan = plan_blocks(frame, order, block_rows)
    actual = collect(with_position(plan.assign(frame), plan), by)
    expected = ordered_pandas(table, by)
    groups = expected.groupby(list(by)) if by else expected.groupby(lambda _: 0)
    assert actual["rn"].tolist() == groups.cumcount().tolist()
    assert actual["n_rows"].tolist() == groups["event_id"].transform("size").tolist()


@pytest.mark.parametrize("by", [(), ("sensor",)])
@pytest.mark.parametrize("block_rows", [100, 100_000])
def test_steps_and_persistence(spark, table, by, block_rows):
    frame = to_spark(spark, table)
    order = SeriesOrder(by=by)
    plan = plan_blocks(frame, order, block_rows)
    blocked = plan.assign(frame)
    expected = ordered_pandas(table, by)
    groups = expected.groupby(list(by)) if by else expected.groupby(lambda _: 0)

    steps = collect(with_step_hours(blocked, plan), by)["step_hours"]
    hours = groups["datetime"].diff().dt.total_seconds() / 3600
    np.testing.assert_array_equal(steps.to_numpy(float), hours.to_numpy(float))

    naive = collect(persistence_forecast(blocked, plan, "a"), by)
    expected["y_pred"] = groups["a"].shift()
    kept = expected[groups.cumcount() > 0].reset_index(drop=True)
    np.testing.assert_array_equal(naive["y_true"].to_numpy(float), kept["a"].to_numpy(float))
    np.testing.assert_array_equal(naive["y_pred"].to_numpy(float), kept["y_pred"].to_numpy(float))


def test_hot_instant_is_divided(spark, table):
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, block_rows=100)
    sizes = plan.assign(frame).groupBy(BLOCK).count().toPandas()["count"]
    assert plan.tie_cuts  # the instant holding a third of the rows is cut on the tiebreak
    assert sizes.max() <= 300
    assert sizes.sum() == len(table)


def test_hot_series_is_divided(spark, table):
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, BY_SENSOR, 200)
    sizes = plan.assign(frame).groupBy(*plan.group).count().toPandas()["count"]
    assert sizes.max() <= 600
    assert sizes.sum() == len(table)


def test_small_series_stay_whole(spark, table):
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, BY_SENSOR)
    assert not plan.divided
    assert plan.assign(frame).select(BLOCK).distinct().count() == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    seed=st.integers(0, 10_000),
    n=st.integers(1, 60),
    block_rows=st.integers(1, 25),
)
def test_fill_and_position_property(spark, seed, n, block_rows):
    table = observations(n, seed)
    frame = to_spark(spark, table, 2)
    plan = plan_blocks(frame, block_rows=block_rows)
    filled = fill_missing(plan.assign(frame), plan, COLUMNS)
    actual = collect(with_position(filled, plan))
    expected = ordered_pandas(table)
    expected[COLUMNS] = expected[COLUMNS].ffill().bfill()
    pd.testing.assert_frame_equal(actual[COLUMNS], expected[COLUMNS], check_dtype=False)
    assert actual["rn"].tolist() == list(range(n))


def test_empty_table(spark):
    frame = to_spark(spark, observations(3)).limit(0)
    plan = plan_blocks(frame)
    assert with_position(fill_missing(plan.assign(frame), plan, COLUMNS), plan).count() == 0


def test_order_is_checked(spark):
    frame = spark.createDataFrame([(None, 1)], "datetime timestamp_ntz, event_id long")
    with pytest.raises(ValueError, match="no place"):
        plan_blocks(frame)
    text = spark.createDataFrame([], "datetime timestamp_ntz, event_id string")
    with pytest.raises(TypeError):
        plan_blocks(text)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 20, 101])
def test_split_sizes(spark, n):
    table = observations(max(n, 1), hot_instant=False)
    frame = to_spark(spark, table).limit(n)
    plan = plan_blocks(frame, block_rows=7)
    split = chronological_split(with_position(plan.assign(frame), plan)).toPandas()
    n_test = n_val = int(n * 0.15)
    counts = split["split"].value_counts().to_dict()
    assert counts.get("test", 0) == n_test
    assert counts.get("val", 0) == n_val
    assert counts.get("train", 0) == n - n_test - n_val
    labels = split.sort_values("rn")["split"].map({"train": 0, "val": 1, "test": 2})
    assert labels.is_monotonic_increasing


def test_persistence_example(spark):
    values = [7.0, 5.5, 5.5, 9.0, -1.0]
    rows = [(datetime(2020, 1, 1, i), i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "datetime timestamp_ntz, event_id long, y double")
    plan = plan_blocks(frame, block_rows=2)
    out = persistence_forecast(plan.assign(frame), plan, "y").orderBy("datetime").toPandas()
    assert out["y_true"].tolist() == values[1:]
    assert out["y_pred"].tolist() == values[:-1]


def test_persistence_needs_two_rows(spark):
    frame = spark.createDataFrame(
        [(datetime(2020, 1, 1), 0, 1.0)], "datetime timestamp_ntz, event_id long, y double"
    )
    plan = plan_blocks(frame)
    with pytest.raises(ValueError):
        persistence_forecast(plan.assign(frame), plan, "y")


@pytest.mark.parametrize(("by", "block_rows"), [(BY_SENSOR, 200), (SeriesOrder(), 400), (SeriesOrder(), 150), (SeriesOrder(), None)])
def test_blocks_are_dealt_evenly(spark, by, block_rows):
    table = observations(8000, hot_instant=False, sensors=4)
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, by, block_rows)
    filled = fill_missing(plan.assign(frame), plan, COLUMNS)
    sizes = [r["count"] for r in filled.groupBy(F.spark_partition_id()).count().collect()]
    parts = plan.partitions(frame)
    assert len(sizes) == parts
    assert max(sizes) < 1.5 * len(table) / parts


def test_rows_are_shuffled_once(spark, table):
    frame = to_spark(spark, table)
    plan = plan_blocks(frame, block_rows=300)
    both = with_block_position(fill_missing(plan.assign(frame), plan, COLUMNS), plan, placed=True)
    text = both._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan ==") :]
    assert physical.count("shufflepartitionidpassthrough") == 1
    assert physical.count("Exchange hashpartitioning(_part") == 0
