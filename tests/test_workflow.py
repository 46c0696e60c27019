"""The whole way from observations to metrics, against the same steps in pandas."""

from datetime import datetime
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_sources import line

from stormframe.config import MEASUREMENTS, ForestSettings, SeriesOrder, Settings
from stormframe.operators.regression import baseline_models
from stormframe.operators.sequences import check_sequences
from stormframe.plans.baselines import evaluate, load_model, run_baselines, run_evaluation
from stormframe.plans.prepare import condition, prepare, split_table
from stormframe.operators.quality import validation_report
from stormframe.session import drop_stages, shared_folder, stored
from stormframe.sources.fixed_width import read_years
from stormframe.sources.tables import (
    read_scaler,
    read_sequences,
    read_split,
    write_observations,
    write_predictions,
)
from stormframe.sources.versions import Versions, latest, read_parts, write_parts

SETTINGS = Settings(window=6, limits={"bt": (0.0, 12.0), "speed": (200.0, 1200.0)})


def random_hours(n=2300):
    rng = np.random.default_rng(7)
    activity = rng.gamma(2.0, 1.0, n)
    table = pd.DataFrame(
        {
            "datetime": pd.date_range("2011-03-05 06:00", periods=n, freq="h").as_unit("us"),
            "event_id": np.arange(n),
            "bz_gsm": 3.0 - 4.0 * activity * rng.uniform(size=n),
            "bt": 2.0 + 2.5 * activity,
            "speed": 320.0 + 60.0 * activity,
            "density": rng.uniform(0.5, 18.0, n),
            "dst": 4.0 - 25.0 * activity,
        }
    )
    for c in MEASUREMENTS:
        table.loc[rng.random(n) < 0.1, c] = np.nan
    table.loc[:30, "density"] = np.nan
    return table


def in_pandas(table):
    cols = list(MEASUREMENTS)
    t = table.sort_values("datetime").reset_index(drop=True)
    t[cols] = t[cols].ffill().bfill()
    t = t[t["bt"].between(0, 12) & t["speed"].between(200, 1200)].reset_index(drop=True)
    norm = {
        "dst": t["dst"].abs().clip(0, 300) / 300,
        "bz": t["bz_gsm"].clip(upper=0).abs().clip(0, 20) / 20,
        "bt": t["bt"].clip(0, 30) / 30,
        "speed": (t["speed"].clip(300, 800) - 300) / 500,
        "density": (t["density"].clip(1, 50) - 1) / 49,
    }
    t["storm_severity_index"] = sum(w * n for w, n in zip((0.30, 0.25, 0.20, 0.15, 0.10), norm.values()))
    n_test = n_val = int(len(t) * 0.15)
    t["split"] = np.repeat(["train", "val", "test"], [len(t) - n_test - n_val, n_val, n_test])
    return t


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("prepared"))
    frame = spark.createDataFrame(pa.Table.from_pandas(random_hours(), preserve_index=False)).repartition(5)
    summary = prepare(frame, folder, SETTINGS, block_rows=150)
    return latest(spark, folder), summary.first()


@pytest.fixture(scope="module")
def expected():
    return in_pandas(random_hours())


def test_summary(prepared, expected):
    _, summary = prepared
    sizes = expected["split"].value_counts()
    for split in ("train", "val", "test"):
        assert summary[f"{split}_samples"] == sizes[split] - 6
    assert summary["feature_names"] == ["bt", "bz_gsm", "speed", "density"]


def test_scaled_splits(spark, prepared, expected):
    folder, _ = prepared
    columns = ["bt", "bz_gsm", "speed", "density", "storm_severity_index"]
    actual = spark.read.parquet(f"{folder}/tabular").orderBy("datetime").toPandas()
    train = expected[expected["split"] == "train"]
    scaled = (expected[columns] - train[columns].mean()) / train[columns].std(ddof=0)
    assert actual["split"].tolist() == expected["split"].tolist()
    np.testing.assert_allclose(actual[columns], scaled, atol=1e-9)
    np.testing.assert_allclose(actual["dst"], expected["dst"])  # stays in physical units
    scaler = read_scaler(spark, f"{folder}/scaler")
    assert scaler.means["bt"] == pytest.approx(train["bt"].mean())


def test_stored_sequences(spark, prepared):
    folder, summary = prepared
    sequences = read_sequences(spark, f"{folder}/sequences")
    check_sequences(sequences)
    assert sequences.where("window = 6").count() == sum(summary[f"{s}_samples"] for s in ("train", "val", "test"))
    rows = read_split(spark, f"{folder}/tabular", "val", ["bt", "speed"], keys=["rn"]).orderBy("rn").collect()
    sample = read_sequences(spark, f"{folder}/sequences", "val").orderBy("rn").first()
    assert sample["rn"] == rows[6]["rn"]
    np.testing.assert_allclose([step[0] for step in sample["x"]], [r["bt"] for r in rows[:6]], rtol=1e-6)


def test_split_reads_only_what_it_needs(spark, prepared):
    folder, _ = prepared
    plan = read_split(spark, f"{folder}/tabular", "train", ["speed"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<speed:double,storm_severity_index:double>" in plan


def test_from_landed_files_to_metrics(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    rng = np.random.default_rng(3)
    for year in (2020, 2021):
        values = rng.uniform(size=(90, 24, 5))
        lines = [
            line(year, day + 1, hour, f"{v[0] * 5:.1f}", f"{-v[1] * 9:.1f}", f"{1 + v[2] * 9:.1f}",
                 f"{300 + v[3] * 400:.0f}", f"{-v[4] * 99:.0f}")
            for day in range(90) for hour, v in enumerate(values[day])
        ]
        (landing / f"{year}.dat").write_text("\n".join(lines))
    order, folder = SeriesOrder(tiebreak="line_id"), str(tmp_path / "out")
    table = str(tmp_path / "observations")
    write_observations(read_years(spark, str(landing), 2000, 2026), table)
    summary = prepare(read_parts(spark, table), folder, order=order).first()
    assert sum(summary[f"{s}_samples"] for s in ("train", "val", "test")) == 2 * 90 * 24 - 3 * 24
    models = {"linear_regression": baseline_models()["linear_regression"]}
    tabular = f"{latest(spark, folder)}/tabular"
    run_baselines(spark, tabular, folder, models, keys=["datetime", "line_id"])
    metrics = run_evaluation(spark, tabular, folder, order=order).collect()
    assert [r["model"] for r in metrics] == ["linear_regression", "persistence"]
    assert metrics[0]["rmse"] < metrics[1]["rmse"]


def test_gate_stops_small_tables(spark, tmp_path):
    frame = spark.createDataFrame(pa.Table.from_pandas(random_hours(300), preserve_index=False))
    with pytest.raises(ValueError, match="not enough"):
        prepare(frame, str(tmp_path), SETTINGS)


def test_empty_column_drops_all_rows(spark):
    table = random_hours(50)
    table["dst"] = np.nan
    frame = spark.createDataFrame(pa.Table.from_pandas(table, preserve_index=False)).withColumn(
        "dst", F.col("dst").cast("double")
    )
    assert split_table(condition(frame, SETTINGS, block_rows=10)).count() == 0


def test_baselines_and_evaluation(spark, prepared, expected, tmp_path):
    folder, _ = prepared
    out = str(tmp_path)
    models = baseline_models(forest=ForestSettings(trees=5, depth=4))
    results = run_baselines(spark, f"{folder}/tabular", out, models)
    assert set(results) == {"linear_regression", "random_forest"}
    assert results["linear_regression"]["r2"] > 0
    test_rows = read_split(spark, f"{folder}/tabular", "test", ["bz_gsm", "speed", "density"], keys=["event_id"])
    for model in results:
        again = load_model(spark, out, model).transform(test_rows).select("event_id", F.col("y_pred").alias("loaded"))
        kept = read_parts(spark, f"{out}/predictions").where(F.col("model") == model).join(again, "event_id")
        assert kept.count() == test_rows.count() and kept.where("y_pred != loaded").isEmpty()

    first = run_evaluation(spark, f"{folder}/tabular", out).collect()
    again = run_evaluation(spark, f"{folder}/tabular", out).collect()
    assert [r["model"] for r in again] == ["linear_regression", "persistence", "random_forest"]
    assert first == again

    test = expected[expected["split"] == "test"]["storm_severity_index"].to_numpy()
    scaler = read_scaler(spark, f"{folder}/scaler")
    physical = {r["model"]: r for r in run_evaluation(spark, f"{folder}/tabular", out, scaler=scaler).collect()}
    rmse = np.sqrt(np.mean(np.diff(test) ** 2))
    assert physical["persistence"]["rmse"] == pytest.approx(rmse, abs=1e-9)
    assert physical["persistence"]["r2"] == pytest.approx(1 - np.mean(np.diff(test) ** 2) / np.var(test[1:]))


def test_predictions_replace_only_their_model(spark, tmp_path):
    def rows(model, n):
        return spark.createDataFrame([(model, 1.0, 2.0)] * n, "model string, y_true double, y_pred double")

    for model, n in (("a", 2), ("b", 3), ("a", 1)):
        write_predictions(rows(model, n), str(tmp_path / "p"))
    counts = read_parts(spark, str(tmp_path / "p")).groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in counts} == {"a": 1, "b": 3}


def test_evaluate_without_test_table(spark):
    frame = spark.createDataFrame([("m", 1.0, 1.0)], "model string, y_true double, y_pred double")
    assert evaluate(frame).first()["rmse"] == 0.0


def test_stored_rows_are_read_from_files(spark):
    frame = spark.range(5).withColumn("t", F.lit(datetime(2020, 1, 1)))
    kept = stored(frame, "five")
    assert kept.count() == 5 and kept.inputFiles()
    assert "ExistingRDD" not in kept._jdf.queryExecution().toString()
    assert shared_folder(spark) != shared_folder(spark)


def test_a_cluster_must_name_the_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn", "applicationId": "a", "getCheckpointDir": lambda: None})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())


class Counted:
    """Observations whose rows are counted each time that they are read."""

    def __init__(self, spark, table):
        read = self.read = spark.sparkContext.accumulator(0)
        frame = spark.createDataFrame(pa.Table.from_pandas(table, preserve_index=False)).repartition(3)

        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        self.frame, self.rows = frame.mapInArrow(count, frame.schema), len(table)

    def scans(self):
        return self.read.value / self.rows


@pytest.mark.parametrize("block_rows", [None, 300])
def test_prepare_reads_the_observations_three_times(spark, tmp_path, block_rows):
    counted = Counted(spark, random_hours())
    prepare(counted.frame, str(tmp_path), SETTINGS, block_rows=block_rows)
    assert counted.scans() <= 3


@pytest.mark.parametrize(("by", "block_rows"), [((), 200), ((), None), (("sensor",), 200)])
def test_the_report_measured_in_passing_is_the_report(spark, tmp_path, by, block_rows):
    table = random_hours().drop(index=[5, 6, 700, 1500])
    table["sensor"] = table["event_id"] % 3 // 2
    table.loc[20:90, "speed"] = 2500.0
    frame, order = spark.createDataFrame(pa.Table.from_pandas(table, preserve_index=False)), SeriesOrder(by=by)
    prepare(frame, str(tmp_path), SETTINGS, order, gate=False, block_rows=block_rows)
    measured = spark.read.parquet(f"{latest(spark, str(tmp_path))}/validation").first().asDict()
    assert measured == validation_report(frame, order=order).first().asDict()
    assert measured["num_gaps"] > 0 and measured["speed_outliers"] == 71


def test_a_run_that_fails_leaves_the_earlier_version(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame(pa.Table.from_pandas(random_hours(), preserve_index=False))
    folder = str(tmp_path)
    prepare(frame, folder, SETTINGS)
    place = latest(spark, folder)
    rows = spark.read.parquet(f"{place}/tabular").count()

    def broken(*_):
        raise OSError("lost half-way")

    monkeypatch.setattr("stormframe.plans.prepare.split_windows", broken)
    with pytest.raises(OSError, match="half-way"):
        prepare(frame.limit(2000), folder, SETTINGS)
    assert latest(spark, folder) == place
    assert spark.read.parquet(f"{place}/tabular").count() == rows
    monkeypatch.undo()
    for _ in range(3):
        prepare(frame, folder, SETTINGS)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("version=")]) == 2


def test_parts_keep_the_versions_they_need(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame(pairs, "k long, v long")

    path = str(tmp_path / "t")
    assert not write_parts(rows((1, 1)).where("false"), path, ["k"])
    with pytest.raises(FileNotFoundError):
        Versions(spark, path).parts()
    write_parts(rows((1, 10), (2, 20)), path, ["k"])
    write_parts(rows((2, 21), (3, 30)), path, ["k"])
    write_parts(rows((3, 31)), path, ["k"], append=True)
    held = sorted((r["k"], r["v"]) for r in read_parts(spark, path).collect())
    assert held == [(1, 10), (2, 21), (3, 30), (3, 31)]
    for _ in range(3):
        write_parts(rows((1, 11), (2, 22), (3, 33)), path, ["k"])
    assert len(list((tmp_path / "t").glob("version=*"))) == 2


def test_two_writers_cannot_both_commit(spark, tmp_path):
    first, second = (Versions(spark, str(tmp_path)) for _ in range(2))
    first.replace(spark.range(1).write.parquet)

    def write(place):
        first.replace(spark.range(2).write.parquet)
        spark.range(3).write.mode("overwrite").parquet(place)

    with pytest.raises(FileExistsError):
        second.replace(write)


def test_stages_go(spark):
    kept = stored(spark.range(3), "kept")
    place = kept.inputFiles()[0].removeprefix("file://")
    assert Path(place).exists()
    drop_stages(spark)
    assert not Path(place).exists()
