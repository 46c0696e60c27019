import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stormframe.config import ForestSettings
from stormframe.operators import metrics, regression
from stormframe.operators.regression import baseline_models, fit_models, stored_trees, walk_trees
from stormframe.operators.scaling import Scaler

# --- metrics ------------------------------------------------------------------------


def predictions(spark, y_true, y_pred, model="m"):
    rows = [(model, float(a), float(b)) for a, b in zip(y_true, y_pred)]
    return spark.createDataFrame(rows, "model string, y_true double, y_pred double")


def measure(spark, y_true, y_pred):
    return metrics.regression_metrics(predictions(spark, y_true, y_pred)).first()


def test_metrics_of_known_points(spark):
    # Errors 1, -1, 2, 0 and a variance of 5.
    row = measure(spark, [1, 3, 5, 7], [0, 4, 3, 7])
    assert row["rmse"] == pytest.approx(1.5**0.5)
    assert row["mae"] == pytest.approx(1.0)
    assert row["r2"] == pytest.approx(1 - 6 / 20)


def test_r2_corner_cases(spark):
    assert measure(spark, [1, 2, 3], [3, 2, 1])["r2"] == pytest.approx(-3.0)
    assert measure(spark, [2, 2], [2, 2])["r2"] == 1.0
    assert measure(spark, [2, 2], [1, 3])["r2"] == 0.0
    assert measure(spark, [5], [4])["rmse"] == 1.0
    assert measure(spark, [], [])["r2"] is None


def test_comparison_is_sorted(spark):
    both = predictions(spark, [1, 2], [1, 2], "b").union(predictions(spark, [1, 2], [2, 1], "a"))
    table = metrics.model_comparison(both).collect()
    assert [r["model"] for r in table] == ["a", "b"]
    assert table[1]["rmse"] == 0.0


def test_scatter_bins(spark):
    bins = metrics.scatter_bins(predictions(spark, [0.01, 0.02, -0.01], [0.06, 0.07, 0.0])).collect()
    assert sorted((r["true_bin"], r["pred_bin"], r["points"]) for r in bins) == [(-1, 0, 1), (0, 1, 2)]


# --- scaling ------------------------------------------------------------------------


def test_scaler(spark, tmp_path):
    rows = [("train", 1.0, 5.0), ("train", 2.0, 5.0), ("train", 3.0, 5.0), ("val", None, 6.0), ("test", 4.0, 4.0)]
    frame = spark.createDataFrame(rows, "split string, a double, b double")
    scaler = Scaler.fit(frame, ["a", "b"])
    assert scaler.means == {"a": 2.0, "b": 5.0}
    assert scaler.scales["a"] == pytest.approx(np.std([1, 2, 3]))
    assert scaler.scales["b"] == 1.0  # constant in training
    scaled = scaler.transform(frame).collect()
    assert scaled[3]["a"] is None
    assert (scaled[3]["b"], scaled[4]["b"]) == (1.0, -1.0)
    restored = scaler.inverse(scaler.transform(frame)).collect()
    assert restored[4]["a"] == pytest.approx(4.0)
    scaler.to_frame(spark).write.parquet(str(tmp_path / "scaler"))
    assert Scaler.from_frame(spark.read.parquet(str(tmp_path / "scaler"))) == scaler
    with pytest.raises(ValueError):
        Scaler.fit(frame.where("split = 'none'"), ["a"])
    with pytest.raises(ValueError, match=r"\['b'\]"):
        Scaler.fit(frame.withColumn("b", F.when(F.col("split") != "train", F.col("b"))), ["a", "b"])


# --- regressors ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tabular(spark):
    i = np.arange(175)
    table = pd.DataFrame(
        {
            "bz_gsm": 6 * np.cos(0.7 * i), "speed": 380.0 + 2 * i, "density": 2.0 + (i * i) % 23,
            "split": np.where(i % 7 < 5, "train", "test"),
        }
    )
    table["storm_severity_index"] = 0.4 - 0.02 * table["bz_gsm"] + 0.1 * np.sin(1.9 * i)
    return table


def test_linear_regression_is_least_squares(spark, tabular):
    frame = spark.createDataFrame(tabular)
    models = {"linear_regression": regression.baseline_models()["linear_regression"]}
    fitted = regression.fit_models(models, frame.where("split = 'train'"))
    actual = regression.predict(fitted, frame.where("split = 'test'"), keys=["speed"]).toPandas()
    train, test = tabular[tabular.split == "train"], tabular[tabular.split == "test"]
    inputs = ["bz_gsm", "speed", "density"]

    def design(t):
        return np.column_stack([np.ones(len(t)), t[inputs]])

    coefficients, *_ = np.linalg.lstsq(design(train), train["storm_severity_index"], rcond=None)
    expected = pd.Series(design(test) @ coefficients, index=test["speed"])
    np.testing.assert_allclose(actual["y_pred"], expected.loc[actual["speed"]], atol=1e-9)


def test_baselines_give_metrics(spark, tabular):
    frame = spark.createDataFrame(tabular)
    models = regression.baseline_models(forest=ForestSettings(trees=5, depth=4))
    fitted = regression.fit_models(models, frame.where("split = 'train'"))
    table = metrics.model_comparison(regression.predict(fitted, frame.where("split = 'test'"))).collect()
    assert [r["model"] for r in table] == ["linear_regression", "random_forest"]
    assert all(r["rmse"] > 0 and r["mae"] > 0 for r in table)


def test_forest_settings():
    forest = regression.random_forest()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (100, 10, 42)
    assert forest.getFeatureSubsetStrategy() == "all"


def test_gram_matrix(spark, tabular):
    table = regression.gram_matrix(spark.createDataFrame(tabular), ["bz_gsm", "speed"], "density").collect()
    full = np.column_stack([np.ones(len(tabular)), tabular[["bz_gsm", "speed", "density"]]])
    expected = full.T @ full
    names = ["1", "bz_gsm", "speed", "density"]
    assert len(table) == 10
    for r in table:
        assert r["total"] == pytest.approx(expected[names.index(r["row_name"]), names.index(r["column_name"])])


def test_linear_model_on_windows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3, 2)).astype(np.float32)
    weights = rng.normal(size=6)
    y = x.reshape(60, 6) @ weights + 0.5
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "target_ts long, y float, x array<array<float>>")
    model = regression.fit_linear_on_window(frame)
    out = regression.predict_linear_on_window(model, frame).toPandas()
    np.testing.assert_allclose(out["y_pred"], out["y_true"], atol=1e-5)
    assert out.columns.tolist() == ["target_ts", "y_true", "y_pred"]
    assert frame.select(F.size("x")).first()[0] == 3


def walked_in_sql(trees, rows):
    """Predictions of the forest by a recursive query over its nodes."""
    connection = duckdb.connect()
    connection.register("trees", trees)
    connection.register("samples", rows)
    return connection.sql("""
      WITH RECURSIVE walk(event_id, x, tree, node) AS (
        SELECT event_id, [a, b], tree, node FROM samples, trees WHERE node = 0
        UNION ALL
        SELECT event_id, x, tree, CASE WHEN x[t.feature::BIGINT + 1] <= t.threshold THEN t.left ELSE t.right END::INTEGER
        FROM walk w JOIN trees t USING (tree, node) WHERE t.left IS NOT NULL)
      SELECT event_id, avg(value) AS walked FROM walk JOIN trees USING (tree, node) WHERE "left" IS NULL
      GROUP BY event_id ORDER BY event_id""").df()["walked"].to_numpy()


def test_forest_does_not_depend_on_partitions_and_its_trees_can_be_walked(spark, tmp_path):
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"event_id": np.arange(3000), "a": rng.normal(size=3000), "b": rng.normal(size=3000)})
    table["y"] = np.sin(table["a"]) + table["b"] ** 2 + rng.normal(0, 0.1, 3000)
    frame = spark.createDataFrame(table)
    settings = ForestSettings(trees=7, depth=6)
    forest = {"f": baseline_models(["a", "b"], "y", settings)["random_forest"]}
    found = []
    for partitions in (1, 5, 13):
        shuffled = frame.orderBy(F.rand(partitions)).repartition(partitions)
        model = fit_models(forest, shuffled, ["event_id"])["f"]
        found.append(model.transform(frame).orderBy("event_id").toPandas()["y_pred"].to_numpy())
    np.testing.assert_allclose(found[0], found[1], atol=1e-9)
    np.testing.assert_allclose(found[0], found[2], atol=1e-9)

    model.save(str(tmp_path / "forest"))
    trees = stored_trees(spark, str(tmp_path / "forest"))
    np.testing.assert_allclose(walked_in_sql(trees.toPandas(), table), found[0], atol=1e-9)
    walked = walk_trees(trees, frame, ["a", "b"], ["event_id"], settings).orderBy("event_id").toPandas()
    np.testing.assert_allclose(walked["walked"], found[0], atol=1e-9)
    assert set(walked["trees"]) == {7}


def test_forest_keeps_nodes_of_rows_and_grows_the_same_trees(spark):
    rng = np.random.default_rng(11)
    table = pd.DataFrame({"event_id": np.arange(2000), "a": rng.normal(size=2000), "b": rng.normal(size=2000)})
    table["y"] = np.cos(table["a"]) + table["b"] + rng.normal(0, 0.1, 2000)
    frame = spark.createDataFrame(table)
    kept = baseline_models(["a", "b"], "y", ForestSettings(trees=6, depth=6))["random_forest"]
    assert kept.getStages()[-1].getCacheNodeIds()  # else every level walks from the roots again
    walking = kept.copy({kept.getStages()[-1].cacheNodeIds: False})
    assert not walking.getStages()[-1].getCacheNodeIds()
    one, other = (fit_models({"f": p}, frame, ["event_id"])["f"] for p in (kept, walking))
    assert one.stages[-1].totalNumNodes == other.stages[-1].totalNumNodes
    found = [m.transform(frame).orderBy("event_id").toPandas()["y_pred"].to_numpy() for m in (one, other)]
    np.testing.assert_allclose(found[0], found[1], atol=1e-9)
