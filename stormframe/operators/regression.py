"""Linear and forest regressors on tables and on windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.config import BASELINE_FEATURES, TARGET, ForestSettings

INPUT = "_inputs"


def gram_matrix(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(row_name, column_name, total)``: sums of products of ``1``, features and target.

    Everything an ordinary least-squares fit needs, in one aggregate of fixed size.
    """
    names = ["1", *features, target]
    columns = {"1": F.lit(1.0), **{c: F.col(c) for c in (*features, target)}}
    pairs = list(combinations_with_replacement(names, 2))
    sums = df.agg(
        *(F.sum(columns[a] * columns[b]).alias(f"_{i}") for i, (a, b) in enumerate(pairs))
    )
    rows = [
        F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("column_name"), F.col(f"_{i}").alias("total"))
        for i, (a, b) in enumerate(pairs)
    ]
    return sums.select(F.inline(F.array(*rows)))


def linear_regression(target: str = TARGET, inputs: str = INPUT) -> LinearRegression:
    """Ordinary least squares with intercept, solved from one distributed aggregate."""
    return LinearRegression(
        featuresCol=inputs, labelCol=target, predictionCol="y_pred",
        solver="normal", regParam=0.0, standardization=False, fitIntercept=True,
    )


def random_forest(
    target: str = TARGET, inputs: str = INPUT, settings: ForestSettings = ForestSettings()
) -> RandomForestRegressor:
    """Forest that looks at every feature in every split.

    Each row keeps the node it has reached in every tree; walking down from the roots again at every level
    took most of the time of a fit. Trees are shallow, so what a row keeps needs no checkpoint on the way.
    """
    return RandomForestRegressor(
        featuresCol=inputs, labelCol=target, predictionCol="y_pred",
        numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed,
        featureSubsetStrategy="all", cacheNodeIds=True, checkpointInterval=-1,
    )


def baseline_models(
    features: Sequence[str] = BASELINE_FEATURES,
    target: str = TARGET,
    forest: ForestSettings = ForestSettings(),
) -> dict[str, Pipeline]:
    assemble = VectorAssembler(inputCols=list(features), outputCol=INPUT)
    return {
        "linear_regression": Pipeline(stages=[assemble, linear_regression(target)]),
        "random_forest": Pipeline(stages=[assemble, random_forest(target, settings=forest)]),
    }


def in_fixed_parts(
    train: DataFrame, keys: Sequence[str], partitions: int = ForestSettings().partitions
) -> DataFrame:
    """Rows dealt out by their keys and sorted: the same parts whatever files and cores they come from.

    A tree draws its sample part by part and row by row, so the forest depends on both.
    """
    return train.repartition(partitions, *keys).sortWithinPartitions(*keys)


def fit_models(
    models: Mapping[str, Pipeline], train: DataFrame, keys: Sequence[str] = ()
) -> dict[str, Model]:
    """Fit each model; every fit is a distributed job over ``train``, in fixed parts if it has ``keys``."""
    rows = in_fixed_parts(train, keys) if keys else train
    return {name: model.fit(rows) for name, model in models.items()}


def stored_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of a stored pipeline's forest: ``tree, node, left, right, feature, threshold, value``.

    A leaf has no children. Features are numbered as the pipeline assembles them.
    """
    split = F.col("nodeData.split")
    inner = F.col("nodeData.leftChild") >= 0

    def when_inner(column: Column) -> Column:
        return F.when(inner, column)

    return spark.read.parquet(f"{folder}/stages/*_RandomForestRegressor_*/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        when_inner(F.col("nodeData.leftChild")).alias("left"), when_inner(F.col("nodeData.rightChild")).alias("right"),
        when_inner(split["featureIndex"]).alias("feature"),
        when_inner(F.get(split["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.col("nodeData.prediction").alias("value"),
    )


def walk_trees(
    trees: DataFrame, rows: DataFrame, features: Sequence[str], keys: Sequence[str], settings: ForestSettings
) -> DataFrame:
    """``keys, walked, trees``: the mean of the leaves that each row reaches, one level of all trees at a time.

    The node table is broadcast: it has no more than ``2 ** (depth + 1)`` rows a tree.
    """
    place = F.struct(*(F.col(c).cast("double").alias(c) for c in features))
    each = F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))).alias("tree")
    at = rows.select(*keys, F.array(*(place[c] for c in features)).alias("_x"), each).withColumn("node", F.lit(0))
    for _ in range(settings.depth):
        found = at.join(F.broadcast(trees.select("tree", "node", "left", "right", "feature", "threshold")), ["tree", "node"])
        goes_left = F.get("_x", F.col("feature")) <= F.col("threshold")
        step = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = found.select(*keys, "_x", "tree", step.alias("node"))
    leaves = at.join(F.broadcast(trees.select("tree", "node", "value")), ["tree", "node"])
    return leaves.groupBy(*keys).agg(F.avg("value").alias("walked"), F.count(F.lit(1)).alias("trees"))


def predict(
    fitted: Mapping[str, Model], test: DataFrame, target: str = TARGET, keys: Sequence[str] = ()
) -> DataFrame:
    """Predictions of all models below each other: ``model, keys, y_true, y_pred``."""
    parts = [
        model.transform(test).select(
            F.lit(name).alias("model"), *keys, F.col(target).alias("y_true"), "y_pred"
        )
        for name, model in fitted.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def window_vectors(sequences: DataFrame) -> DataFrame:
    """Windows flattened to one vector each, oldest step first, for a linear model."""
    flat = F.transform(F.flatten("x"), lambda v: v.cast("double"))
    return sequences.withColumns(
        {INPUT: array_to_vector(flat), "y": F.col("y").cast("double")}
    )


def fit_linear_on_window(sequences: DataFrame) -> Model:
    return linear_regression("y").fit(window_vectors(sequences))


def predict_linear_on_window(
    model: Model, sequences: DataFrame, keys: Sequence[str] = ("target_ts",)
) -> DataFrame:
    return model.transform(window_vectors(sequences)).select(
        *keys, F.col("y").alias("y_true"), "y_pred"
    )
