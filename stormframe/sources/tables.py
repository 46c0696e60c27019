"""Readers and writers of the tables that stages exchange.

Parquet is used between stages; CSV is read for tables that come from elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormframe.config import TARGET
from stormframe.functions.numeric import name_from_file, nan_to_null
from stormframe.operators.ordered import POSITION
from stormframe.operators.scaling import Scaler
from stormframe.sources.places import numbered_rows
from stormframe.sources.versions import read_parts, read_whole, write_parts, write_whole

OBSERVATION_SCHEMA = T.StructType(
    [T.StructField("datetime", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("bt", "bz_gsm", "speed", "density", "dst")]
)
PREDICTION_SCHEMA = "model string, y_true double, y_pred double"
PREDICTION_SUFFIX = "_test_predictions"


# --- readers ------------------------------------------------------------------------


def read_observations_csv(
    spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA, **options: str
) -> DataFrame:
    """CSV with a header and a declared schema; NaN is read as missing."""
    table = spark.read.schema(schema).option("header", "true").options(**options).csv(path)
    doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    return table.withColumns({c: nan_to_null(F.col(c)) for c in doubles})


def read_split(
    spark: SparkSession, path: str, split: str, features: Sequence[str], target: str = TARGET,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One split, projected to features and target: a pruned partition and few columns."""
    table = read_parts(spark, path).where(F.col("split") == split)
    return table.select(*keys, *features, target)


def read_aligned(
    spark: SparkSession,
    folder: str,
    split: str,
    features: Sequence[str],
    target: str = TARGET,
    index: str = "datetime",
    **options: str,
) -> tuple[DataFrame, int]:
    """Features of ``X_<split>.csv`` next to the target of ``y_<split>.csv``, row by row, and their number.

    Both are CSV with a header, a time column first, as a file or a folder of ordered parts. The k-th
    row of one belongs to the k-th row of the other, whatever their times say; the time is that of
    the target. Columns: ``index, features, target, rn``. Raises if one side has more rows.
    """

    def numbered(name: str, columns: Sequence[str]) -> tuple[DataFrame, int]:
        fields = [T.StructField(index, T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in columns)]
        place = f"{folder}/{name}_{split}.csv"
        rows, n = numbered_rows(
            spark.read.schema(T.StructType(fields)).option("header", "true").options(**options).csv(place), POSITION
        )
        return rows.withColumns({c: nan_to_null(F.col(c)) for c in columns}), n

    x, x_rows = numbered("X", features)
    y, y_rows = numbered("y", [target])
    if x_rows != y_rows:
        raise ValueError(f"X and y must have the same length: {x_rows} and {y_rows} rows in split {split!r}")
    both = x.drop(index).join(y, POSITION)
    return both.select(index, *features, target, POSITION), x_rows


def read_sequences(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = read_parts(spark, path)
    return table.where(F.col("split") == split) if split else table


def read_predictions(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Predictions ``<model>_test_predictions.csv`` (a file or a folder of parts) of several folders.

    The model name comes from the path. Folders without predictions are passed over.
    """
    found = []
    for folder in folders:
        reader = spark.read.schema(PREDICTION_SCHEMA).option("header", "true")
        try:
            found.append(reader.csv(f"{folder}/*{PREDICTION_SUFFIX}.csv"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        raise FileNotFoundError(f"no predictions found under {list(folders)}")
    name = name_from_file(F.col("_metadata.file_path"), PREDICTION_SUFFIX)
    parts = [table.select(name.alias("model"), "y_true", "y_pred") for table in found]
    return reduce(DataFrame.unionByName, parts)


def read_scaler(spark: SparkSession, path: str) -> Scaler:
    return Scaler.from_frame(read_whole(spark, path))


# --- writers ------------------------------------------------------------------------


def write_observations(df: DataFrame, path: str, append: bool = False) -> bool:
    """Write by year; an empty table is skipped. Returns whether anything was written.

    Years of ``df`` replace those stored, so a repeated load leaves no row twice; ``append`` adds.
    ``read_parts`` reads the table.
    """
    return write_parts(df.withColumn("year", F.year("datetime")), path, ["year"], append)


def write_splits(df: DataFrame, path: str) -> None:
    write_parts(df, path, ["split"])


def write_sequences(df: DataFrame, path: str, window: int) -> None:
    """Sequence table below ``window=<w>/split=<s>``; other window lengths stay in place."""
    write_parts(df.withColumn("window", F.lit(window)), path, ["window", "split"], compression="zstd")


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by model; writing a model again replaces its rows and no others."""
    write_parts(df, path, ["model"])


def write_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    write_whole(scaler.to_frame(spark).coalesce(1), path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row per model, sorted by model, in one file."""
    write_whole(metrics.orderBy("model").coalesce(1), path)
