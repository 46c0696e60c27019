"""Standardisation with statistics of the training split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.functions.numeric import with_missing_as_null


def scaler_statistics(split_table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation of each column over ``train``.

    The filter reaches the scan, so on a table partitioned by split only that part is read.
    """
    train = split_table.where(F.col("split") == "train")
    return with_missing_as_null(train, columns).agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns),
        *(F.stddev_pop(c).alias(f"{c}_scale") for c in columns),
    )


@dataclass(frozen=True)
class Scaler:
    """Fitted means and scales. Two numbers per column, so they travel as literals."""

    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, split_table: DataFrame, columns: Sequence[str]) -> Scaler:
        row = scaler_statistics(split_table, columns).first()
        empty = [c for c in columns if row[f"{c}_mean"] is None]
        if empty:
            raise ValueError(f"no training values to fit the scaler on in {empty}")
        return cls(
            {c: row[f"{c}_mean"] for c in columns},
            # A constant column keeps its scale, as there is nothing to divide by.
            {c: row[f"{c}_scale"] or 1.0 for c in columns},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.scales[c])
                for c in self.means
                if c in df.columns
            }
        )

    def inverse(self, df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
        """Back to physical units. ``columns`` maps table columns to fitted names, so
        predictions can be taken back with the statistics of the target."""
        columns = columns or {c: c for c in self.means if c in df.columns}
        return df.withColumns(
            {
                c: F.col(c) * F.lit(self.scales[fitted]) + F.lit(self.means[fitted])
                for c, fitted in columns.items()
            }
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.means[c], self.scales[c]) for c in self.means]
        return spark.createDataFrame(rows, "column_name string, mean double, scale double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> Scaler:
        rows = df.collect()  # one row per fitted column
        return cls(
            {r["column_name"]: r["mean"] for r in rows},
            {r["column_name"]: r["scale"] for r in rows},
        )
