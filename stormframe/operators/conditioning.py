"""Row filters used before modelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.config import CONDITIONING_LIMITS, REQUIRED_COLUMNS, SeriesOrder


def model_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Keep the observation columns, plus ``extra`` such as the tiebreak."""
    return df.select(*dict.fromkeys([*REQUIRED_COLUMNS, *extra]))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def within_limits(
    df: DataFrame, limits: Mapping[str, tuple[float, float]] = CONDITIONING_LIMITS
) -> DataFrame:
    """Keep rows whose every limited column lies inside its bounds, ends included.

    A missing value fails its bound. Limits of columns the table lacks are ignored.
    """
    tests = [
        F.col(c).between(F.lit(float(low)), F.lit(float(high)))
        for c, (low, high) in limits.items()
        if c in df.columns
    ]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def require_complete(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when any of ``columns`` still holds a missing value."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    missing = {c: counts[c] for c in columns if counts[c]}
    if missing:
        raise ValueError(f"missing values remain: {missing}")


def in_time_order(df: DataFrame, order: SeriesOrder = SeriesOrder()) -> DataFrame:
    """Total order for a sink: partitions cover consecutive ranges and are sorted inside."""
    return df.orderBy(*order.keys)


def first_rows(df: DataFrame, rows: int = 500, order: SeriesOrder = SeriesOrder()) -> DataFrame:
    """The earliest ``rows`` rows: the data behind a time-series chart."""
    return in_time_order(df, order).limit(rows)
