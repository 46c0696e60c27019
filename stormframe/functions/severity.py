"""Severity index, class and latitude proxy.

All expressions are row-wise built-ins, so they fuse into one generated stage and also
work on a streaming DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.config import (
    CLASS_EDGES,
    DERIVED_WEIGHTS,
    INDEX_WEIGHTS,
    LATITUDE_BASE,
    LATITUDE_BOUNDS,
    LATITUDE_SPAN,
    NORM_RANGES,
    TARGET,
)


def clip(x: Column, low: float, high: float) -> Column:
    """Bound ``x``; missing values, NaN included, give NULL.

    ``least`` and ``greatest`` would skip NULL, and rank NaN above every number.
    """
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def min_max(x: Column, low: float, high: float) -> Column:
    return (clip(x, low, high) - F.lit(low)) / F.lit(high - low)


def normalise_dst(dst: Column) -> Column:
    return min_max(F.abs(dst), *NORM_RANGES["dst"])


def normalise_bz(bz: Column) -> Column:
    """Only southward (negative) field counts."""
    southward = F.when(bz.isNotNull() & ~F.isnan(bz), F.abs(F.least(bz, F.lit(0.0))))
    return min_max(southward, *NORM_RANGES["bz_gsm"])


def normalise_bt(bt: Column) -> Column:
    return min_max(bt, *NORM_RANGES["bt"])


def normalise_speed(speed: Column) -> Column:
    return min_max(speed, *NORM_RANGES["speed"])


def normalise_density(density: Column) -> Column:
    return min_max(density, *NORM_RANGES["density"])


NORM_COLUMNS = {
    "dst_norm": ("dst", normalise_dst),
    "bz_norm": ("bz_gsm", normalise_bz),
    "bt_norm": ("bt", normalise_bt),
    "speed_norm": ("speed", normalise_speed),
    "density_norm": ("density", normalise_density),
}


def with_norms(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: norm(F.col(source)) for name, (source, norm) in NORM_COLUMNS.items()}
    )


def with_severity_index(
    df: DataFrame, weights: Sequence[float] = INDEX_WEIGHTS
) -> DataFrame:
    """Adds the five ``*_norm`` columns and their weighted sum."""
    if len(weights) != len(NORM_COLUMNS):
        raise ValueError(f"expected {len(NORM_COLUMNS)} weights, got {len(weights)}")
    if not math.isclose(sum(weights), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("severity weights must sum to 1.0")
    terms = [F.lit(float(w)) * F.col(name) for w, name in zip(weights, NORM_COLUMNS)]
    index = terms[0]
    for term in terms[1:]:
        index = index + term
    return with_norms(df).withColumn(TARGET, index)


def severity_class(index: Column) -> Column:
    """Right-closed bins over [0, 1]; anything outside, or missing, has no class."""
    label = F.when(index < F.lit(0.0), None)
    for name, edge in CLASS_EDGES:
        label = label.when(index <= F.lit(edge), F.lit(name))
    return label


def severity_rank(label: Column) -> Column:
    """Ordinal of a class, 0 for the mildest, so classes can be ordered."""
    rank = F
    for position, (name, _) in enumerate(CLASS_EDGES):
        rank = rank.when(label == name, F.lit(position))
    return rank


def auroral_latitude(index: Column) -> Column:
    return clip(F.lit(LATITUDE_BASE) - F.lit(LATITUDE_SPAN) * index, *LATITUDE_BOUNDS)


def with_severity_class(df: DataFrame) -> DataFrame:
    return df.withColumn("storm_severity_class", severity_class(F.col(TARGET)))


def with_auroral_latitude(df: DataFrame) -> DataFrame:
    return df.withColumn("auroral_latitude_deg", auroral_latitude(F.col(TARGET)))


def with_derived_features(
    df: DataFrame, weights: Sequence[float] = DERIVED_WEIGHTS
) -> DataFrame:
    """Index, class and latitude in one step."""
    return (
        with_severity_index(df, weights)
        .transform(with_severity_class)
        .transform(with_auroral_latitude)
    )
