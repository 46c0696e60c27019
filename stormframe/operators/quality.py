"""Data-quality reports. Each is one aggregate; only continuity needs rows in order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.config import (
    FEATURES,
    GATE_COLUMNS,
    MAX_STEP_HOURS,
    MIN_SEQUENCES,
    REPORT_LIMITS,
    REQUIRED_COLUMNS,
    SPLITS,
    TARGET,
    SeriesOrder,
)
from stormframe.functions.numeric import with_missing_as_null
from stormframe.operators.blocks import BlockPlan, plan_blocks
from stormframe.operators.ordered import with_step_hours


def check_schema(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"schema check failed: missing columns {missing}")


def percentage(part: Column, whole: Column, places: int) -> Column:
    """Share in percent, rounded half to even; 0 of nothing is 0."""
    share = F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
    return F.bround(share, places)


# --- missing values -----------------------------------------------------------------


def _null_counts(columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns]


def _overall_missing(columns: Sequence[str]) -> Column:
    nulls = sum((F.col(f"_null_{c}") for c in columns), F.lit(0))
    return percentage(nulls, F.col("total_records") * F.lit(len(columns)), 2)


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, null_count, null_pct)`` per column, and a row ``*`` over all cells."""
    columns = list(columns or df.columns)
    counts = with_missing_as_null(df).agg(F.count(F.lit(1)).alias("total_records"), *_null_counts(columns))
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_null_{c}").alias("null_count"),
            percentage(F.col(f"_null_{c}"), F.col("total_records"), 2).alias("null_pct"),
        )
        for c in columns
    ]
    overall = F.struct(
        F.lit("*").alias("column_name"),
        sum((F.col(f"_null_{c}") for c in columns), F.lit(0)).alias("null_count"),
        _overall_missing(columns).alias("null_pct"),
    )
    return counts.select(F.inline(F.array(*per_column, overall)))


# --- values out of range ------------------------------------------------------------


def _outlier_counts(limits: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    counts = {}
    for c, (low, high) in limits.items():
        outside = (F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))
        counts |= {f"_out_{c}": F.count_if(outside), f"_values_{c}": F.count(c)}
    return counts


def _present(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> dict:
    return {c: bounds for c, bounds in limits.items() if c in df.columns}


def outlier_report(
    df: DataFrame, limits: Mapping[str, tuple[float, float]] = REPORT_LIMITS
) -> DataFrame:
    """``(column_name, outliers, outlier_pct)``; the share is of values that are present."""
    limits = _present(df, limits)
    counts = with_missing_as_null(df).agg(*(a.alias(name) for name, a in _outlier_counts(limits).items()))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_out_{c}").alias("outliers"),
            percentage(F.col(f"_out_{c}"), F.col(f"_values_{c}"), 3).alias("outlier_pct"),
        )
        for c in limits
    ]
    return counts.select(F.inline(F.array(*rows)))


# --- continuity ---------------------------------------------------------------------


def continuity_report(
    df: DataFrame,
    order: SeriesOrder = SeriesOrder(),
    max_step_hours: float = MAX_STEP_HOURS,
    block_rows: int | None = None,
    plan: BlockPlan | None = None,
) -> DataFrame:
    """Gaps between neighbours, per series of ``order.by`` or over all rows.

    A gap is a step longer than ``max_step_hours``; the fraction is of the row count. A block
    plan made for the same rows saves the scans that make one.
    """
    keys = df.select(*order.keys)
    plan = plan or plan_blocks(keys, order, block_rows)
    steps = with_step_hours(plan.assign(keys), plan)
    gap = F.col("step_hours") > F.lit(max_step_hours)
    share = F.bround(F.try_divide(F.count_if(gap), F.count(F.lit(1))), 4).alias("gap_fraction")
    report = [*gap_measures("step_hours", max_step_hours), share]
    return steps.groupBy(*order.by).agg(*report) if order.by else steps.agg(*report)


# --- all reports together -----------------------------------------------------------


def report_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limits: Mapping[str, tuple[float, float]] = REPORT_LIMITS,
) -> dict[str, Column]:
    """The aggregates that the reports on cells are made from; they may be added up.

    ``df`` has NULL for what is missing.
    """
    return {
        **{f"_null_{c}": F.count_if(F.col(c).isNull()) for c in columns or df.columns},
        **_outlier_counts(_present(df, limits)),
    }


def gap_measures(step: str = "step_hours", max_step_hours: float = MAX_STEP_HOURS) -> list[Column]:
    """Number and longest of the gaps among rows with ``step``."""
    gap = F.col(step) > F.lit(max_step_hours)
    return [
        F.count_if(gap).alias("num_gaps"),
        F.coalesce(F.max(F.when(gap, F.col(step))), F.lit(0.0)).alias("max_gap_hours"),
    ]


def measured_report(spark: SparkSession, counts: Mapping[str, int], gaps: Mapping[str, float]) -> DataFrame:
    """``validation_report`` from what was measured in passing: ``n`` with ``report_counts``, and ``gap_measures``."""
    values = {"total_records": int(counts["n"]), **{c: int(v) for c, v in counts.items() if c != "n"}}
    row = {**values, "num_gaps": int(gaps["num_gaps"]), "max_gap_hours": float(gaps["max_gap_hours"])}
    kinds = ", ".join(f"`{c}` {'double' if c == 'max_gap_hours' else 'long'}" for c in row)
    measured = spark.createDataFrame([tuple(row.values())], kinds)
    columns = [c.removeprefix("_null_") for c in counts if c.startswith("_null_")]
    limits = [c.removeprefix("_out_") for c in counts if c.startswith("_out_")]
    share = F.bround(F.try_divide("num_gaps", "total_records"), 4).alias("gap_fraction")
    return measured.select(*_cells(columns, limits), "num_gaps", "max_gap_hours", share)


def _cells(columns: Sequence[str], limits: Sequence[str]) -> list[Column]:
    """The report's columns on missing values and outliers, from their counts."""
    return [
        F.col("total_records"),
        _overall_missing(columns).alias("missing_pct"),
        *(
            percentage(F.col(f"_null_{c}"), F.col("total_records"), 2).alias(f"{c}_missing_pct")
            for c in columns
        ),
        *(F.col(f"_out_{c}").alias(f"{c}_outliers") for c in limits),
        *(
            percentage(F.col(f"_out_{c}"), F.col(f"_values_{c}"), 3).alias(f"{c}_outlier_pct")
            for c in limits
        ),
    ]


def validation_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limits: Mapping[str, tuple[float, float]] = REPORT_LIMITS,
    order: SeriesOrder = SeriesOrder(),
    block_rows: int | None = None,
    plan: BlockPlan | None = None,
) -> DataFrame:
    """Every check in one row: a single aggregate over the table next to the gap report.

    Missing values are counted in all columns of the table, or in ``columns``.
    Gaps are counted inside each series of ``order.by`` and added up; the longest is taken.
    """
    check_schema(df)
    table, columns = with_missing_as_null(df), list(columns or df.columns)
    aggregates = [a.alias(name) for name, a in report_counts(table, columns, limits).items()]
    counts = table.agg(F.count(F.lit(1)).alias("total_records"), *aggregates)
    cells = counts.select(*_cells(columns, list(_present(df, limits))))
    gaps = continuity_report(df, order, block_rows=block_rows, plan=plan)
    if order.by:
        gaps = gaps.agg(
            F.coalesce(F.sum("num_gaps"), F.lit(0)).alias("num_gaps"),
            F.coalesce(F.max("max_gap_hours"), F.lit(0.0)).alias("max_gap_hours"),
        )
        both = cells.unionByName(gaps, allowMissingColumns=True)
        one = both.agg(*(F.max(c).alias(c) for c in both.columns))
        share = F.bround(F.try_divide("num_gaps", "total_records"), 4)
        return one.withColumn("gap_fraction", share)
    both = cells.unionByName(gaps, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def require_valid(report: DataFrame) -> dict:
    """Run a validation report; raise when the table it describes was empty."""
    row = report.first().asDict()
    if not row["total_records"]:
        raise ValueError("validation failed: the table is empty")
    return row


# --- summary of a prepared table and the gate before training -----------------------


def run_summary(
    split_table: DataFrame,
    window: int,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row: sequences per split, window length, features and target.

    No window crosses from one series of ``by`` to the next, so each series loses ``window`` rows.
    """
    counts = split_table.groupBy(*by).agg(
        *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS)
    )
    windows = {s: F.greatest(F.col(s) - F.lit(window), F.lit(0)) for s in SPLITS}
    totals = counts.agg(*(F.coalesce(F.sum(w), F.lit(0)).alias(f"{s}_samples") for s, w in windows.items()))
    return totals.select(
        *(f"{s}_samples" for s in SPLITS),
        F.lit(window).cast("long").alias("sequence_length"),
        F.lit(len(features)).cast("long").alias("n_features"),
        F.array(*(F.lit(f) for f in features)).alias("feature_names"),
        F.lit(target).alias("target_name"),
    )


def gate_checks(summary: DataFrame) -> DataFrame:
    """``(check, passed)`` rows of the pre-training gate."""
    missing = [c for c in GATE_COLUMNS if c not in summary.columns]
    if missing:
        raise ValueError(f"summary lacks columns {missing}")
    checks = {
        **{f"{s}_samples": F.col(f"{s}_samples") >= least for s, least in MIN_SEQUENCES.items()},
        "sequence_length": F.col("sequence_length") > 0,
        "n_features": F.col("n_features") == F.size("feature_names"),
    }
    rows = [F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()]
    return summary.select(F.inline(F.array(*rows)))


def require_trainable(summary: DataFrame) -> None:
    """Raise when the gate fails, naming the checks."""
    failed = [row["check"] for row in gate_checks(summary).where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"not enough to train on: {failed}")
