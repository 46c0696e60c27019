"""From observations to model-ready tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stormframe.config import MEASUREMENTS, SPLITS, TARGET, SeriesOrder, Settings
from stormframe.functions.numeric import with_missing_as_null
from stormframe.functions.severity import with_derived_features
from stormframe.operators.blocks import PART, BlockPlan, plan_blocks
from stormframe.operators.conditioning import (
    drop_missing,
    model_columns,
    within_limits,
)
from stormframe.operators.ordered import (
    LENGTH,
    chronological_split,
    fill_missing,
    with_block_position,
    with_series_position,
)
from stormframe.operators.quality import (
    check_schema,
    gap_measures,
    measured_report,
    report_counts,
    require_trainable,
    run_summary,
)
from stormframe.operators.scaling import Scaler
from stormframe.operators.sequences import require_windows, sequence_windows
from stormframe.sources.tables import read_aligned
from stormframe.sources.versions import Versions

STEP = "_step_hours"


@dataclass(frozen=True)
class Conditioned:
    """Filled, limited and derived rows with their position inside the block."""

    rows: DataFrame
    plan: BlockPlan


def condition(
    observations: DataFrame,
    settings: Settings = Settings(),
    order: SeriesOrder = SeriesOrder(),
    block_rows: int | None = None,
    plan: BlockPlan | None = None,
    gaps: Observation | None = None,
    incomplete: Observation | None = None,
) -> Conditioned:
    """Fill, drop what cannot be filled, remove implausible rows, derive the target.

    Rows are shuffled and sorted once. Positions are counted after the filter and in the same
    pass, since splits and windows count the rows that are left. ``gaps`` observes the steps of all
    rows and ``incomplete`` missing values of those left, while the result is written.
    """
    check_schema(observations)
    table = with_missing_as_null(model_columns(observations, [order.tiebreak, *order.by]))
    plan = plan or plan_blocks(table, order, block_rows)
    filled = fill_missing(plan.assign(table), plan, MEASUREMENTS, step=STEP if gaps else None)
    if gaps:
        filled = filled.observe(gaps, *gap_measures(STEP)).drop(STEP)
    kept = within_limits(drop_missing(filled, MEASUREMENTS), settings.limits)
    derived = with_derived_features(kept, settings.weights)
    rows = with_block_position(derived, plan, placed=True).drop(PART)
    if incomplete:
        needed = [*settings.features, settings.target]
        rows = rows.observe(incomplete, *(F.count_if(F.col(c).isNull()).alias(c) for c in needed))
    return Conditioned(rows, plan)


def split_table(conditioned: Conditioned, settings: Settings = Settings()) -> DataFrame:
    """Positions in the whole series and the chronological split, in physical units."""
    positioned = with_series_position(conditioned.rows, conditioned.plan)
    return conditioned.plan.clean(
        chronological_split(positioned, settings.val_fraction, settings.test_fraction)
    ).drop(LENGTH)


def split_windows(
    table: DataFrame,
    settings: Settings = Settings(),
    order: SeriesOrder = SeriesOrder(),
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Sequence table of every split; no window crosses the edge of a split or series."""
    return sequence_windows(
        table,
        features or settings.features,
        settings.target,
        settings.window,
        time=order.time,
        by=[*order.by, "split"],
    )


def aligned_windows(
    spark: SparkSession,
    folder: str,
    window: int,
    features: Sequence[str],
    target: str = TARGET,
    **options: str,
) -> DataFrame:
    """Windows of all splits from aligned files, with a column ``split``.

    Strict: raises if a pair of files differs in length, or a split is too short for one window.
    """
    tables, counts = [], {}
    for split in SPLITS:
        table, counts[split] = read_aligned(spark, folder, split, features, target, **options)
        tables.append(table.withColumn("split", F.lit(split)))
    require_windows(counts, window)
    return sequence_windows(reduce(DataFrame.unionByName, tables), features, target, window, by=["split"])


def prepare(
    observations: DataFrame,
    folder: str,
    settings: Settings = Settings(),
    order: SeriesOrder = SeriesOrder(),
    gate: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Write ``conditioned``, ``tabular``, ``sequences``, ``scaler``, ``validation`` and ``summary``.

    They become the current version of ``folder`` together, once all are complete; ``latest`` names the
    place. A run that fails leaves the earlier version as it was.

    The observations are read three times: for the block plan, which counts what the validation
    report needs on the way, for the edges of the blocks, and for the rows. Gaps and missing values
    are observed while the conditioned rows are written. Everything later starts from that table:
    positions then take one count per block, and lost executors do not replay the fill. Returns the
    stored one-row summary; ``gate`` raises when it is too small to train on.
    """
    spark = observations.sparkSession
    check_schema(observations)

    def write(target: str) -> None:
        table = with_missing_as_null(observations)
        plan = plan_blocks(table, order, block_rows, report_counts(table))
        if not plan.rows:
            raise ValueError("validation failed: the table is empty")
        gaps, incomplete = Observation(), Observation()
        conditioned = condition(observations, settings, order, plan=plan, gaps=gaps, incomplete=incomplete)
        conditioned.rows.write.parquet(f"{target}/conditioned")
        measured_report(spark, plan.measured, gaps.get).coalesce(1).write.parquet(f"{target}/validation")
        holes = {c: n for c, n in incomplete.get.items() if n}
        if holes:
            raise ValueError(f"missing values after conditioning: {holes}")

        stored = Conditioned(spark.read.parquet(f"{target}/conditioned"), plan)
        labelled = split_table(stored, settings)
        scaler = Scaler.fit(labelled, [*settings.features, settings.target])
        scaler.to_frame(spark).coalesce(1).write.parquet(f"{target}/scaler")
        scaler.transform(labelled).write.partitionBy("split").parquet(f"{target}/tabular")
        tabular = spark.read.parquet(f"{target}/tabular")
        summary = run_summary(tabular, settings.window, settings.features, settings.target, order.by)
        summary.coalesce(1).write.parquet(f"{target}/summary")
        if gate:
            require_trainable(spark.read.parquet(f"{target}/summary"))
        windows = split_windows(tabular, settings, order).withColumn("window", F.lit(settings.window))
        windows.write.option("compression", "zstd").partitionBy("window", "split").parquet(f"{target}/sequences")

    return spark.read.parquet(f"{Versions(spark, folder).replace(write)}/summary")
