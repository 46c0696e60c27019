"""Operators on rows in time order: fill, rank, previous row, split, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.config import SPLITS
from stormframe.functions.numeric import hours_between
from stormframe.operators.blocks import BlockPlan

POSITION = "rn"
LENGTH = "n_rows"

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def fill_missing(
    blocked: DataFrame, plan: BlockPlan, columns: Sequence[str], step: str | None = None
) -> DataFrame:
    """Forward fill of any length, then backward fill of the head that is still missing.

    After a forward fill only rows before the first value of a series are missing, and they
    all take that first value, so no backward pass over the rows is needed. ``step`` adds the hours
    since the row before, in the same passes.
    """
    time = plan.order.time
    here = plan.window().rowsBetween(*_UP_TO_HERE)
    whole = plan.window().rowsBetween(*_WHOLE)
    past = {c: F.last(c, ignorenulls=True).over(here) for c in columns}
    head = {c: F.first(c, ignorenulls=True).over(whole) for c in columns}
    steps = {"_time_before": F.lag(time).over(plan.window())} if step else {}
    if not plan.divided:
        filled = blocked.withColumns({**{c: F.coalesce(past[c], head[c]) for c in columns}, **steps})
        return _with_step(filled, step, time, F.col("_time_before")) if step else filled

    last_time = [F.max(time).alias("_last_time")] if step else []
    edges = plan.summarise(blocked, *_edges(columns, plan), *last_time)
    before = plan.across_blocks().rowsBetween(Window.unboundedPreceding, -1)
    whole_series = plan.across_blocks().rowsBetween(*_WHOLE)
    carry = edges.select(
        *plan.group,
        *(F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_prev_{c}") for c in columns),
        *(
            F.first(f"_first_{c}", ignorenulls=True).over(whole_series).alias(f"_start_{c}")
            for c in columns
        ),
        *([F.lag("_last_time").over(plan.across_blocks()).alias("_block_before")] if step else []),
    )
    # The carry joins after the windows, so it is not shuffled along with the rows. Series in
    # one block have no carry and look for their first value inside it.
    windows = {f"_past_{c}": past[c] for c in columns}
    if plan.order.by:
        windows |= {f"_head_{c}": head[c] for c in columns}
    filled = {
        c: F.coalesce(
            F.col(f"_past_{c}"),
            F.col(f"_prev_{c}"),
            F.col(f"_start_{c}"),
            *([F.col(f"_head_{c}")] if plan.order.by else []),
        )
        for c in columns
    }
    helpers = [*windows, *(f"_{part}_{c}" for part in ("prev", "start") for c in columns)]
    placed = plan.place(blocked).withColumns({**windows, **steps})
    out = plan.attach(placed, carry).withColumns(filled).drop(*helpers)
    if not step:
        return out
    return _with_step(out, step, time, F.coalesce("_time_before", "_block_before")).drop("_block_before")


def _with_step(rows: DataFrame, step: str, time: str, before: Column) -> DataFrame:
    return rows.withColumn(step, hours_between(F.col(time), before)).drop("_time_before")


def _edges(columns: Sequence[str], plan: BlockPlan) -> list[Column]:
    """First and last value of each column in a block that is not missing."""
    position, edges = plan.position(), []
    for c in columns:
        at = F.when(F.col(c).isNotNull(), position)
        edges += [F.min_by(c, at).alias(f"_first_{c}"), F.max_by(c, at).alias(f"_last_{c}")]
    return edges


def with_position(blocked: DataFrame, plan: BlockPlan) -> DataFrame:
    """Zero-based position in the series and the series length, counting the rows given."""
    return with_series_position(with_block_position(blocked, plan), plan)


def with_block_position(blocked: DataFrame, plan: BlockPlan, placed: bool = False) -> DataFrame:
    """Position inside the block: the part that needs the rows in order.

    ``placed`` tells that rows are shuffled by block already, as ``fill_missing`` leaves them.
    """
    blocked = blocked if placed else plan.place(blocked)
    return blocked.withColumn(POSITION, F.row_number().over(plan.window()).cast("long") - 1)


def with_series_position(blocked: DataFrame, plan: BlockPlan) -> DataFrame:
    """Turn positions inside blocks into positions in the series.

    Needs only row counts per block. On a stored table with block positions this costs one
    small aggregate and a join with it: the rows are neither sorted nor shuffled again.
    """
    if not plan.divided:
        whole = Window.partitionBy(*plan.group)
        return blocked.withColumn(LENGTH, F.count(F.lit(1)).over(whole))
    counts = plan.summarise(blocked, F.count(F.lit(1)).alias("_count"))
    before = plan.across_blocks().rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(
        *plan.group,
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
        F.sum("_count").over(plan.across_blocks().rowsBetween(*_WHOLE)).alias("_total"),
    )
    helpers = {}
    if plan.order.by:
        helpers["_alone"] = F.count(F.lit(1)).over(Window.partitionBy(*plan.group))
    total = F.coalesce(*(F.col(c) for c in ("_total", *helpers)))
    offset = F.coalesce(F.col("_offset"), F.lit(0))
    return (
        plan.attach(blocked.withColumns(helpers), carry)
        .withColumns({POSITION: F.col(POSITION) + offset, LENGTH: total})
        .drop("_offset", "_total", *helpers)
    )


def with_previous(blocked: DataFrame, plan: BlockPlan, column: str, name: str) -> DataFrame:
    """Adds ``name``: a struct holding ``column`` of the row before, NULL on the first row."""
    boxed = F.struct(F.col(column).alias("value"))
    local = F.lag(boxed).over(plan.window())
    if not plan.divided:
        return blocked.withColumn(name, local)
    if column == plan.order.time:
        last = F.struct(F.max(column).alias("value"))
    else:
        last = F.max_by(boxed, plan.position())
    edges = plan.summarise(blocked, last.alias("_edge"))
    carry = edges.select(*plan.group, F.lag("_edge").over(plan.across_blocks()).alias("_before"))
    return (
        plan.attach(plan.place(blocked).withColumn(name, local), carry)
        .withColumn(name, F.coalesce(F.col(name), F.col("_before")))
        .drop("_before")
    )


def with_step_hours(blocked: DataFrame, plan: BlockPlan, name: str = "step_hours") -> DataFrame:
    """Hours since the row before; NULL on the first row of a series."""
    time = plan.order.time
    return (
        with_previous(blocked, plan, time, "_previous")
        .withColumn(name, hours_between(F.col(time), F.col("_previous.value")))
        .drop("_previous")
    )


def chronological_split(
    positioned: DataFrame, val_fraction: float = 0.15, test_fraction: float = 0.15
) -> DataFrame:
    """Label rows train, val or test: contiguous stretches from the earliest to the latest.

    The two tail sizes are truncated, and train takes the rest.
    """
    n_test = F.floor(F.col(LENGTH) * F.lit(test_fraction))
    n_val = F.floor(F.col(LENGTH) * F.lit(val_fraction))
    n_train = F.col(LENGTH) - n_test - n_val
    train, val, test = SPLITS
    return positioned.withColumn(
        "split",
        F.when(F.col(POSITION) < n_train, train)
        .when(F.col(POSITION) < n_train + n_val, val)
        .otherwise(test),
    )


def persistence_forecast(blocked: DataFrame, plan: BlockPlan, target: str) -> DataFrame:
    """Predict each value by the one before it: T rows give T - 1 predictions."""
    if not plan.order.by and plan.rows < 2:
        raise ValueError("a persistence forecast needs at least 2 rows")
    return (
        with_previous(blocked, plan, target, "_previous")
        .where(F.col("_previous").isNotNull())
        .select(
            *plan.order.keys,
            F.col(target).alias("y_true"),
            F.col("_previous.value").alias("y_pred"),
        )
    )
